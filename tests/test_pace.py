"""Requests in flight: fewer when a server is busy, more again as it answers; refused batches in halves."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from corpusloom.operators import models
from corpusloom.operators.models import Failure, HttpBackend, Options, Pace


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_the_limit_rises_by_one_a_round_and_falls_by_half():
    clock = Clock()
    pace = Pace(16, clock=clock)
    assert pace.limit == 8
    for _ in range(8):
        began = pace.begin()
        clock.now += 0.1
        pace.end(began)
    assert 8.9 < pace.limit < 9.1
    began = [pace.begin() for _ in range(4)]
    clock.now += 0.1
    for b in began:
        pace.end(b, busy=True, wait=2.0)
    assert 4.4 < pace.limit < 4.6  # four refusals of one round are one
    assert pace.until == clock.now + 2.0
    clock.now += 3
    began = pace.begin()
    clock.now += 5  # far longer than usual
    pace.end(began)
    assert 2.2 < pace.limit < 2.3
    for _ in range(200):
        began = pace.begin()
        clock.now += 0.1
        pace.end(began)
    assert pace.limit == 16 and pace.flying == 0
    for _ in range(20):
        began = pace.begin()
        clock.now += 0.1
        pace.end(began, busy=True)
    assert pace.limit == 1


class Throttling(BaseHTTPRequestHandler):
    """Answers two requests at once; others are told to come back at once. Refuses prompts that are too long."""

    lock, flying, most, refused, seen = threading.Lock(), 0, 0, 0, []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompts = body.get("prompt") or [body["messages"][-1]["content"]]
        prompts = prompts if isinstance(prompts, list) else [prompts]
        me = Throttling
        with me.lock:
            busy = me.flying >= 2
            me.refused += busy
            me.flying += not busy
            me.seen.append(len(prompts))
        if busy:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        time.sleep(0.02)
        with me.lock:
            me.flying -= 1
        if any(len(p) > 20 for p in prompts):
            self.send_response(400)
            self.end_headers()
            self.wfile.write(b"too long")
            return
        self.send_response(200)
        self.end_headers()
        texts = [f"re {p}" for p in prompts for _ in range(body.get("n", 1))]
        choices = [{"text": t, "message": {"content": t}} for t in texts]
        self.wfile.write(json.dumps({"choices": choices}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    Throttling.flying, Throttling.refused, Throttling.seen = 0, 0, []
    s = ThreadingHTTPServer(("127.0.0.1", 0), Throttling)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_a_throttling_server_gets_what_it_can_take(url):
    backend = HttpBackend(url, workers=16, batched=False, retries=60)
    prompts = [f"p{k}" for k in range(150)]
    assert backend.complete(prompts, prompts, "m", Options()) == [[f"re {p}"] for p in prompts]
    assert backend.pace().limit < 8
    assert Throttling.refused < 150


def test_a_refused_batch_is_asked_in_halves(url):
    backend = HttpBackend(url, workers=1, batched=True, rows=8)
    prompts = [f"p{k}" if k != 5 else "x" * 30 for k in range(16)]
    got = backend.complete(prompts, prompts, "m", Options(n=2))
    assert [g for k, g in enumerate(got) if k != 5] == [[f"re {p}"] * 2 for k, p in enumerate(prompts) if k != 5]
    assert got[5] == Failure("HTTP 400: too long")
    assert sorted(Throttling.seen) == [1, 1, 2, 2, 4, 4, 8, 8]
    single = HttpBackend(url, batched=False)
    assert single.complete(["a", "y" * 30], ["1", "2"], "m", Options()) == [["re a"], Failure("HTTP 400: too long")]
    assert single.chat([[{"role": "user", "content": "y" * 30}]], ["1"], "m", Options()) == [Failure("HTTP 400: too long")]


def test_refused_rows_of_a_stage(spark, url):
    df = spark.createDataFrame([(1, "a"), (2, "z" * 30)], "id long, text string")
    out = models.complete(df, "text", "said", HttpBackend(url, batched=False), model="m", errors="why")
    assert sorted((r.id, r.said, r.why) for r in out.collect()) == [(1, ["re a"], None), (2, None, "HTTP 400: too long")]
