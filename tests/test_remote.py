"""Python data sources over a local server and a folder."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
import yaml
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources import files, remote

FEATURES = [{"name": "text", "type": {"dtype": "string", "_type": "Value"}}, {"name": "n", "type": {"dtype": "int64", "_type": "Value"}}, {"name": "x", "type": {"dtype": "float64", "_type": "Value"}}, {"name": "tags", "type": [{"dtype": "string", "_type": "Value"}]}, {"name": "meta", "type": {"k": {"dtype": "int32", "_type": "Value"}}}, {"name": "label", "type": {"names": ["a", "b"], "_type": "ClassLabel"}}, {"name": "img", "type": {"_type": "Image"}}]


def row(i):
    return {"text": None if i == 3 else f"t{i} é", "n": i, "x": i, "tags": ["a", str(i)], "meta": {"k": i}, "label": i % 2, "img": {"src": "u"}}


class Server(BaseHTTPRequestHandler):
    total, asked, busy, lock = 257, [], 0, threading.Lock()

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        with Server.lock:
            Server.asked.append((int(q["offset"]), int(q["length"]), q["dataset"], q["config"], q["split"], self.headers.get("Authorization")))
            busy = Server.busy > 0
            Server.busy -= busy
        if busy:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if q["dataset"] == "none":
            self.send_response(404)
            self.end_headers()
            return
        got = [{"row_idx": i, "row": row(i)} for i in range(int(q["offset"]), min(Server.total, int(q["offset"]) + int(q["length"])))]
        if q["dataset"] == "short":
            got = got[:1]
        data = json.dumps({"features": FEATURES, "rows": got, "num_rows_total": Server.total}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Server.total, Server.asked, Server.busy = 257, [], 0
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_rows_come_by_pages(spark, server):
    df = remote.read_remote(spark, server, "set:cfg:test", page=50, pages=2, token="secret")
    assert df.dtypes == [("text", "string"), ("n", "bigint"), ("x", "double"), ("tags", "array<string>"), ("meta", "struct<k:int>"), ("label", "bigint"), ("img", "string"), ("row_idx", "bigint")]
    Server.asked.clear()
    got = sorted(df.collect(), key=lambda r: r.row_idx)
    assert [r.n for r in got] == [r.row_idx for r in got] == list(range(257))
    assert (got[3].text, got[4].text, got[5].tags, got[6].meta.k, got[7].label, json.loads(got[8].img)) == (None, "t4 é", ["a", "5"], 6, 1, {"src": "u"})
    pages = [a for a in Server.asked if a[1] > 1]
    assert Counter(a[:2] for a in pages) == Counter([(0, 50), (50, 50), (100, 50), (150, 50), (200, 50), (250, 7)])
    assert {a[2:] for a in Server.asked} == {("set", "cfg", "test", "Bearer secret")}
    assert df.rdd.getNumPartitions() == 3


def test_bounds_on_rows_are_pushed(spark, server):
    df = remote.read_remote(spark, server, "set", page=10, pages=1)
    Server.asked.clear()
    assert sorted(r.n for r in df.where("row_idx >= 100 and row_idx < 125 and n % 2 = 0").collect()) == list(range(100, 125, 2))
    assert sorted(a[:2] for a in Server.asked if a[1] > 1) == [(100, 10), (110, 10), (120, 5)]
    assert df.where("row_idx > 255").count() == 1 and df.where("row_idx = 9").first().n == 9 and df.where("row_idx >= 300").count() == 0
    assert df.where(F.col("n") < 5).count() == 5


def test_a_busy_server_is_asked_again_and_other_errors_end(spark, server):
    df = remote.read_remote(spark, server, "set", page=100)
    Server.busy = 3
    assert df.count() == 257
    with pytest.raises(Exception, match="404"):
        remote.read_remote(spark, server, "none")
    with pytest.raises(Exception, match="were asked for"):
        remote.read_remote(spark, server, "short", page=100).collect()
    Server.total = 0
    assert remote.read_remote(spark, server, "set").count() == 0
    with pytest.raises(Exception, match="needs url"):
        remote.register(spark).read.format("remote_rows").load()


def test_a_schema_may_be_given_and_names_resolved(spark, server, monkeypatch):
    given = remote.register(spark).read.format("remote_rows").schema("n long, missing string").options(url=server, dataset="set").load()
    assert given.where("missing is null").count() == 257
    monkeypatch.setitem(files.RESOLVERS, "hub", lambda s, name: remote.read_remote(s, server, name))
    assert files.read_named(spark, "hub:set:train").count() == 257
    assert remote.kind_of({"feature": {"dtype": "int32"}, "_type": "Sequence"}) == T.ArrayType(T.IntegerType())


def leaf(k, document=None):
    seeds = [{"context": f"c{i}", "questions_and_answers": [{"question": f"q{k}{i}{j}", "answer": "a"} for j in range(3)]} for i in range(5)] if document else [{"question": f"q{k}{i}", "answer": "a"} for i in range(5)]
    return {"version": 1, "created_by": "me", "task_description": f"t{k}", "seed_examples": seeds} | ({"domain": "d", "document_outline": "o", "document": document} if document else {})


def test_taxonomy_files_are_read_in_tasks(spark, tmp_path):
    for k in range(40):
        place = tmp_path / ("knowledge" if k % 4 == 0 else "compositional_skills") / f"f{k}"
        place.mkdir(parents=True)
        (place / "qna.yaml").write_text(yaml.safe_dump(leaf(k, {"repo": "r", "commit": "c", "patterns": ["*.md"]} if k % 4 == 0 else None)))
    df = remote.register(spark).read.format("taxonomy").options(files="8", strict="true").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5 and df.count() == 200
    assert df.schema == T.StructType.fromDDL(files.LEAF)
    other = files.read_taxonomy(spark, str(tmp_path), documents=lambda source: [f"text of {source['repo']}"])
    assert other.count() == 200 and {tuple(r.document) for r in other.where("domain = 'd'").collect()} == {("text of r",)}
    assert Counter(map(str, df.drop("document").collect())) == Counter(map(str, other.drop("document").collect()))
    assert files.read_taxonomy(spark, str(tmp_path / "knowledge" / "f0" / "qna.yaml")).count() == 5
    (tmp_path / "knowledge" / "f0" / "qna.yaml").write_text("[]")
    with pytest.raises(Exception, match="not a mapping"):
        df.collect()


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert files.read_taxonomy(spark, str(tmp_path)).collect() == []
