"""Model calls: one stage that is evaluated once, behind a backend that can be exchanged.

Only prompts go to Python; a call's result is written before anything else reads it (`evaluate_once`), because a second
evaluation would give other completions. Each request has an id made from step and prompt, so that a server can
recognise a retry. A row that can't be answered fails alone (`errors` names a column for reasons), and with a store each distinct
request at temperature 0 is made once.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from threading import Condition
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.operators.columns import unused
from corpusloom.operators.stages import WORK, AnswerStore, Failure, Quarantine, evaluate_once, evaluated, stage, to_arrow, work_folder

__all__ = ["WORK", "AnswerStore", "Backend", "Failure", "HttpBackend", "Options", "Quarantine", "StubBackend", "evaluate_once", "evaluated", "to_arrow", "work_folder"]


@dataclass(frozen=True)
class Options:
    """Generation options of a step."""

    temperature: float = 0.0
    max_tokens: int = 4096
    n: int = 1
    seed: int | None = None
    top_p: float | None = None
    stop: Sequence[str] = ()
    logprobs: int | None = None
    extra_body: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict[str, Any] | None) -> Options:
        values = dict(values or {})
        stop = values.pop("stop", None) or ()
        known = {k: values.pop(k) for k in list(values) if k in cls.__dataclass_fields__}
        return cls(stop=(stop,) if isinstance(stop, str) else tuple(stop), **{k: v for k, v in known.items() if v is not None})

    def body(self) -> dict[str, Any]:
        out = {"temperature": self.temperature, "max_tokens": self.max_tokens, "n": self.n, **self.extra_body}
        return out | {k: v for k, v in (("seed", self.seed), ("top_p", self.top_p), ("stop", list(self.stop)), ("logprobs", self.logprobs)) if v not in (None, [])}


class Backend(Protocol):
    """Answers a batch of prompts: n completions, or a Failure, for each. Must be serialisable; it runs in tasks."""

    def complete(self, prompts: list[str], ids: list[str], model: str | None, options: Options) -> list[list[str]]: ...

    def chat(self, messages: list[list[dict[str, str]]], ids: list[str], model: str | None, options: Options) -> list[list[str]]: ...

    def logprobs(self, prompts: list[str], ids: list[str], model: str | None, options: Options) -> list[list[dict[str, float]]]: ...

    def rewards(self, messages: list[list[dict[str, str]]], model: str | None) -> list[list[float] | None]: ...


@dataclass(frozen=True)
class StubBackend:
    """A deterministic model for tests: completions follow from the prompt alone."""

    answer: str = "{prompt}"

    def complete(self, prompts, ids, model, options):
        return [[self.answer.replace("{prompt}", p).replace("{sample}", str(k)) for k in range(options.n)] for p in prompts]

    def chat(self, messages, ids, model, options):
        return self.complete([m[-1]["content"] if m else "" for m in messages], ids, model, options)

    def logprobs(self, prompts, ids, model, options):
        return [[{w: -1.0 / (1 + len(w))} for w in p.split()[: options.max_tokens]] for p in prompts]

    def rewards(self, messages, model):
        return [[len(s) / (1 + len(s)) for s in m[-1]["content"].split("\n\n") if s] for m in messages]


class Pace:
    """How many requests may be in flight at once: one more for a round of answers, half as many when a server says that it is busy
    or an answer takes long, and none before the time it names. A worker process has one for each server."""

    def __init__(self, most: int, slow: float = 4.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.slow, self.clock = most, slow, clock
        self.limit, self.flying, self.until, self.usual, self.cut = max(1.0, most / 2), 0, 0.0, None, 0.0
        self.turn = Condition()

    def begin(self) -> float:
        """Waits for a place; the time at which it was given."""
        with self.turn:
            while self.flying >= int(self.limit) or self.clock() < self.until:
                self.turn.wait(max(0.005, min(1.0, self.until - self.clock())))
            self.flying += 1
            return self.clock()

    def end(self, began: float, busy: bool = False, wait: float = 0.0) -> None:
        """Gives a place back, after an answer or a busy server's refusal."""
        with self.turn:
            now = self.clock()
            self.flying -= 1
            took = now - began
            if not busy:
                self.usual = took if self.usual is None else min(took, 0.95 * self.usual + 0.05 * took)
            if busy or took > self.slow * max(self.usual or took, 0.05):
                if began >= self.cut:  # requests that were under way tell of the limit before
                    self.limit, self.cut = max(1.0, self.limit / 2), now
                self.until = max(self.until, now + wait)
            else:
                self.limit = min(float(self.most), self.limit + 1 / self.limit)
            self.turn.notify_all()


_paces: dict[tuple[str, int], Pace] = {}
#: What a request is refused for its content with, so that asking again is of no use.
REFUSED = {400, 413, 422}


@dataclass(frozen=True)
class HttpBackend:
    """A server with the usual completions, chat and pooling routes; bounded retries with a growing pause.

    workers: requests in flight at most; fewer while the server is busy (`Pace`). batched: whether a request may hold several prompts; None asks
    the server once (`ready`), and is no until then. A batch that is refused for its content is asked in halves; a prompt that is, is a Failure.
    """

    url: str
    key: str = ""
    workers: int = 8
    batched: bool | None = None
    rows: int = 64
    retries: int = 3
    timeout: float = 600.0

    def pace(self) -> Pace:
        return _paces.setdefault((self.url, self.workers), Pace(self.workers))

    def _post(self, route: str, body: dict, request_id: str) -> dict:
        headers = {"Content-Type": "application/json", "X-Request-Id": request_id} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        pace, data = self.pace(), json.dumps(body).encode()
        for attempt in range(self.retries + 1):
            began, busy, wait = pace.begin(), False, 0.0
            try:
                request = urllib.request.Request(f"{self.url.rstrip('/')}/{route}", data, headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError) as e:
                code = e.code if isinstance(e, urllib.error.HTTPError) else 503
                if attempt == self.retries or code < 500 and code != 429:
                    raise
                named = e.headers.get("Retry-After", "") if isinstance(e, urllib.error.HTTPError) else ""
                busy, wait = code in (429, 503), float(named) if named.isdigit() else min(30.0, 0.5 * 2**attempt)
            finally:
                pace.end(began, busy, min(wait, 30.0) if busy else 0.0)
            if not busy:
                time.sleep(wait)
        raise AssertionError

    def _row(self, call: Callable[[], Any]) -> Any:
        """What a request for one row gives; a Failure if it is refused for its content."""
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in REFUSED:
                raise
            return Failure(f"HTTP {e.code}: {e.read(500).decode(errors='replace')}")

    def models(self) -> list[str]:
        with urllib.request.urlopen(f"{self.url.rstrip('/')}/models", timeout=self.timeout) as answer:
            return [m["id"] for m in json.load(answer)["data"]]

    def takes_batches(self, model: str | None) -> bool:
        """Whether two prompts with three samples each come back as six choices."""
        try:
            return len(self._post("completions", {"model": model, "prompt": ["a", "b"], "n": 3, "max_tokens": 1, "temperature": 1.0}, "probe")["choices"]) == 6
        except (urllib.error.URLError, KeyError, ValueError):
            return False

    def _each(self, call, items: list) -> list:
        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(call, *items))

    def complete(self, prompts, ids, model, options):
        body = {"model": model, **options.body()}
        if not self.batched:
            return self._each(lambda p, i: self._row(lambda: [c["text"] for c in self._post("completions", body | {"prompt": p}, i)["choices"]]), [prompts, ids])

        def several(low: int, high: int) -> list:
            asked = prompts[low:high]
            try:
                choices = [c["text"] for c in self._post("completions", body | {"prompt": asked}, ids[low])["choices"]]
            except urllib.error.HTTPError as e:
                if e.code not in REFUSED:
                    raise
                if high - low == 1:
                    return [Failure(f"HTTP {e.code}: {e.read(500).decode(errors='replace')}")]
                middle = (low + high) // 2
                return several(low, middle) + several(middle, high)
            if len(choices) != len(asked) * options.n:
                raise ValueError(f"{len(choices)} choices for {len(asked)} prompts of {options.n}")
            return [choices[j * options.n : (j + 1) * options.n] for j in range(len(asked))]

        starts = range(0, len(prompts), self.rows)
        return [c for found in self._each(several, [starts, [min(k + self.rows, len(prompts)) for k in starts]]) for c in found]

    def chat(self, messages, ids, model, options):
        if options.n > 1 and options.temperature <= 0:
            options = Options(**{**options.__dict__, "temperature": 0.7})
        body = {"model": model, **options.body()}
        return self._each(lambda m, i: self._row(lambda: [c["message"]["content"] for c in self._post("chat/completions", body | {"messages": m}, i)["choices"]]), [messages, ids])

    def logprobs(self, prompts, ids, model, options):
        body = {"model": model, **options.body(), "logprobs": options.logprobs or 10, "n": 1}
        return self._each(lambda p, i: self._row(lambda: self._post("completions", body | {"prompt": p}, i)["choices"][0]["logprobs"]["top_logprobs"]), [prompts, ids])

    def rewards(self, messages, model):
        def one(m):
            try:
                data = self._post("pooling", {"model": model, "messages": m}, "")
            except urllib.error.URLError:
                return None
            try:
                return [float(x[1]) for x in data["data"][0]["data"]]
            except (KeyError, IndexError, TypeError, ValueError):
                return []

        return self._each(one, [messages])


_probed: dict[tuple, bool] = {}


def ready(backend: Backend, model: str | None) -> tuple[Backend, str | None]:
    """The backend and model to call, settled on the driver: a server's first model for none, and, once a server and
    model, whether it takes batches."""
    if not isinstance(backend, HttpBackend):
        return backend, model
    if model is None:
        model = backend.models()[0]
    if backend.batched is None:
        key = (backend.url, model)
        if key not in _probed:
            _probed[key] = backend.takes_batches(model)
        backend = replace(backend, batched=_probed[key])
    return backend, model


def _ask(df: DataFrame, output: str, kind: T.DataType, source: Column | str, call: Callable[[list], list], request: dict[str, Any], errors: str | None, store: AnswerStore | None) -> DataFrame:
    """A stage; by the store, if there is one and the same request has the same answer."""
    if store is not None and not request.get("options", {}).get("temperature"):
        return store.ask(df, output, kind, source, call, request, errors)
    return stage(df, output, kind, source, call, errors)


def _each_answer(found: list, take: Callable) -> list:
    return [f if isinstance(f, Failure) else take(f) for f in found]


def request_ids(step: str, asked: list) -> list[str]:
    return [str(uuid.uuid5(uuid.NAMESPACE_OID, f"{step}|{p}")) for p in asked]


def complete(df: DataFrame, prompt: str, output: str, backend: Backend, options: Options | None = None, model: str | None = None, step: str = "", errors: str | None = None, store: AnswerStore | None = None) -> DataFrame:
    """Adds an array of completions, with the stop strings given back so that tags match."""
    options, (backend, model) = options or Options(), ready(backend, model)
    tail = "".join(options.stop)

    def call(prompts: list) -> list:
        prompts = [p or "" for p in prompts]
        return _each_answer(backend.complete(prompts, request_ids(step, prompts), model, options), lambda found: [c.strip() + tail for c in found])

    return _ask(df, output, T.ArrayType(T.StringType()), prompt, call, {"route": "complete", "model": model, "options": options.body()}, errors, store)


def chat(df: DataFrame, messages: str, output: str, backend: Backend, options: Options | None = None, model: str | None = None, step: str = "", errors: str | None = None, store: AnswerStore | None = None) -> DataFrame:
    """Adds a chat answer: a string, or an array for n > 1."""
    options, (backend, model) = options or Options(), ready(backend, model)

    def call(rows: list) -> list:
        rows = [m or [] for m in rows]
        return _each_answer(backend.chat(rows, request_ids(step, rows), model, options), lambda found: found if options.n > 1 else found[0])

    kind = T.ArrayType(T.StringType()) if options.n > 1 else T.StringType()
    return _ask(df, output, kind, messages, call, {"route": "chat", "model": model, "options": options.body()}, errors, store)


def converse(df: DataFrame, messages: str, output: str, asks: Sequence[str], backend: Backend, options: Options | None = None, model: str | None = None, step: str = "", store: AnswerStore | None = None) -> DataFrame:
    """A chain of chat calls: each answer and the next of asks are appended to the messages before the next call.

    Gives the last answer as output, and all messages, with the answers, in place of the messages. Each call is
    evaluated once and written before the next.
    """
    options = options or Options()
    if options.n != 1:
        raise ValueError("a chain has one answer a call")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    for k, ask in enumerate([None, *asks]):
        if ask is not None:
            df = df.withColumn(messages, F.array_append(messages, turn("user", F.lit(ask))))
        df = evaluate_once(chat(df, messages, output, backend, options, model, f"{step}|{k}", store=store))
        df = df.withColumn(messages, F.array_append(messages, turn("assistant", F.col(output))))
    return df


def logprobs(df: DataFrame, prompt: str, output: str, backend: Backend, options: Options | None = None, model: str | None = None, step: str = "", errors: str | None = None, store: AnswerStore | None = None) -> DataFrame:
    """Adds an array with a JSON object of token log probabilities for each generated token."""
    options, (backend, model) = options or Options(), ready(backend, model)
    if options.n != 1:
        raise ValueError("log probabilities are for one sample a prompt")

    def call(prompts: list) -> list:
        prompts = [p or "" for p in prompts]
        return _each_answer(backend.logprobs(prompts, request_ids(step, prompts), model, options), lambda row: [list(t.items()) for t in row])

    kind = T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))
    maps = _ask(df, output, kind, prompt, call, {"route": "logprobs", "model": model, "options": options.body()}, errors, store)
    return maps.withColumn(output, F.transform(output, lambda x: F.to_json(x)))


def reward_messages(prompt: str, response: str, system: str | None, separator: str = "\n\n", fill: str = "<extra_0>") -> Column:
    """Messages for a process reward model: the response's steps joined, and ended, by the fill token."""
    steps = F.concat(F.array_join(F.split(F.col(response), tx.quoted(separator)), fill), F.lit(fill))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*([turn("system", F.lit(system))] if system else []), turn("user", F.col(prompt)), turn("assistant", steps))


def rewards(df: DataFrame, prompt: str, response: str, backend: Backend, output: str = "step_rewards", system: str | None = None, separator: str = "\n\n", fill: str = "<extra_0>", model: str | None = None) -> DataFrame:
    """Adds the reward of each step: zeros where the server failed, an empty array where its answer is malformed."""
    backend, model = ready(backend, model)
    asked = reward_messages(prompt, response, system, separator, fill)
    scored = stage(df, output, T.ArrayType(T.DoubleType()), asked, lambda rows: backend.rewards([m or [] for m in rows], model))
    zeros = F.transform(F.split(F.col(response), tx.quoted(separator)), lambda _: F.lit(0.0))
    return scored.withColumn(output, F.coalesce(output, zeros))


#: What a model is told for its next step.
STEPS = {
    "think": "Go on with your reasoning, one step further.",
    "reflect": "Check the reasoning so far: where could it be wrong?",
    "generate": "Now state the answer to the question itself.",
    "backtrack": "Leave this line of reasoning and begin with another one.",
}
#: A step of a reasoning model. What is no number as confidence is no step.
STEP = "current_action string, title string, content string, confidence string, next_action string"


def reason(df: DataFrame, prompt: str, output: str, backend: Backend, system: str = "", max_steps: int | None = None, model: str | None = None, retry_temperature: float = 0.7, trace: str | None = None, on_duplicate: str = "note", store: AnswerStore | None = None) -> DataFrame:
    """Adds the answer of a reasoning loop. All rows that have none make one call each a round, which is a stage of its own.

    Each call is answered by a JSON object: current_action, title, content, confidence, next_action. A step to backtrack,
    without sense, or with a confidence below one half, begins the row's conversation anew at another temperature. The loop ends at
    next_action `terminate` once the row has reflected, which is asked for otherwise; what was generated last is the answer.
    A row goes on until then, or, if max_steps is given, for so many calls: then its answer is null. trace: a column for
    (calls, restarts, duplicates, trajectory), the last being the last step of each action since the last restart. A message that a row
    has had before is counted there, or, with on_duplicate="backtrack", answered by the request to backtrack.
    """
    if on_duplicate not in ("note", "backtrack"):
        raise ValueError(f"on_duplicate is note or backtrack, not {on_duplicate}")
    backend, model = ready(backend, model)
    names = [*df.columns, output, trace or ""]
    row, s, said = (unused(n, names) for n in ("_row", "_state", "_said"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    of = lambda **c: F.struct(*[x.alias(k) for k, x in c.items()])
    first = F.array(turn("system", F.lit(system)), turn("user", F.coalesce(F.col(f"`{row}`.`{prompt}`").cast("string"), F.lit(""))))
    no_trace = F.lit(None).cast("map<string,string>")
    begun = of(messages=first, again=F.lit(False), reflected=F.lit(False), answer=F.lit(None).cast("string"), seen=F.array().cast("array<string>"), trajectory=no_trace, calls=F.lit(0), restarts=F.lit(0), duplicates=F.lit(0), done=F.lit(False))
    live = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row)).withColumn(s, begun)

    def after(d: DataFrame) -> DataFrame:
        """The states after what was said."""
        step, old = F.from_json(said, STEP), F.col(s)
        action, content = step["current_action"], F.coalesce(step["content"], F.lit(""))
        sure = F.when(step["confidence"].isNull(), 0.5).otherwise(step["confidence"].try_cast("double"))
        restart = action.isNull() | (action == "backtrack") | sure.isNull() | F.isnan(sure) | (sure < 0.5)
        message = F.concat(F.coalesce(step["title"], F.lit("")), F.lit("\n"), content)
        mark = F.sha2(message, 256)
        repeated = action.isNotNull() & F.array_contains(old["seen"], mark)
        reflected = old["reflected"] | (action == "reflect")
        answer = F.when(action == "generate", content).otherwise(old["answer"])
        following = F.coalesce(step["next_action"], F.lit("think"))
        done = ~restart & (following == "terminate") & reflected & answer.isNotNull()
        then = F.when(following == "terminate", F.when(reflected, "generate").otherwise("reflect")).otherwise(following)
        if on_duplicate == "backtrack":
            then = F.when(repeated, "backtrack").otherwise(then)
        told = F.coalesce(*[F.when(then == k, v) for k, v in STEPS.items()], F.lit(STEPS["think"]))
        kept = F.coalesce(F.map_filter(old["trajectory"], lambda k, _: k != action), F.create_map().cast("map<string,string>"))
        new = of(
            messages=F.when(restart, first).otherwise(F.concat(old["messages"], F.array(turn("assistant", message), turn("user", told)))),
            again=old["again"] | restart,
            reflected=~restart & reflected,
            answer=F.when(~restart, answer),
            seen=F.when(action.isNull(), old["seen"]).otherwise(F.array_union(old["seen"], F.array(mark))),
            trajectory=F.when(~restart, F.map_concat(kept, F.create_map(action, F.col(said)))),
            calls=old["calls"] + 1,
            restarts=old["restarts"] + restart.cast("int"),
            duplicates=old["duplicates"] + repeated.cast("int"),
            done=done,
        )
        return d.select(row, new.alias(s))

    ended: list[DataFrame] = []
    live, n = evaluated(live)
    count, again, k = n["rows"], 0, 0
    while count and k != max_steps:
        asked = []  # rows of one temperature are asked together
        for warm, some in ((False, count - again), (True, again)):
            if some:
                options = Options(temperature=retry_temperature if warm else 0.0, max_tokens=1024)
                asked.append(chat(live.where(F.col(s)["again"] == warm).withColumn("_asked", F.col(s)["messages"]), "_asked", said, backend, options, model, f"reason|{k}", store=store).drop("_asked"))
        # What was said is written before it is looked at many times.
        answered = evaluate_once(asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1]))
        states, n = evaluated(after(answered), live=~F.col(s)["done"], again=~F.col(s)["done"] & F.col(s)["again"])
        ended.append(states.where(F.col(s)["done"]))
        live, count, again, k = states.where(~F.col(s)["done"]), n["live"], n["again"], k + 1
    out = ended[0] if ended else live.limit(0)
    for e in [*ended[1:], *([live] if count else [])]:
        out = out.unionByName(e)
    traced = [of(**{c: F.col(s)[c] for c in ("calls", "restarts", "duplicates", "trajectory")}).alias(trace)] if trace else []
    kept = [F.col(row)[c].alias(c) for c in df.columns if c not in (output, trace)]
    return out.select(*kept, F.when(F.col(s)["done"], F.col(s)["answer"]).alias(output), *traced)
