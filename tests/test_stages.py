"""Model stages: batches as scopes, errors of single rows, the answer store, rounds of reasoning, counts by observation."""

import json
from collections import Counter
from dataclasses import dataclass

import pytest

from corpusloom.operators import models
from corpusloom.operators.models import AnswerStore, Failure, Options, Quarantine, StubBackend
from corpusloom.plans import run
from corpusloom.plans.flow import Context, EmptyResult, FlowError, Metrics, Step, block, generate
from corpusloom.plans.run import Generator
from tests.test_flows import Thinker, step

PROMPT = {"system": "", "introduction": "", "principles": "", "examples": "", "generation": "{{ text }}", "start_tags": ["<"], "end_tags": [">"]}
ASK = {"block_type": "LLMBlock", "block_config": {"block_name": "ask", "config_path": "p", "output_cols": ["said"]}}
CONFIGS = {"p": PROMPT}


@dataclass(frozen=True)
class Picky(StubBackend):
    """Writes down what it is asked; fails for good, for now, or altogether on prompts that say so."""

    folder: str = ""

    def complete(self, prompts, ids, model, options):
        import os
        import uuid

        before = Counter(open(f"{self.folder}/{f}", encoding="utf-8").read() for f in os.listdir(self.folder))
        out = []
        for p in prompts:
            if "poison" in p:
                out.append(Failure("no poison"))
            elif "later" in p and not before[p]:
                out.append(Failure("not now", final=False))
            else:
                out.append([f"<{p.upper()}>"] * options.n)
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
                f.write(p)
        if any("crash" in p and not before[p] for p in prompts):
            raise RuntimeError("the server is gone")
        return out


def asked(folder):
    return Counter(p.read_text(encoding="utf-8") for p in folder.iterdir())


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


# Batches

VOTE = [{"block_type": "SetToMajorityValue", "block_config": {"col_name": "route"}}, {"block_type": "DuplicateColumns", "block_config": {"columns_map": {"route": "kept"}}, "drop_duplicates": ["text"]}]


def voted(rows, size):
    """What batches of rows (id, text, route) give: the first row of each text in a batch, with the batch's majority."""
    out = []
    for k in range(0, len(rows), size):
        batch = rows[k : k + size]
        counts = Counter(r[2] for r in batch)
        most = min(counts, key=lambda v: (-counts[v], v))
        seen = set()
        for i, text, _ in batch:
            if text not in seen:
                seen.add(text)
                out.append((i, text, most))
    return sorted(out)


@pytest.mark.parametrize("waves", [1, 2, 64])
def test_rows_do_not_depend_on_waves(spark, tmp_path, monkeypatch, waves):
    rows = [(i, f"t{i % 7}", "ab"[(i * i // 10) % 3 == 0]) for i in range(85)]
    monkeypatch.setattr(run, "WAVES", waves)
    df = spark.createDataFrame(rows, "id long, text string, route string")
    made = Generator([[Step.of(s) for s in VOTE]], Context(order=("id",)), 10, key=["id"]).generate(df, f"file://{tmp_path}/out")
    assert made.columns == ["id", "text", "route", "kept"]
    assert sorted((r.id, r.text, r.route) for r in made.collect()) == voted(rows, 10)


@dataclass(frozen=True)
class Voter(StubBackend):
    """Fails on some prompts until a file is there."""

    there: str = ""

    def complete(self, prompts, ids, model, options):
        import os

        if any("t5" in p for p in prompts) and not os.path.exists(self.there):
            raise RuntimeError("not yet")
        return [[f"<{p[-1]}>"] for p in prompts]


def test_rows_do_not_depend_on_halving_and_resume(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "WAVES", 2)
    rows = [(i, "t5" if i == 23 else f"t{i % 4}", "") for i in range(60)]
    steps = [Step.of(s) for s in [ASK, {"block_type": "RenameColumns", "block_config": {"columns_map": {"said": "route"}}}, VOTE[0]]]
    df = spark.createDataFrame(rows, "id long, text string, route string").drop("route")
    gen = Generator([steps], Context(Voter(there=str(tmp_path / "there")), configs=CONFIGS), 10, key=["id"])
    first = gen.generate(df, f"file://{tmp_path}/out")
    assert 20 not in {r.id for r in first.collect()} and first.count() == 50
    (tmp_path / "there").write_text("")
    made = gen.generate(df, f"file://{tmp_path}/out")
    want = voted([(i, f"{i} {t}", t[-1]) for i, t, _ in rows], 10)
    assert sorted((r.id, r.route) for r in made.collect()) == [(i, m) for i, _, m in want]


def test_a_step_that_loses_the_batch_is_an_error(spark, tmp_path):
    @block("OnlyText")
    def only(df, config, gen, context):
        return df.select("text")

    df = table(spark, ["a", "b"])
    gen = Generator([[Step("OnlyText", {})]], Context(), 1, key=["id"])
    with pytest.raises(EmptyResult):  # all batches failed
        gen.generate(df, f"file://{tmp_path}/out")
    with pytest.raises(FlowError, match="loses id"):
        generate(df, [Step("OnlyText", {})], Context(scope=("id",)))
    assert generate(df, [Step("OnlyText", {})]).count() == 2


def test_the_batch_column_is_named_as_nothing_else(spark, tmp_path):
    df = table(spark, ["a", "b", "c"])
    steps = [Step("DuplicateColumns", {"columns_map": {"text": "_batch"}}), Step("RenameColumns", {"columns_map": {"_batch": "__BATCH"}})]
    made = Generator([steps], Context(), 2, key=["id"]).generate(df, f"file://{tmp_path}/out")
    assert made.columns == ["id", "text", "__BATCH"] and made.count() == 3


# Errors

def test_one_bad_row_is_one_row_lost(spark, tmp_path, calls):
    df = table(spark, ["a", "b", "poison", "c"])
    quarantine = Quarantine(f"file://{tmp_path}/bad")
    context = Context(Picky(folder=str(calls)), configs=CONFIGS, quarantine=quarantine)
    out = generate(df, [Step.of(ASK)], context)
    assert sorted(r.said for r in out.collect()) == ["A", "B", "C"] and out.columns == ["id", "text", "said"]
    (bad,) = quarantine.rows(spark).collect()
    assert (bad.step, bad.reason, json.loads(bad.row)["id"]) == ("1 ask", "no poison", 2)
    with pytest.raises(Exception, match="no poison"):
        generate(df, [Step.of(ASK)], Context(Picky(folder=str(calls)), configs=CONFIGS))


def test_rows_without_a_prompt_and_templates_without_a_column(spark, tmp_path, calls):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id long, text string, kind string")
    conditional = Step.of({"block_type": "ConditionalLLMBlock", "block_config": {"block_name": "pick", "config_paths": {"x": "p"}, "output_cols": ["said"], "selector_column_name": "kind"}})
    quarantine = Quarantine(f"file://{tmp_path}/bad")
    out = generate(df, [conditional], Context(Picky(folder=str(calls)), configs=CONFIGS, quarantine=quarantine))
    assert [r.id for r in out.collect()] == [1]
    assert sorted((json.loads(r.row)["id"], r.reason) for r in quarantine.rows(spark).collect()) == [(2, "no prompt for y"), (3, "no prompt for null")]
    with pytest.raises(Exception, match="no prompt for"):
        generate(df, [conditional], Context(Picky(folder=str(calls)), configs=CONFIGS))
    absent = Quarantine(f"file://{tmp_path}/absent")
    with pytest.raises(EmptyResult):
        generate(df.drop("text"), [Step.of(ASK)], Context(Picky(folder=str(calls)), configs=CONFIGS, quarantine=absent, missing="quarantine"))
    assert Counter(r.reason for r in absent.rows(spark).collect()) == {"no column text": 3}


def test_the_quarantine_of_batches_is_that_of_finished_jobs(spark, tmp_path, calls):
    df = table(spark, [f"t{i}" if i % 5 else f"poison {i}" for i in range(20)])
    gen = Generator([[Step.of(ASK)]], Context(Picky(folder=str(calls)), configs=CONFIGS, quarantine=Quarantine(f"file://{tmp_path}/bad")), 4, key=["id"])
    out = gen.generate(df, f"file://{tmp_path}/out")
    assert out.count() == 16
    assert sorted(json.loads(r.row)["id"] for r in gen.quarantined(spark, f"file://{tmp_path}/out").collect()) == [0, 5, 10, 15]
    gen.generate(df, f"file://{tmp_path}/out")
    assert gen.quarantined(spark, f"file://{tmp_path}/out").count() == 4


# The store

def test_each_prompt_is_asked_once(spark, tmp_path, calls):
    store, backend = AnswerStore(f"file://{tmp_path}/store", rows=2, chunk=1), Picky(folder=str(calls))
    df = table(spark, ["a", "b", "a", "a", "c", None, "", "crash d"])
    ask = lambda d, **o: models.complete(d, "text", "said", backend, Options(**o), store=store)
    out = ask(df)
    assert sorted((r.id, r.said[0]) for r in out.collect()) == [(0, "<A>"), (1, "<B>"), (2, "<A>"), (3, "<A>"), (4, "<C>"), (5, "<>"), (6, "<>"), (7, "<CRASH D>")]
    # What is asked again is what failed; a null is not an empty text, though it is asked as one.
    assert asked(calls) == {"a": 1, "b": 1, "c": 1, "": 2, "crash d": 2}
    assert ask(df).count() == 8 and ask(table(spark, ["a", "b"])).count() == 2
    assert asked(calls).total() == 7
    assert ask(table(spark, ["b", "new"])).count() == 2 and asked(calls)["new"] == 1 and asked(calls)["b"] == 1
    assert ask(table(spark, ["b"]), max_tokens=7).count() == 1 and asked(calls)["b"] == 2  # other options
    assert len(ask(table(spark, ["b", "b"]), temperature=0.5).collect()) == 2 and asked(calls)["b"] == 4  # not the same answer each time


def test_failures_are_tried_again_and_final_ones_are_not(spark, tmp_path, calls):
    store, backend = AnswerStore(f"file://{tmp_path}/store"), Picky(folder=str(calls))
    out = models.complete(table(spark, ["a", "poison", "poison", "later"]), "text", "said", backend, errors="why", store=store)
    got = sorted(((r.id, r.said and r.said[0], r.why) for r in out.collect()), key=lambda r: r[0])
    assert got == [(0, "<A>", None), (1, None, "no poison"), (2, None, "no poison"), (3, "<LATER>", None)]
    assert asked(calls) == {"a": 1, "poison": 1, "later": 2}
    with pytest.raises(Exception, match="no poison"):
        models.complete(table(spark, ["poison"]), "text", "said", backend, store=store).collect()


@dataclass(frozen=True)
class Down(StubBackend):
    def complete(self, prompts, ids, model, options):
        if any(p == "b" for p in prompts):
            raise ConnectionError("down")
        return super().complete(prompts, ids, model, options)


def test_what_was_answered_before_a_failure_stays_answered(spark, tmp_path, calls):
    store = AnswerStore(f"file://{tmp_path}/store", chunk=1, attempts=2)
    df = table(spark, ["a", "b", "c"])
    with pytest.raises(Exception, match="down"):
        models.complete(df, "text", "said", Down(), store=store).collect()
    out = models.complete(df, "text", "said", Picky(folder=str(calls)), store=store)
    assert sorted(r.said[0] for r in out.collect()) == ["<B>", "a", "c"] and asked(calls) == {"b": 1}


def test_a_hot_prompt_and_no_rows(spark, tmp_path, calls):
    store, backend = AnswerStore(f"file://{tmp_path}/store"), Picky(folder=str(calls))
    out = models.complete(table(spark, ["hot"] * 300 + ["b"]), "text", "said", backend, store=store)
    assert out.count() == 301 and asked(calls) == {"hot": 1, "b": 1}
    assert models.complete(table(spark, ["x"]).where("id > 5"), "text", "said", backend, store=store).collect() == []
    assert asked(calls).total() == 2


def test_other_stages_use_the_store(spark, tmp_path):
    store = AnswerStore(f"file://{tmp_path}/store")
    df = spark.createDataFrame([("x", [("user", "hi")])] * 2, "text string, messages array<struct<role:string,content:string>>")
    assert {r.said for r in models.chat(df, "messages", "said", StubBackend("re {prompt}"), store=store).collect()} == {"re hi"}
    assert {r.said for r in models.chat(df, "messages", "said", StubBackend("other"), store=store).collect()} == {"re hi"}
    plain = models.logprobs(df, "text", "p", StubBackend()).collect()
    assert models.logprobs(df, "text", "p", StubBackend(), store=store).collect() == plain == models.logprobs(df, "text", "p", StubBackend(), store=store).collect()


def test_a_flow_with_a_store_asks_nothing_twice(spark, tmp_path, calls):
    context = Context(Picky(folder=str(calls)), configs=CONFIGS, store=AnswerStore(f"file://{tmp_path}/store"), quarantine=Quarantine(f"file://{tmp_path}/bad"))
    for _ in range(2):
        out = generate(table(spark, ["a", "a", "b", "poison"]), [Step.of(ASK)], context)
        assert sorted(r.said for r in out.collect()) == ["A", "A", "B"]
    assert asked(calls) == {"a": 1, "b": 1, "poison": 2}


# Reasoning

def script_says(script, steps=10_000):
    """answer, calls, restarts, duplicates, actions of the trajectory, by plain loops."""
    seen, k, calls, restarts, duplicates = set(), 0, 0, 0, 0
    reflected, answer, trajectory = False, None, {}
    while calls < steps:
        said = script[min(k, len(script) - 1)] if k < len(script) or len(script) else ""
        calls += 1
        k += 1
        try:
            s = json.loads(said)
            action, sure = s["current_action"], float(s.get("confidence", 0.5))
        except (ValueError, KeyError, TypeError):
            s, action, sure = None, None, 0.0
        if s is not None:
            message = f"{s.get('title', '')}\n{s.get('content', '')}"
            duplicates += message in seen
            seen.add(message)
        if s is None or action == "backtrack" or sure < 0.5:
            k, restarts, reflected, answer, trajectory = 0, restarts + 1, False, None, {}
            continue
        trajectory[action] = said
        reflected |= action == "reflect"
        answer = s["content"] if action == "generate" else answer
        if s["next_action"] == "terminate" and reflected and answer is not None:
            return answer, calls, restarts, duplicates, trajectory
    return None, calls, restarts, duplicates, trajectory


@dataclass(frozen=True)
class Scripts(StubBackend):
    """A script for each prompt; after a restart, at the other temperature, another one."""

    scripts: tuple = ()
    again: tuple = ()

    def chat(self, messages, ids, model, options):
        own = self.again if options.temperature else self.scripts
        out = []
        for row in messages:
            lines = own[int(row[1]["content"])]
            k = sum(m["role"] == "assistant" for m in row)
            out.append([lines[min(k, len(lines) - 1)]])
        return out


def test_rows_reason_in_rounds(spark):
    long = tuple(step("think", "think", content=f"c{k}") for k in range(40)) + (step("generate", "terminate", content="late"), step("reflect", "terminate"))
    scripts = (long, (step("reflect", "generate"), step("generate", "terminate", content="soon")), ("no json",), (step("think", "think", 0.1),), (step("think", "think"), step("think", "backtrack"), step("backtrack", "think")))
    again = tuple((step("generate", "think", content=f"again {k}"), step("reflect", "terminate", content="r")) for k in range(len(scripts)))
    df = spark.createDataFrame([(str(k), k) for k in range(len(scripts))], "p string, _state int")
    out = {r.p: r for r in models.reason(df, "p", "answer", Scripts(scripts=scripts, again=again), trace="trace").collect()}
    assert {k: r.answer for k, r in out.items()} == {"0": "late", "1": "soon", "2": "again 2", "3": "again 3", "4": "again 4"}
    for k in ("0", "1"):
        answer, calls, restarts, duplicates, trajectory = script_says(scripts[int(k)])
        assert out[k].trace.asDict() == {"calls": calls, "restarts": restarts, "duplicates": duplicates, "trajectory": trajectory} and out[k].answer == answer
    assert out["0"].trace.calls == 42 and out["2"].trace.restarts == 1 and out["4"].trace.duplicates == 2 and set(out["4"].trace.trajectory) == {"generate", "reflect"}
    assert {r._state for r in out.values()} == {0, 1, 2, 3, 4}


def test_a_cap_is_asked_for_and_duplicates_may_lead_back(spark):
    df = spark.createDataFrame([("p",)], "p string")
    stuck = models.reason(df, "p", "a", Thinker(script=(step("think", "think"),)), max_steps=3, trace="t").first()
    assert stuck.a is None and (stuck.t.calls, stuck.t.duplicates) == (3, 2)

    @dataclass(frozen=True)
    class Told(StubBackend):
        def chat(self, messages, ids, model, options):
            told = messages[0][-1]["content"]
            return [[step("backtrack", "think", content="b") if told == models.STEPS["backtrack"] else step("think", "think")]]

    assert models.reason(df, "p", "a", Told(), max_steps=3, trace="t").first().t.restarts == 0
    assert models.reason(df, "p", "a", Told(), max_steps=3, trace="t", on_duplicate="backtrack").first().t.restarts == 1
    assert models.reason(df.where("false"), "p", "a", Told()).collect() == []
    with pytest.raises(ValueError, match="on_duplicate"):
        models.reason(df, "p", "a", Told(), on_duplicate="x")


# Counts

def test_steps_are_counted_by_the_jobs_that_write_them(spark, calls, caplog):
    df = spark.createDataFrame([(1, "a 5"), (2, "b x"), (3, "c 7"), (4, "c 7")], "id long, text string")
    steps = [Step.of(s) for s in [
        ASK,
        {"block_type": "RegexParserBlock", "block_config": {"block_name": "parse", "column_name": "said", "parsing_pattern": "[A-Z] (.)", "output_cols": ["n"]}},
        {"block_type": "FilterByValueBlock", "block_config": {"block_name": "six", "filter_column": "n", "filter_value": 6, "operation": "operator.ge", "convert_dtype": "int"}},
        {"block_type": "RenameColumns", "block_config": {"block_name": "name", "columns_map": {"n": "m"}}, "drop_duplicates": ["m"]},
    ]]
    metrics = Metrics()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    with caplog.at_level("INFO", "corpusloom"):
        out = generate(df, steps, Context(Picky(folder=str(calls)), configs=CONFIGS, metrics=metrics))
    writes = len(jobs.getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.m for r in out.collect()] == [7]
    assert [(m["step"], m["rows_in"], m["rows_out"], m["dropped"], m["unconverted"]) for m in metrics.table()] == [
        ("1 ask", 4, 4, 0, 0), ("2 parse", 4, 4, 0, 0), ("3 six", 4, 2, 2, 1), ("4 name", 2, 1, 1, 0)]
    assert "3 six" in caplog.text and writes <= 3  # two written results, one of them by a shuffle
    generate(df, steps, Context(Picky(folder=str(calls)), configs=CONFIGS, metrics=metrics))
    assert metrics.table()[0]["rows_in"] == 8


def test_counts_of_failed_jobs_are_left_out(spark, calls):
    metrics, df = Metrics(), table(spark, ["poison"])
    context = Context(Picky(folder=str(calls)), configs=CONFIGS, metrics=metrics)
    with pytest.raises(Exception, match="no poison"):
        generate(df, [Step.of(ASK)], context)
    assert metrics.table() == [] and not metrics.pending()
    generate(table(spark, ["a"]), [Step.of(ASK)], context)
    assert metrics.table()[0]["rows_out"] == 1


def test_an_empty_flow_is_found_without_a_look(spark, calls):
    df = table(spark, ["a"])
    none = Step.of({"block_type": "FilterByValueBlock", "block_config": {"filter_column": "text", "filter_value": "z", "operation": "eq"}})
    context = Context(Picky(folder=str(calls)), configs=CONFIGS)
    with pytest.raises(EmptyResult, match="ask"):
        generate(df, [none, Step.of(ASK)], context)
    assert asked(calls).total() == 0
    with pytest.raises(EmptyResult, match="the flow"):
        generate(df, [Step.of(ASK), none], context)
    assert generate(df, [none], context, fail_on_empty=False).count() == 0
