"""Flows rewritten by lineage: equal rows, fewer calls."""

from collections import Counter
from dataclasses import dataclass

import pytest

from corpusloom.functions.template import variables
from corpusloom.operators import models
from corpusloom.plans import catalog
from corpusloom.plans.flow import FLOWS, Context, Step, generate, read_flow
from corpusloom.plans.rewrite import lineage, rewritten
from tests.test_stages import CONFIGS, asked, calls  # noqa: F401


@dataclass(frozen=True)
class Counted(catalog.Rules):
    """Rules that write down what they are asked."""

    folder: str = ""

    def complete(self, prompts, ids, model, options):
        import uuid

        for p in prompts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
                f.write(p)
        return super().complete(prompts, ids, model, options)


@dataclass(frozen=True)
class Skilled(Counted):
    def complete(self, prompts, ids, model, options):
        super().complete(prompts, ids, model, options)
        return [[catalog.Skilled().complete([p], [""], model, options)[0][0]] for p in prompts]


def test_variables_of_templates():
    assert variables("{{ a }} {% if b is defined %}{{ c.x }}{% else %}{{ d }}{% endif %}{% for i in e %}{{ i.q }}{{ f }}{% endfor %}{% if not g %}1{% endif %}") == set("abcdefg")


@pytest.mark.parametrize("path", sorted(p.name for p in FLOWS.glob("*.yaml") if p.name != "recipe.yaml"))
def test_the_lineage_of_all_packaged_steps_is_known(path):
    assert all(lineage(s, Context()) is not None for s in read_flow(path))


FILTER = {"block_type": "FilterByValueBlock", "block_config": {"block_name": "language", "filter_column": "domain", "filter_value": "en", "operation": "eq"}}


def test_knowledge_flow_asks_less(spark, calls, tmp_path):  # noqa: F811
    d = "/root/testdata/sf0.001"
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("document"), F.col("source").alias("document_outline"), F.col("lang").alias("domain"), *[F.lit(v).alias(k) for k, v in catalog.EXAMPLE.items()])
    steps = [*read_flow("knowledge.yaml"), Step.of(FILTER)]
    context = lambda folder: Context(Counted(folder=str(folder)), order=("domain", "doc_id", "response"))
    (tmp_path / "plain").mkdir()
    plain = generate(df, steps, context(tmp_path / "plain"))
    new = rewritten(steps, df.columns, context(calls))
    # The filter can't pass the first step: of questions that two languages have, the first row is kept.
    assert [s.block_type for s in new][:2] == ["LLMBlock", "FilterByValueBlock"] and len(new) == len(steps)
    out = generate(df, new, context(calls))
    rows = lambda x: Counter(map(str, x.select(sorted(x.columns)).collect()))
    assert rows(out) == rows(plain) and sum(rows(out).values()) > 0
    assert asked(calls).total() < 0.85 * asked(tmp_path / "plain").total()


def test_filters_pass_what_they_may(spark):
    ask = lambda out, **more: Step.of({"block_type": "LLMBlock", "block_config": {"config_path": "p", "output_cols": [out]}, **more})
    only = lambda c, **more: Step.of({"block_type": "FilterByValueBlock", "block_config": {"filter_column": c, "filter_value": "x", "operation": "eq", **more}})
    move = lambda steps, names=("id", "text", "kind"): [s.config.get("filter_column", s.block_type) for s in rewritten(steps, names, Context(configs=CONFIGS))]
    assert move([ask("a"), ask("b"), only("kind")]) == ["kind", "LLMBlock", "LLMBlock"]
    assert move([ask("a"), ask("b"), only("a")]) == ["LLMBlock", "a", "LLMBlock"]
    assert move([ask("kind"), only("kind")]) == ["LLMBlock", "kind"]  # what it tests is made there
    assert move([ask("a", drop_duplicates=["a"]), only("kind")]) == ["LLMBlock", "kind"]
    assert move([ask("a", drop_duplicates=["a", "kind"]), only("kind")]) == ["kind", "LLMBlock"]
    assert move([ask("a"), only("text", convert_dtype="int")]) == ["LLMBlock", "text"]  # the prompt would show the number
    assert move([ask("a"), only("kind", convert_dtype="int")]) == ["kind", "LLMBlock"]
    assert move([Step.of({"block_type": "SetToMajorityValue", "block_config": {"col_name": "text"}}), ask("a"), only("kind")]) == ["SetToMajorityValue", "kind", "LLMBlock"]
    assert move([ask("a"), Step("Unknown", {}), only("kind")]) == ["LLMBlock", "Unknown", "kind"]
    renamed = Step.of({"block_type": "RenameColumns", "block_config": {"columns_map": {"kind": "text", "text": "kind"}}})
    assert move([ask("a"), renamed, only("text")]) == ["kind", "LLMBlock", "RenameColumns"]
    dropping = Step.of({"block_type": "FilterByValueBlock", "block_config": {"filter_column": "kind", "filter_value": "x", "operation": "eq"}, "drop_columns": ["kind", "a"]})
    assert move([ask("a"), dropping]) == ["kind", "LLMBlock", "RenameColumns"]


def test_columns_go_after_their_last_use(spark):
    ask = Step.of({"block_type": "LLMBlock", "block_config": {"config_path": "p", "output_cols": ["a"]}})
    last = Step.of({"block_type": "RenameColumns", "block_config": {"columns_map": {}}, "drop_columns": ["kind", "text", "a"]})
    first = Step.of({"block_type": "DuplicateColumns", "block_config": {"columns_map": {"kind": "copy"}}})
    steps = rewritten([first, ask, ask, last], ["id", "text", "kind"], Context(configs=CONFIGS))
    assert [set(s.drop_columns) for s in steps] == [{"kind"}, set(), {"text", "a"}, set()]
    df = spark.createDataFrame([(1, "t", "k")], "id long, text string, kind string")
    run = lambda steps: generate(df, steps, Context(models.StubBackend("<{prompt}>"), configs=CONFIGS)).collect()
    assert run(steps) == run([first, ask, ask, last])


def test_columns_that_nobody_wants_are_not_written(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("document"), F.col("source").alias("document_outline"), F.col("lang").alias("domain"), *[F.lit(v).alias(k) for k, v in catalog.EXAMPLE.items()])
    steps, context = read_flow("knowledge_summaries.yaml"), Context(catalog.Summaries(), order=("doc_id", "dataset_type", "response"))
    wanted = ["question", "response", "dataset_type"]
    new = rewritten(steps, df.columns, context, wanted)
    # The copy of the document is made after the summaries, and the document itself goes with its copy.
    assert [s.name for s in new][2:7] == ["long", "facts", "quotes", "keep_document", "flatten"]
    assert "document" in new[5].drop_columns and new[7].config["columns_map"] == {"summary": "document"}
    assert {"document"} <= set(next(s for s in new if s.name == "judge_faithful").drop_columns)
    rows = lambda x: Counter(map(str, x.select(wanted).collect()))
    out = generate(df, new, context)
    assert set(out.columns) == set(wanted)
    assert rows(out) == rows(generate(df, steps, context)) and sum(rows(out).values()) > 0


def test_columns_stay_for_what_reads_them(spark):
    ask = Step.of({"block_type": "LLMBlock", "block_config": {"config_path": "p", "output_cols": ["a"]}, "drop_duplicates": ["a"]})
    swap = Step("RenameColumns", {"columns_map": {"kind": "text", "text": "kind"}})
    copy = Step("DuplicateColumns", {"columns_map": {"text": "copy", "id": "other"}})
    df = spark.createDataFrame([(1, "t", "k"), (2, "t", "k"), (3, "u", "v")], "id long, text string, kind string")
    context = Context(models.StubBackend("<{prompt}>"), configs=CONFIGS, order=("id",))
    for steps in ([copy, ask, swap], [swap, copy, ask], [ask, copy, swap], [ask, Step("RenameColumns", {"columns_map": {"text": "b"}}), copy.__class__("DuplicateColumns", {"columns_map": {"b": "copy"}})]):
        every = generate(df, steps, context)
        for wanted in (["a"], ["a", "copy"], ["id"], [c for c in ("kind", "b") if c in every.columns]):
            out = generate(df, rewritten(steps, df.columns, context, wanted), context)
            assert Counter(out.select(wanted).collect()) == Counter(every.select(wanted).collect()), (steps, wanted)
