"""Runs of exact deduplication over one folder: jobs that die anywhere, and are run again."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup
from tests.llm.test_llm import expected_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


RUNS = [[(1, "aa"), (2, "a a"), (3, "b")], [(7, "aa"), (8, "c"), (9, None)], [(0, "c c"), (10, "b"), (11, "")]]
WEAK = lambda body: F.encode((F.length(body) % 2).cast("string"), "UTF-8")


def told(rows, seen):
    groups = expected_dedup(seen)
    best = {k: (min(v)[2], len(v)) for k, v in groups.items()}
    body = {d: re.sub(r"[\x20\x09-\x0d]", "", t or "") for d, t in rows}
    return {(d, *best[b], d == best[b][0]) for d, b in body.items()}


def got(out):
    return {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()}


class Died(Exception):
    pass


@pytest.mark.parametrize(("at", "call", "dies"), [("folded", 1, 0), ("admit", 2, 0), ("after", 1, 1), ("folded", 2, 1), ("after", 2, 1)])
def test_a_run_that_dies_and_is_tried_again_adds_its_rows_once(spark, tmp_path, monkeypatch, at, call, dies, digest=WEAK):
    folder, seen = f"file://{tmp_path}/state", []
    for k, rows in enumerate(RUNS):
        seen += rows
        if k == dies:
            calls, name = [], "folded" if at == "after" else at
            plain = getattr(exact_dedup, name)

            def once(*a, calls=calls, plain=plain, **b):
                calls.append(1)
                if len(calls) == call and at != "after":
                    raise Died
                out = plain(*a, **b)
                if len(calls) == call:
                    raise Died
                return out

            monkeypatch.setattr(exact_dedup, name, once)
            with pytest.raises(Died):
                exact_dedup.deduplicate(table(spark, rows), digest=digest, folder=folder)
            monkeypatch.setattr(exact_dedup, name, plain)
        assert got(exact_dedup.deduplicate(table(spark, rows), digest=digest, folder=folder)) == told(rows, seen)
    # All of it once more: nothing is counted twice.
    assert got(exact_dedup.deduplicate(table(spark, RUNS[1]), digest=digest, folder=folder)) == told(RUNS[1], seen)


def test_a_run_between_a_death_and_its_retry(spark, tmp_path, monkeypatch):
    """The dead run's rows count from its retry on, and bytes are checked against what came between."""
    folder, plain, calls = f"file://{tmp_path}/state", exact_dedup.admit, []

    def dies(*a):
        calls.append(1)
        if len(calls) == 2:
            raise Died
        return plain(*a)

    monkeypatch.setattr(exact_dedup, "admit", dies)
    with pytest.raises(Died):
        exact_dedup.deduplicate(table(spark, [(1, "x")]), digest=WEAK, folder=folder)
    monkeypatch.setattr(exact_dedup, "admit", plain)
    assert got(exact_dedup.deduplicate(table(spark, [(2, "yyy"), (3, "x")]), digest=WEAK, folder=folder)) == {(2, 2, 1, True), (3, 3, 1, True)}
    assert got(exact_dedup.deduplicate(table(spark, [(1, "x")]), digest=WEAK, folder=folder)) == {(1, 1, 2, True)}
    assert got(exact_dedup.deduplicate(table(spark, [(4, "z"), (0, "yyy")]), digest=WEAK, folder=folder)) == {(4, 4, 1, True), (0, 0, 2, True)}


def test_named_runs_may_have_equal_rows(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/state", table(spark, [(None, "a")])
    sizes = [exact_dedup.deduplicate(rows, folder=folder, run=name).first()["group_size"] for name in ("one", "two", "two", None, None)]
    assert sizes == [1, 2, 2, 3, 3]


def test_hits_come_from_the_state(spark, tmp_path):
    """What the first state emits: digests that it had, in the run or before, with the place of their content."""
    folder = f"file://{tmp_path}/state"
    for rows in RUNS:
        exact_dedup.deduplicate(table(spark, rows), folder=folder)
    hits = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/hits")
    digest = lambda t: exact_dedup.sha256(F.lit(t))
    first = {t: hits.where(F.col("digest") == digest(t)).select("locator").distinct().collect() for t in ("aa", "b", "")}
    assert all(len(v) == 1 for v in first.values())
    runs = sorted(p.name for p in (tmp_path / "state" / "contents").iterdir())
    assert [first[t][0][0].rpartition("/")[2] for t in ("aa", "b", "")] == [runs[0], runs[0], runs[1]]
    assert [spark.read.parquet(f"{folder}/contents/{r}").count() for r in runs] == [2, 2, 1]
