"""Chunks as expressions, against the splitter on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import ingest


def texts(n, seed):
    r = random.Random(seed)
    bits = ["\n\n", "\n", " ", "\n# ", "\n### ", "```\n", "\n***\n", "\n---\n", "\n____\n", "\n\n\n", "\n# \n", "  ", "\t", "é", "中", "😀", "　", "\n---\n---\n"]
    word = lambda: "".join(r.choice("abcé") for _ in range(r.choice([1, 2, 5, 9, 40, 150])))
    out = ["", " ", "\n", "a", "a" * 500, "\n\n\n\n", "# x\n# y", None, " " * 300, "\n# a" * 60, "```\n" * 40]
    while len(out) < n:
        few = r.sample(bits, r.randint(1, 5))
        out.append("".join(r.choice(few) if r.random() < 0.4 else word() for _ in range(r.randint(1, 80))))
    return out


@pytest.mark.parametrize(("size", "overlap", "separators"), [(120, 100, ingest.SEPARATORS), (60, 20, ingest.SEPARATORS), (30, 0, ingest.SEPARATORS), (200, 100, ("\n\n", " ")), (1, 0, ingest.SEPARATORS)])
def test_split_columns_equal_split_texts(spark, size, overlap, separators):
    said = texts(220, size)
    df = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    got = {r.id: r.chunks for r in ingest.with_split(df.withColumnRenamed("text", "chunks"), "chunks", size, overlap, separators).collect()}
    for k, t in enumerate(said):
        assert got[k] == (ingest.split_text(t, size, overlap, separators) if t else []), repr(t)


def test_long_texts(spark):
    r = random.Random(1)
    long = [" ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(200_000)), "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), "id int, text string")
    got = {r.id: r.chunks for r in ingest.with_split(df.withColumnRenamed("text", "chunks"), "chunks", 1040).collect()}
    assert [got[0], got[1]] == [ingest.split_text(t, 1040) for t in long]


def test_no_python_in_the_plan(spark):
    df = ingest.chunked(spark.createDataFrame([(1, "a b")], "id int, text string"), "text", 4096, 200, "chunk")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.collect() == [(1, 0, "a b")]
    assert spark.createDataFrame([(1, None)], "id int, text string").transform(lambda d: ingest.chunked(d, "text", 4096, 200)).where(F.lit(True)).count() == 0
