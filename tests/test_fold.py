"""The fold of parsed documents as expressions, against the one on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import ingest

PARSED = "file string, elements array<struct<type:string,text:string,`$ref`:string,prov:array<struct<page:long>>>>, tables array<struct<text:string,data:array<array<struct<text:string>>>>>"


def documents(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 8)))
    kinds = [*sorted(ingest.SKIPPED), *sorted(ingest.TAKEN) * 3, "other", None]
    out = []
    for k in range(n):
        elements = []
        for _ in range(r.randint(0, 25)):
            text = r.choice([None, "", word(), f"{word()}. {word()} {word()}.", " ".join(word() for _ in range(r.randint(1, 60))), "x ## References y" if r.random() < 0.1 else "z", "References" if r.random() < 0.1 else word()])
            prov = r.choice([None, [], [{"page": r.randint(1, 4)}], [{"page": 2}, {"page": 9}], [{"page": None}]])
            elements.append({"type": r.choice(kinds), "text": text, "$ref": r.choice([None, "#/tables/0", "#/tables/1", "#/tables/7", "#/x", "#/tables/a"]), "prov": prov})
        cell = lambda: r.choice([None, {"text": None}, {"text": word()}, {"text": str(r.randint(-50, 5000))}, {"text": f" {r.uniform(-5, 500):.{r.randint(0, 4)}f} "}])
        number = lambda: {"text": r.choice(["1.5", "22", " 3.25 ", "-0.001", "1e7", "123456789.5", "0.00001234", ".5", "7.", "1E-3", "0.0"])}
        tables = [{"text": r.choice([None, "", "A caption"]), "data": [[(number if r.random() < 0.9 else cell)() for _ in range(r.randint(1, 3))] for _ in range(r.randint(0, 4))]} for _ in range(r.randint(0, 3))]
        out.append((f"f{k}", r.choice([elements] * 9 + [None]), r.choice([tables] * 9 + [None])))
    return out


@pytest.mark.parametrize("by_page", [False, True])
@pytest.mark.parametrize("tokens", [1, 20, 500])
def test_folds_are_equal(spark, by_page, tokens):
    rows = documents(250, tokens + by_page)
    df = spark.createDataFrame(rows, PARSED)
    got = {r.file: r.chunks for r in ingest.folded_column(df, tokens, by_page).collect()}
    for file, elements, tables in rows:
        elements = [{**e, "prov": e["prov"] and [p for p in e["prov"]]} for e in elements or []]
        assert got[file] == ingest.fold_elements(elements, tables or [], tokens, by_page=by_page), (elements, tables)


def test_numbers_as_g_has_them(spark):
    said = [0.0, 1.0, -2.5, 100000.0, 999999.0, 1000000.0, 1234567.0, 0.0001, 0.00001, 123.456789, 1e300, -1e-300, 12.0, 0.5]
    df = spark.createDataFrame([(x,) for x in said], "x double").select("x", ingest.g_text(F.col("x")).alias("t"))
    assert [(r.x, r.t) for r in df.collect()] == [(x, format(x, "g")) for x in said]


def test_no_python_in_the_fold(spark):
    df = ingest.folded(spark.createDataFrame(documents(3, 1), PARSED), 20)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert df.columns == ["file", "place", "text"]
