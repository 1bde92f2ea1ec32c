"""The corpus pipeline on a small corpus, stage by stage."""

import re

import corpus_pipeline
from tests.llm.test_llm import brute_links, corpus, expected_dedup, table  # noqa: F401


def test_stages_keep_what_they_should(spark, corpus, tmp_path):  # noqa: F811
    rows = [(d, t, *rest) for d, t, *rest in corpus]
    docs = table(spark, rows)
    columns = docs.columns
    one = corpus_pipeline.known_language(spark, docs, "")
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert {d for d, t, *_ in rows if t and re.search(r"[a-z]{3} ", t)} <= {d for d, _ in left}
    assert not {120, 121, 122} & {d for d, _ in left}
    two = corpus_pipeline.distinct_texts(spark, one, "")
    kept = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert len(kept) == len(expected_dedup(left))
    three = corpus_pipeline.distinct_content(spark, two, "")
    found = {c for d, _, c in brute_links(kept, 5, 80) if d is not None}
    assert {r["doc_id"] for r in three.collect()} - {None} == found
    four = corpus_pipeline.mixed_sources(spark, three, "")
    assert one.columns == two.columns == three.columns == four.columns == columns
    five = corpus_pipeline.token_ids(spark, four, "")
    assert five.count() == four.count()
    assert five.where("not round_trip").count() == 0
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == five.count()


def test_tasks_hold_little_text_at_once(spark):
    """What Python and the JVM hold of a task's texts beside the heap: batches and slices of a megabyte, or of one text."""
    import pyarrow as pa

    from corpusloom.llm import common

    before = spark.conf.get(common.BATCH)
    try:
        spark.conf.set(common.BATCH, "64MB")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH) == "1m"
    finally:
        spark.conf.set(common.BATCH, before)
    sizes = [300_000] * 10 + [3_000_000, 10]
    found = list(common.slices(pa.array(["x" * n for n in sizes])))
    assert sum(n for _, n in found) == len(sizes)
    assert all(n == 1 or sum(sizes[k : k + n]) <= 1 << 20 for k, n in found)
