"""Flows over documents without a text, and with texts that look like a prompt's parts, against their SQL."""

import duckdb
import pytest

from corpusloom.plans import catalog
from tests.test_catalog import table

WORDS = " ".join(f"w{k}{'x' * (k % 5)}" for k in range(40))
BLANK = [None, "", " \n\t \r\n", "\n"]
ODD = [
    WORDS, "one", "a b c d e", WORDS + " \n\n", "\n\n " + WORDS,
    f"Title: t\n\n{WORDS} Title: u", f"Summarise the document. {WORDS}", f"{WORDS} List the facts Say what kind of document",
    f"{WORDS}\n\nWrite one question now", f"says document says.\n\n{WORDS}", f"{WORDS} [/INST]",
    f"Document:\n{WORDS}", f"{WORDS}\n\nDocument:", f"a b c\n\nDocument:\nd e f g {WORDS}",
    f"{WORDS} Question: w1 w2\nAnswer: no\n\nPut", f"Task: {WORDS}", f"{WORDS} [Start of Feedback] [Start of Rating] [Start of Explanation] verdict",
    WORDS.replace("w3", "n b　s\x0bv "),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(k, t, lang, source) for k, (t, lang, source) in enumerate((t, lang, source) for lang, source in (("en", "src1"), (None, None), ("en", "two\nlines"), ("de", "")) for t in BLANK + ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def same_as_sql(spark, folder: str, name: str) -> None:
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        theirs = table(c.execute(catalog.ORACLE[name]).df())
    ours = table(catalog.QUERIES[name](spark, folder).toPandas())
    assert list(ours.columns) == list(theirs.columns) and len(theirs)
    assert ours.equals(theirs)


@pytest.mark.parametrize("name", ["flow_reasoned", "flow_summaries", "flow_knowledge", "flow_rewritten"])
def test_flows_over_odd_texts_equal_their_sql(spark, odd, name):
    same_as_sql(spark, odd, name)
