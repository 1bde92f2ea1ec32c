"""The registered queries of the core library and their SQL. Each runs one operator, or a flow, over whole tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import chat as chats
from corpusloom.functions import text as tx
from corpusloom.functions.template import compiled
from corpusloom.operators import columns, filters, models, reshape
from corpusloom.operators.parse import Parser, parse_rows
from corpusloom.plans import convert, mix
from corpusloom.plans.flow import Context, Step, generate, read_flow
from corpusloom.plans.rewrite import rewritten
from corpusloom.plans.run import Generator
from corpusloom.sources import files, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MD5 = "(('0x' || substr(md5({0}), 1, 8))::bigint % {1})"


# Columns

@query("SELECT doc_id, lang AS source, source AS lang FROM documents")
def rename_swap(spark, d):
    return columns.rename(table(spark, d, "documents").select("doc_id", "lang", "source"), {"lang": "source", "source": "lang"})


@query("SELECT doc_id, source, lang, lang AS domain FROM documents")
def duplicate_column(spark, d):
    return columns.duplicate(table(spark, d, "documents").select("doc_id", "source", "lang"), {"lang": "domain"})


@query("SELECT doc_id, lang FROM documents")
def drop_columns(spark, d):
    return columns.drop(table(spark, d, "documents"), ["text", "source", "n_chars", "not_there"])


@query("SELECT doc_id, lang FROM documents")
def keep_columns(spark, d):
    return columns.keep(table(spark, d, "documents"), ["lang", "doc_id", "not_there"])


@query("SELECT doc_id, lang || chr(10) || chr(10) || source AS lang_source FROM documents")
def combine_columns(spark, d):
    return columns.combine(table(spark, d, "documents"), ["lang", "source"], "lang_source").select("doc_id", "lang_source")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'de' THEN lang WHEN 'fr' THEN source WHEN 'es' THEN lang END AS chosen FROM documents")
def selector(spark, d):
    out = columns.select_by(table(spark, d, "documents"), {"en": "source", "de": "lang", "fr": "source", "es": "lang"}, "lang", "chosen")
    return out.select("doc_id", "chosen")


@query("SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'AUTOMOBILE' THEN 'a' ELSE 'o' END AS code FROM customer")
def populator(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    codes = {"BUILDING": {"code": "b"}, "AUTOMOBILE": {"code": "a"}, "MACHINERY": {"code": "o"}, "HOUSEHOLD": {"code": "o"}, "FURNITURE": {"code": "o"}}
    return columns.populate(df, codes, "c_mktsegment")


@query("SELECT doc_id, lang, 'knowledge' AS kind FROM documents")
def literal_column(spark, d):
    return columns.literal(table(spark, d, "documents").select("doc_id", "lang"), "kind", "knowledge")


# Filters

@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def filter_eq(spark, d):
    return filters.filter_by_value(table(spark, d, "documents").select("doc_id", "lang"), "lang", "en", "operator.eq")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def filter_in(spark, d):
    return filters.filter_by_value(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["en", "de"])


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'system')")
def filter_contains(spark, d):
    return filters.filter_by_value(table(spark, d, "conversations").select("conv_id", "turn", "role"), "role", ["user", "system"], "contains")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS double) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS double) >= 50")
def filter_ge_cast(spark, d):
    df = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return filters.filter_by_value(df, "k", 50.0, "ge", "float")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS bigint) IN (30, 35)")
def filter_eq_int(spark, d):
    df = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return filters.filter_by_value(df, "k", [30, 35], "eq", "int")


@query("SELECT doc_id, source FROM documents WHERE source > 'src5'")
def filter_callable(spark, d):
    return filters.filter_by_value(table(spark, d, "documents").select("doc_id", "source"), "source", "src5", lambda c, v: c > v)


@query("SELECT doc_id, n_words FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM documents) WHERE floor(n_words * 13 / 10) > 100")
def min_tokens(spark, d):
    df = table(spark, d, "documents").withColumn("n_words", tx.word_count("text").cast("long"))
    return filters.min_tokens(df, "text", 100).select("doc_id", "n_words")


@query("SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def not_equal(spark, d):
    return filters.not_equal(table(spark, d, "documents").select("doc_id", "lang"), "lang", "en")


# Rows

@query("SELECT doc_id, variable, value FROM (SELECT doc_id, lang, source FROM documents) UNPIVOT INCLUDE NULLS (value FOR variable IN (lang, source))")
def flatten(spark, d):
    return reshape.flatten(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "value", "variable")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def drop_duplicates_first(spark, d):
    return reshape.first_per_key(table(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT doc_id, (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS lang FROM documents")
def majority_global(spark, d):
    return reshape.majority(table(spark, d, "documents").select("doc_id", "lang"), "lang")


@query("""
WITH m AS (
  SELECT source, lang FROM documents WHERE lang IS NOT NULL GROUP BY source, lang
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1
) SELECT d.doc_id, d.source, m.lang FROM documents d LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source
""")
def majority_batch(spark, d):
    return reshape.majority(table(spark, d, "documents").select("doc_id", "source", "lang"), "lang", ["source"])


@query("SELECT doc_id, iteration, doc_id * 3 + iteration AS made FROM labels, range(3) r(iteration)")
def iterate(spark, d):
    step = lambda df: df.withColumn("made", F.col("doc_id") * 3 + F.col("iteration"))
    return reshape.iterate(table(spark, d, "labels").select("doc_id"), 3, step).withColumn("iteration", F.col("iteration").cast("long"))


@query("SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) AS ordinal, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch_id FROM benchmark")
def batches(spark, d):
    return reshape.batches(reshape.numbered(table(spark, d, "benchmark").select("item_id"), ["item_id"]), 8)


@query("SELECT item_id, ordinal FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark) WHERE ordinal >= 10 AND ordinal < 20")
def row_range(spark, d):
    return reshape.row_range(reshape.numbered(table(spark, d, "benchmark").select("item_id"), ["item_id"]), 10, 20)


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id)")
def missing_data(spark, d):
    return reshape.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"))


@query("SELECT doc_id, lang, NULL::varchar AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality::varchar FROM labels")
def concat_safe(spark, d):
    return reshape.concat([table(spark, d, "documents").select("doc_id", "lang"), None, table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))])


@query(f"""
WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS o FROM benchmark)
SELECT n.item_id FROM range(100) r(id) JOIN n ON n.o = {MD5.format("'42|' || id::varchar", '(SELECT count(*) FROM benchmark)')}
""")
def sample_replace(spark, d):
    return reshape.sample_with_replacement(table(spark, d, "benchmark").select("item_id"), 100, ["item_id"])


@query("SELECT doc_id, quality FROM labels ORDER BY md5('42|' || doc_id::varchar), doc_id LIMIT 25")
def sample_exact(spark, d):
    return reshape.sample_exact(table(spark, d, "labels").select("doc_id", "quality"), 25, ["doc_id"])


@query("SELECT d.doc_id, e.k AS icl_query, e.v AS icl_response FROM documents d, (VALUES ('q1', 'r1'), ('q2', 'r2'), ('q3', 'r3')) e(k, v)")
def icl_cross(spark, d):
    examples = spark.createDataFrame([("q1", "r1"), ("q2", "r2"), ("q3", "r3")], "icl_query string, icl_response string")
    return reshape.with_examples(table(spark, d, "documents").select("doc_id"), examples)


@query("SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, 100000) r(i) WHERE i <= len(l)")
def explode_chunks(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("line"))
    return reshape.explode_list(df, "line", "line_no").withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS lang_code FROM documents WHERE lang IS NOT NULL")
def class_encode(spark, d):
    df = table(spark, d, "documents").where("lang is not null").select("doc_id", F.col("lang").alias("lang_code"))
    return reshape.class_codes(df, "lang_code").withColumn("lang_code", F.col("lang_code").cast("long"))


@query("SELECT DISTINCT source FROM documents")
def distinct_contexts(spark, d):
    return table(spark, d, "documents").select("source").distinct()


# Text

@query(r"""
SELECT page_id, i - 1 AS position, trim(p[i], chr(32) || chr(9) || chr(10) || chr(13)) AS paragraph
FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p FROM pages), range(1, 10000) r(i) WHERE i <= len(p)
""")
def tag_parse(spark, d):
    out = parse_rows(table(spark, d, "pages").select("page_id", "html"), "html", Parser(["paragraph"], ["<p>"], ["</p>"]), ["page_id"], "position")
    return out.withColumn("position", F.col("position").cast("long"))


@query(r"""
SELECT page_id, i - 1 AS position, replace(h[i], 'th', '') AS href, replace(t[i], 'th', '') AS label
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages), range(1, 10000) r(i) WHERE i <= len(h)
""")
def regex_parse(spark, d):
    parser = Parser(["href", "label"], pattern='<a href="([^"]*)">([^<]*)</a>', cleanup=["th"])
    out = parse_rows(table(spark, d, "pages").select("page_id", "html"), "html", parser, ["page_id"], "position")
    return out.withColumn("position", F.col("position").cast("long"))


@query("SELECT d.doc_id, trim('Language: ' || lang || chr(10) || CASE WHEN quality IS NOT NULL THEN 'Quality ' || quality ELSE 'Quality ' END || chr(10) || source) AS prompt FROM documents d LEFT JOIN labels l USING (doc_id)")
def prompt_render(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    text = "Language: {{ lang }}\n{% if quality is defined %}Quality {{ quality }}{% else %}none{% endif %}\n{{ source }}{% if nothing is defined %}{{ nothing }}{% endif %}"
    return df.select("doc_id", compiled(text, df.schema).alias("prompt"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN '<|assistant|>' || chr(10) || text || '<|endoftext|>' || CASE WHEN last THEN '' ELSE chr(10) END ELSE '<|' || role || '|>' || chr(10) || text || chr(10) END, '' ORDER BY turn) || '<|assistant|>' || chr(10) AS prompt FROM (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id")
def chat_roles(spark, d):
    return conversations(spark, d).select("conv_id", chats.render("roles", "messages", is_text=False).alias("prompt"))


@query("SELECT doc_id, '<s> [INST] Be kind.' || chr(10) || chr(10) || text || ' [/INST] ' || source || '</s> [INST] ' || lang || ' [/INST]' AS prompt, '<s> [INST] ' || text || ' [/INST]' AS alone, text AS blank FROM documents")
def chat_inst(spark, d):
    turns = F.array(*[convert.turn(r, F.lit("Be kind.") if r == "system" else c) for r, c in (("system", ""), ("user", "text"), ("assistant", "source"), ("user", "lang"))])
    df = table(spark, d, "documents").withColumn("turns", turns)
    return df.select("doc_id", chats.render("inst", "turns", is_text=False).alias("prompt"), chats.render(chats.for_model("Mixtral-8x7B"), "text").alias("alone"), chats.render("blank", "text").alias("blank"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as arrays of (role, content); a conversation is one row of a training set."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    df = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return df.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, '. ') THEN ltrim(list_last(string_split(text, '. ')), chr(32) || chr(9) || chr(10) || chr(13)) ELSE text END AS answer FROM conversations")
def thinking_strip(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.after_marker("text", ". ").alias("answer"))


@query(r"""
SELECT doc_id, CASE WHEN contains(t, '?') THEN trim(string_split(t, '?')[1], chr(32) || chr(9) || chr(10) || chr(13)) || '?' ELSE '' END AS question,
  trim(CASE WHEN contains(t, '?') THEN substr(t, instr(t, '?') + 1) ELSE t END, chr(32) || chr(9) || chr(10) || chr(13)) AS response
FROM (SELECT doc_id, replace(text, '. ', '? ') AS t FROM documents)
""")
def qa_split(spark, d):
    df = table(spark, d, "documents").withColumn("t", F.replace("text", F.lit(". "), F.lit("? ")))
    return df.select("doc_id", tx.question_of("t").alias("question"), tx.response_of("t").alias("response"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '-{2,}\|', '-|', 'g'), ' {2,}\|', ' |', 'g') AS text FROM documents")
def table_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.compact_table("text").alias("text"))


@query(r"""
SELECT doc_id, CASE WHEN len(p) > 1 AND len(string_split(p[1], ' ')) < 3 THEN '**' || p[1] || '**' || array_to_string(p[2:], '.') ELSE text END AS heading
FROM (SELECT doc_id, text, string_split(text, '.') AS p FROM documents)
""")
def heading_format(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.heading("text").alias("heading"))


@query(r"SELECT page_id, CASE WHEN contains(html, '<title>') AND contains(html, '</title>') THEN trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), chr(32) || chr(9) || chr(10) || chr(13)) END AS title FROM pages")
def between_markers(spark, d):
    return table(spark, d, "pages").select("page_id", tx.between("html", "<title>", "</title>").alias("title"))


@query(f"SELECT doc_id, {MD5.format('doc_id::varchar', 10)} AS pick FROM documents")
def keyed_choice(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.hash_number("doc_id", modulus=10).alias("pick"))


# Training sets

def qa_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.concat(F.lit("What does "), "source", F.lit(" say?")).alias("question"), F.col("lang").alias("response"), F.col("source").alias("domain"), F.col("text").alias("raw_document"), F.when(F.col("doc_id") % 4 == 0, "base_document").when(F.col("doc_id") % 4 == 1, "summary_detailed").when(F.col("doc_id") % 4 == 2, "summary_extractive").otherwise("summary_atomic_facts").alias("dataset_type"), F.lit("outline").alias("document_outline"))


ID = "(substr({0},1,8)||'-'||substr({0},9,4)||'-'||substr({0},13,4)||'-'||substr({0},17,4)||'-'||substr({0},21,12))"


@query(f"SELECT {ID.format('md5(doc_id::varchar)')} AS id, 'user' AS role_1, text || chr(10) || chr(10) || 'What does ' || source || ' say?' AS content_1, 'assistant' AS role_2, lang AS content_2 FROM documents")
def knowledge_qa(spark, d):
    return flat_messages(convert.knowledge_qa(qa_rows(spark, d), ["doc_id"]))


def flat_messages(df: DataFrame, turns: int = 2) -> DataFrame:
    out = [F.get("messages", F.lit(k))[f].alias(f"{n}_{k + 1}") for k in range(turns) for n, f in (("role", "role"), ("content", "content"))]
    return df.select("id", *out)


@query(f"SELECT {ID.format('md5(doc_id::varchar)')} AS id, 'pretraining' AS role_1, '<|user|>' || chr(10) || text || chr(10) || chr(10) || 'What does ' || source || ' say?' || chr(10) || '<|assistant|>' || chr(10) || lang AS content_1 FROM documents")
def pretraining(spark, d):
    return flat_messages(convert.pretraining(convert.knowledge_qa(qa_rows(spark, d), ["doc_id"])), 1)


def _instruction_sql() -> str:
    lit = lambda t: "'" + t.replace("'", "''") + "'"
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(lit, v))}][{MD5.format('text', len(v))} + 1]" for k, v in convert.INSTRUCTIONS.items()) + " END"


@query(f"""
WITH k AS (SELECT doc_id, text, source, ['base_document', 'summary_detailed', 'summary_extractive', 'summary_atomic_facts'][doc_id % 4 + 1] AS kind FROM documents),
f AS (SELECT * FROM k WHERE kind <> 'base_document' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
SELECT {ID.format("md5(text || '|' || kind)")} AS id, 'user' AS role_1, text || chr(10) || chr(10) || {_instruction_sql()} AS content_1, 'assistant' AS role_2, text AS content_2 FROM f
""")
def auxiliary(spark, d):
    return flat_messages(convert.auxiliary(qa_rows(spark, d), ["doc_id"]))


def knowledge_rows(spark: SparkSession, d: str) -> DataFrame:
    """One context for each benchmark item, and a question for each document about one of them."""
    items = reshape.numbered(table(spark, d, "benchmark"), ["item_id"], "o").select("o", F.col("text").alias("context"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % items.count()).alias("o"))
    rows = docs.join(items, "o")
    return rows.select("id", "context", F.array(convert.turn("user", F.lit("Q")), convert.turn("assistant", F.lit("A"))).alias("messages"), F.lit('{"dataset":"x"}').alias("metadata"))


def _raft_sql(rows: str, p: int) -> str:
    """The documents put before a question, by (id, context) rows; p in millionths."""
    return f"""
rows AS ({rows}),
ring AS (SELECT context AS other, row_number() OVER (ORDER BY md5(context), context) - 1 AS place FROM (SELECT DISTINCT context FROM rows)),
m AS (SELECT count(*) AS m FROM ring),
w AS (SELECT id, context, {MD5.format("'raft|' || id", 1000000)} < {p} AS own, {MD5.format("'raft-start|' || id", '(SELECT m FROM m)')} AS start FROM rows),
spots AS (SELECT id, context, own, k, other FROM w, m, range(5) r(k) JOIN ring ON ring.place = (w.start + k) % m.m WHERE k <= m.m - 1 AND other IS DISTINCT FROM context),
picks AS (SELECT id, other AS c FROM spots QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) <= CASE WHEN own THEN 3 ELSE 4 END UNION ALL SELECT id, context FROM w WHERE own),
told AS (SELECT id, string_agg('Document:' || chr(10) || c || chr(10) || chr(10), chr(10) ORDER BY md5(id || c), c) || chr(10) || chr(10) AS docs FROM picks GROUP BY id)"""


@query(f"""
WITH b AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS o FROM benchmark), n AS (SELECT count(*) AS n FROM b),
{_raft_sql("SELECT doc_id AS id, b.text AS context FROM documents, n JOIN b ON b.o = doc_id % n.n", 400000)}
SELECT id, docs || 'Q' AS content_1, 'A' AS content_2, '{{"dataset":"x_raft_p0.4"}}' AS metadata, 'id,messages,metadata' AS columns FROM told
""")
def raft(spark, d):
    out = convert.raft(knowledge_rows(spark, d), 0.4)
    return out.select("id", F.col("messages")[0]["content"].alias("content_1"), F.col("messages")[1]["content"].alias("content_2"), "metadata", F.lit(",".join(out.columns)).alias("columns"))


@query("SELECT conv_id, CASE WHEN has THEN '' ELSE 'system:Be kind.|' END || turns AS turns FROM (SELECT conv_id, string_agg(role || ':' || CASE role WHEN 'system' THEN 'Be kind.' ELSE text END, '|' ORDER BY turn) AS turns, bool_or(role = 'system') AS has FROM conversations GROUP BY conv_id)")
def add_system(spark, d):
    df = conversations(spark, d).withColumn("messages", mix.with_system("messages", "Be kind."))
    return df.select("conv_id", joined_turns("messages").alias("turns"))


def joined_turns(messages: str):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


@query("SELECT doc_id::varchar AS id, lang, source, '2' AS kept, 4::bigint AS n_keys FROM documents")
def metadata_json(spark, d):
    """Metadata that is there, with a key that a column replaces and a nested one that stays."""
    old = F.lit('{"lang": "old", "kept": {"a": [1, 2]}, "none": null}')
    df = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array().cast("array<struct<role:string,content:string>>").alias("messages"), "lang", "source", old.alias("metadata"))
    out = mix.with_metadata(df)
    got = lambda p: F.get_json_object("metadata", p)
    return out.select("id", got("$.lang").alias("lang"), got("$.source").alias("source"), got("$.kept.a[1]").alias("kept"), F.size(F.json_object_keys("metadata")).cast("long").alias("n_keys"))


def choice_rows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    asked = F.concat(F.lit("Which size has "), "p_name", F.lit("?\nA) "), "p_brand", F.lit("\nB) "), "p_type", F.lit("\nC) "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 > 0, F.lit("\nD) none")).otherwise(F.lit("")))
    return part.select("p_partkey", asked.alias("mmlubench_question"), F.when(F.col("p_partkey") % 7 > 0, F.concat(letter, F.lit(") it is"))).otherwise(F.lit("none")).alias("mmlubench_answer"), F.col("p_type").alias("domain"))


CHOICES = """
SELECT p_partkey, p_name, p_type, p_brand, p_size, ['A', 'B', 'C', 'D', 'E'][p_partkey % 5 + 1] AS letter, p_partkey % 3 > 0 AS four FROM part WHERE p_partkey % 7 > 0
"""


@query(f"SELECT p_partkey, 'mcq_qa' AS dataset_type FROM ({CHOICES})")
def mcq_post(spark, d):
    return convert.multiple_choice(choice_rows(spark, d)).select("p_partkey", "dataset_type")


@query(f"SELECT p_partkey, 'Which size has ' || p_name || '?' AS question, p_brand || '|' || p_type || '|' || p_size || '|none' AS choices, p_type AS subject, (ascii(letter) - 65)::bigint AS answer FROM ({CHOICES}) WHERE four AND letter <> 'E'")
def mmlu_format(spark, d):
    out = convert.multiple_choice(choice_rows(spark, d), evaluation=True)
    return out.select("p_partkey", "question", F.array_join("choices", "|").alias("choices"), "subject", F.col("answer").cast("long").alias("answer"))


@query(r"""
WITH l AS (SELECT doc_id, i - 1 AS o, l[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, 100000) r(i) WHERE i <= len(l)),
s AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) > 20 OR coalesce(max(CASE WHEN t <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS start FROM l),
r AS (SELECT *, sum(start::int) OVER (PARTITION BY doc_id ORDER BY o) AS run FROM s)
SELECT doc_id, min(o) AS line_no, string_agg(t, chr(10) || chr(10) ORDER BY o) AS line FROM r GROUP BY doc_id, run
""")
def fuse_texts(spark, d):
    lines = QUERIES["explode_chunks"](spark, d)
    return convert.fused(lines, "doc_id", "line_no", "line", 20)


#: The separators of chunks as regular expressions; the last cuts between characters.
CUTS = (r"\n#{1,6} ", r"```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", " ", "")


def _chunk_sql(size: int, overlap: int) -> str:
    """SQL for chunks: a level for each separator, which cuts the items that are too long. An item's pieces are lists of texts
    and of offsets; a recursion goes from run to run, each as long as it may be, by the offsets."""
    levels = []
    for k, cut in enumerate(CUTS):
        last = k + 1 == len(CUTS)
        has = "true" if last else f"regexp_matches(text, '{cut}')"
        pieces = "string_split(text, '')" if last else f"string_split(regexp_replace(text, '({cut})', chr(1) || '\\1', 'g'), chr(1))"
        big = "false" if last else f"o[i + 2] - o[i + 1] > {size}"
        levels.append(f"""
p{k} AS MATERIALIZED (SELECT doc_id, path, list_filter({pieces}, lambda x: x <> '') AS p FROM i{k} WHERE {has}),
o{k} AS MATERIALIZED (SELECT doc_id, path, list_prepend(0, list(upto ORDER BY j)) AS o FROM (SELECT doc_id, path, j, sum(n) OVER (PARTITION BY doc_id, path ORDER BY j)::bigint AS upto FROM (SELECT doc_id, path, unnest(range(len(p))) AS j, length(unnest(p)) AS n FROM p{k})) GROUP BY doc_id, path),
r{k} AS (
  SELECT doc_id, path, 0 AS step, 0::bigint AS s, 0::bigint AS j, 0::bigint AS a, 0::bigint AS b, false AS alone, 0::bigint AS n FROM o{k}
  UNION ALL
  SELECT doc_id, path, step + 1, CASE WHEN big THEN e + 1 WHEN e < m THEN list_filter(range(s, e + 1), lambda i: o[e + 1] - o[i + 1] <= least({overlap}, {size} - (o[e + 2] - o[e + 1])))[1] ELSE e END, e + 1, s, e, big, m
  FROM (SELECT *, {'false' if last else f'e < m AND o[e + 2] - o[e + 1] > {size}'} AS big FROM (
    SELECT r.doc_id, r.path, r.step, r.s, o.o, len(o.o) - 1 AS m, coalesce(list_filter(range(r.j, len(o.o) - 1), lambda i: {big} OR o[i + 2] - o[r.s + 1] > {size})[1], len(o.o) - 1) AS e
    FROM r{k} r JOIN o{k} o USING (doc_id, path) WHERE r.step = 0 OR r.b < r.n))
),
c{k} AS (
  SELECT doc_id, list_append(path, 2 * step) AS path, array_to_string(p[a + 1:b], '') AS text, true AS done FROM r{k} JOIN p{k} USING (doc_id, path) WHERE b > a
  UNION ALL SELECT doc_id, list_append(path, 2 * step + 1), p[b + 1], false FROM r{k} JOIN p{k} USING (doc_id, path) WHERE alone
),
i{k + 1} AS MATERIALIZED (SELECT doc_id, path, text FROM c{k} WHERE NOT done UNION ALL SELECT doc_id, path, text FROM i{k} WHERE NOT ({has}))""")
    done = " UNION ALL ".join(f"SELECT doc_id, path, text FROM c{k} WHERE done" for k in range(len(CUTS)))
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_replace(regexp_replace(text, '-{{2,}}[|]', '-|', 'g'), ' {{2,}}[|]', ' |', 'g') AS text FROM documents),
i0 AS MATERIALIZED (SELECT doc_id, []::bigint[] AS path, text FROM t WHERE length(text) > {size}),{",".join(levels)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS chunk, text FROM (
  SELECT doc_id, path, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM (SELECT doc_id, []::bigint[] AS path, text FROM t WHERE length(text) <= {size} UNION ALL {done})) WHERE text <> ''
"""


@query(_chunk_sql(1040, 100))
def chunk_document(spark, d):
    return ingest.chunked(table(spark, d, "documents").select("doc_id", "text"), "text", 4096, 200, "chunk").withColumn("chunk", F.col("chunk").cast("long"))


TOKENS = "floor(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')) * 13 / 10)"
JOINED = "array_to_string({0}, chr(10) || chr(10))"


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_transform(l, lambda t: CASE WHEN len(string_split(t, '.')) > 1 AND len(string_split(string_split(t, '.')[1], ' ')) < 3 THEN '**' || string_split(t, '.')[1] || '**' || array_to_string(string_split(t, '.')[2:], '.') ELSE t END) AS l FROM l),
s AS (
  SELECT doc_id, 0::bigint AS i, []::varchar[] AS held, NULL::varchar AS one, NULL::varchar AS two, l FROM f
  UNION ALL
  SELECT doc_id, i + 1, list_append(CASE WHEN NOT fits THEN held WHEN big THEN [] ELSE held[len(held):] END, l[i + 1]), CASE WHEN fits THEN {JOINED.format("held[:len(held) - 1]")} END, CASE WHEN fits AND big THEN held[len(held)] END, l
  FROM (SELECT *, len(held) > 1 AND {TOKENS.format(JOINED.format("held"))} >= 200 AS fits, len(held) > 0 AND {TOKENS.format("coalesce(held[len(held)], '')")} >= 200 AS big FROM s WHERE i < len(l))
),
c AS (SELECT doc_id, i, 1 AS k, one AS text FROM s UNION ALL SELECT doc_id, i, 2, two FROM s),
e AS (SELECT doc_id, i, 3 AS k, {JOINED.format("held")} AS text FROM s WHERE i = len(l)),
a AS (SELECT * FROM c WHERE text <> '' UNION ALL SELECT * FROM e WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = e.doc_id AND c.text = e.text))
SELECT doc_id::varchar AS file, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS place, text FROM a
""")
def doc_fold(spark, d):
    """Each document as a parsed one, its lines the paragraphs, folded by a token budget."""
    element = lambda x: F.struct(F.lit("paragraph").alias("type"), x.alias("text"), F.lit(None).cast("string").alias("$ref"), F.array(F.struct(F.lit(1).alias("page"))).alias("prov"))
    df = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.transform(F.split("text", "\n"), element).alias("elements"), F.array().cast("array<struct<text:string,data:array<array<struct<text:string>>>>>").alias("tables"))
    return ingest.folded(df, 200)


# Models

@query("SELECT conv_id, turn, len(string_split(text, '. ')) AS n_steps, array_to_string(string_split(text, '. '), '<s>') || '<s>' AS content FROM conversations WHERE role = 'assistant'")
def prm_messages(spark, d):
    df = table(spark, d, "conversations").where("role = 'assistant'")
    m = models.reward_messages("role", "text", None, ". ", "<s>")
    return df.select("conv_id", "turn", F.size(F.split("text", "\\. ")).cast("long").alias("n_steps"), F.element_at(m, -1)["content"].alias("content"))


@query("""
WITH s AS (SELECT conv_id, turn, list_filter(string_split(text || chr(10) || chr(10), chr(10) || chr(10)), lambda x: x <> '') AS s FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, len(s) AS n_rewards, s[1].length() / (1.0::double + s[1].length()) AS first, round(list_sum(list_transform(s, lambda x: length(x) / (1.0::double + length(x)))), 3) AS total FROM s
""")
def prm_rewards(spark, d):
    df = table(spark, d, "conversations").where("role = 'assistant'")
    out = models.evaluate_once(models.rewards(df, "role", "text", models.StubBackend(), separator="\n\n", fill="\n\n"))
    total = F.aggregate("step_rewards", F.lit(0.0), lambda a, x: a + x)
    return out.select("conv_id", "turn", F.size("step_rewards").cast("long").alias("n_rewards"), F.get("step_rewards", F.lit(0)).alias("first"), F.round(total, 3).alias("total"))


@query("""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:3] AS w FROM benchmark)
SELECT item_id, array_to_string(w, '|') AS tokens, round(list_sum(list_transform(w, lambda x: -1.0::double / (1 + length(x)))), 6) AS total FROM w
""")
def logprob_json(spark, d):
    out = models.evaluate_once(models.logprobs(table(spark, d, "benchmark"), "text", "lp", models.StubBackend(), models.Options(max_tokens=3)))
    each = out.withColumn("m", F.transform("lp", lambda x: F.from_json(x, "map<string, double>")))
    total = F.aggregate("m", F.lit(0.0), lambda a, x: a + F.map_values(x)[0])
    return each.select("item_id", F.array_join(F.transform("m", lambda x: F.map_keys(x)[0]), "|").alias("tokens"), F.round(total, 6).alias("total"))


@query("SELECT item_id, k AS sample, 'sample ' || k || ' of ' || text AS answer FROM benchmark, range(3) r(k)")
def n_samples(spark, d):
    out = models.evaluate_once(models.complete(table(spark, d, "benchmark"), "text", "answer", models.StubBackend("sample {sample} of {prompt}"), models.Options(n=3)))
    return out.select("item_id", F.posexplode("answer").alias("sample", "answer")).withColumn("sample", F.col("sample").cast("long"))


@query("SELECT conv_id, 'You said: ' || list_last(list(text ORDER BY turn)) AS answer FROM conversations GROUP BY conv_id")
def chat_answers(spark, d):
    out = models.chat(conversations(spark, d), "messages", "answer", models.StubBackend("You said: {prompt}"))
    return models.evaluate_once(out).select("conv_id", "answer")


#: A word as the SQL cuts texts: its blanks are these five characters, while Python's split() knows more.
WORD = re.compile(r"[^ \t\n\f\r]+")


#: The examples of a prompt for questions, before the document.
EXAMPLES = re.compile(r"(?:\[QUESTION\][^\n]*\[END\]\n){3}")

#: The end of a judge's prompt: the pair, and what is asked for. A document may have such lines, but does not end a judge's prompt.
JUDGED = re.compile(r"\n(?:Question|Task): ([^\n]*)\n(?:Answer: ([^\n]*)\n)?\nPut [^\n]*\[Start of (\w+)\] \[End of \w+\]\.(?: \[/INST\])?$")


def first_words(text: str, n: int) -> list[str]:
    return [m[0] for m in islice(WORD.finditer(text), n)]


def last_words(text: str, n: int) -> list[str]:
    return [m[0][::-1] for m in islice(WORD.finditer(text[::-1]), n)][::-1]


def told(prompt: str, introduction: str) -> bool:
    """Whether a prompt's second line, which comes before any text of a document, begins with an introduction."""
    return prompt.startswith(introduction, prompt.find("\n") + 1)


def pairs_of(words: list[str]) -> str:
    """Questions and answers of a document's first 20 words."""
    pairs = [(" ".join(words[k : k + 4]), " ".join(words[k + 4 : k + 10])) for k in (0, 10) if len(words) > k + 4]
    return "\n".join(f"[QUESTION] What of {q}? [ANSWER] {a} [END]" for q, a in pairs)


@dataclass(frozen=True)
class Rules(models.StubBackend):
    """A model of rules: what it says follows from words in the prompt, so SQL can say it too."""

    def complete(self, prompts, ids, model, options):
        return [[self.one(p, k) for k in range(options.n)] for p in prompts]

    @staticmethod
    def one(prompt: str, sample: int) -> str:
        pair = JUDGED.search(prompt)
        if pair and pair[3] == "Answer":
            return f"[Start of Explanation] x [End of Explanation][Start of Answer] {'YES' if len(pair[1]) % 3 else 'NO'} [End of Answer]"
        if pair and pair[3] == "Score":
            return f"[Start of Feedback] x [End of Feedback][Start of Score] {1 + len(pair[2] or '') % 2} [End of Score]"
        if pair and pair[3] == "Rating":
            return "[Start of Explanation] x [End of Explanation][Start of Rating] 1.0 [End of Rating]"
        return pairs_of(first_words(Rules.document(prompt.removesuffix("[/INST]")), 20))

    @staticmethod
    def document(prompt: str) -> str:
        """What follows the first heading after the examples; nothing where the document has no text, for prompts are stripped."""
        examples = EXAMPLES.search(prompt)
        return prompt[examples.end() :].partition("\n\nDocument:")[2] if examples else ""


EXAMPLE = {f"icl_{n}": v for n, v in [("document", "A short text."), *[(f"query_{k}", f"Question {k}?") for k in (1, 2, 3)], *[(f"response_{k}", f"Answer {k}.") for k in (1, 2, 3)]]}


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, k, 'What of ' || array_to_string(w[k + 1:k + 4], ' ') || '?' AS question, array_to_string(w[k + 5:k + 10], ' ') || ' ' AS response FROM w, (VALUES (0), (10)) v(k) WHERE len(w) > k + 4),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question ORDER BY doc_id, response) = 1)
SELECT question, response FROM f WHERE length(question) % 3 <> 0 AND length(response) % 2 = 1
""")
def flow_knowledge(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.col("source").alias("document_outline"), F.col("lang").alias("domain"), *[F.lit(v).alias(k) for k, v in EXAMPLE.items()])
    return flow_columns(df, read_flow("knowledge.yaml"), Context(Rules(), order=("doc_id", "response")), "question", "response")


def flow_columns(df: DataFrame, steps: list[Step], context: Context, *wanted: str) -> DataFrame:
    """Some columns of what a flow makes: the others are not written by its stages."""
    return generate(df, rewritten(steps, df.columns, context, wanted), context).select(*wanted)


@query("SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN text ELSE 'Better: ' || text END AS chosen_response FROM conversations WHERE role = 'user'")
def flow_improve(spark, d):
    """The improvement flow with a model of rules that routes all to one kind and judges by length."""
    df = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("response"))
    return generate(df, read_flow("skills_improved.yaml"), Context(Improver())).select("conv_id", "turn", "chosen_response")


@dataclass(frozen=True)
class Improver(models.StubBackend):
    def complete(self, prompts, ids, model, options):
        return [[self.one(p)] for p in prompts]

    @staticmethod
    def one(prompt: str) -> str:
        if "_A_ to _H_" in prompt:
            return "_A_"
        answer = re.search(r"(?s)\nAnswer: (.*)\nPlan: ", prompt)
        if answer:
            return "Better: " + answer[1]
        found = re.search(r"(?s)\nResponse A: (.*)\nResponse B: ", prompt)
        if found:
            return f"[Start of Verdict] Response {'A' if len(found[1]) % 2 == 0 else 'B'} [End of Verdict]"
        return "noted"


# Further rows, readers and writers

def work(spark: SparkSession, name: str) -> str:
    return f"{models.work_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 300 AND n_chars < 2000")
def filter_all(spark, d):
    """Several filters, each of which must hold."""
    df = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    for column, value, operation in (("lang", "en", "eq"), ("n_chars", 300, "ge"), ("n_chars", 2000, "lt")):
        df = filters.filter_by_value(df, column, value, operation)
    return df


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 500")
def token_counter(spark, d):
    """A filter by a counter of tokens that the user gives: here a token is a character."""
    return filters.min_tokens(table(spark, d, "documents").select("doc_id", "text"), "text", 500, len).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT source, string_agg(doc_id || ':' || lang, ',' ORDER BY doc_id) AS rows FROM documents GROUP BY source")
def grouped_rows(spark, d):
    out = reshape.grouped_rows(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "doc_id")
    return out.select("source", F.array_join(F.transform("rows", lambda r: F.concat(r["doc_id"].cast("string"), F.lit(":"), r["lang"])), ",").alias("rows"))


@query("SELECT doc_id, text, lang, source FROM documents")
def jsonl_round_trip(spark, d):
    path = work(spark, "jsonl")
    files.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), path)
    return files.read_folder(spark, path, "doc_id long, text string, lang string, source string")


@query("SELECT doc_id, quality, toxic FROM labels")
def named_scan(spark, d):
    """A set that a resolver finds by its name."""
    files.RESOLVERS["table"] = lambda s, name: table(s, d, name)
    return files.read_named(spark, "table:labels")


@query("SELECT * FROM (VALUES (1::bigint, 'x'), (2, NULL), (3, 'z')) v(k, word)")
def literal_rows(spark, d):
    return files.rows(spark, {"k": [1, 2, 3], "word": ["x", None, "z"]}, "k long, word string")


@query("SELECT ordinal, '## ' || ordinal || chr(10) || chr(10) || '### plain' || chr(10) || chr(10) || text || chr(10) || chr(10) || '### loud' || chr(10) || chr(10) || text || '!' || chr(10) AS report FROM (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark)")
def paired_report(spark, d):
    rows = reshape.numbered(table(spark, d, "benchmark").select("item_id", "text"), ["item_id"])
    return files.paired(rows, rows.withColumn("text", F.concat("text", F.lit("!"))), "text", ("plain", "loud"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND turn >= 2")
def flow_relational(spark, d):
    """A flow without models, through batches, a ledger and what was saved."""
    steps = [
        Step("FilterByValueBlock", {"filter_column": "who", "filter_value": "user", "operation": "operator.eq"}),
        Step("RenameColumns", {"columns_map": {"who": "role"}}),
        Step("DuplicateColumns", {"columns_map": {"turn": "again"}}),
        Step("FilterByValueBlock", {"filter_column": "again", "filter_value": 2, "operation": "operator.ge"}, drop_columns=["again"]),
    ]
    seeds = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("who"))
    return Generator([steps], batch_size=200, save_every=2, key=["conv_id", "turn"]).generate(seeds, work(spark, "batches"))


@query("SELECT page_id, i - 1 AS o, t[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS t FROM pages), range(1, 10000) r(i) WHERE i <= len(t)")
def regex_block(spark, d):
    out = generate(table(spark, d, "pages").select("page_id", "html"), [Step("RegexParserBlock", {"column_name": "html", "parsing_pattern": 'href="([^"]*)"', "output_cols": ["href"]}, drop_columns=["html"])])
    w = Window.partitionBy("page_id").orderBy(F.monotonically_increasing_id())
    return out.select("page_id", (F.row_number().over(w) - 1).cast("long").alias("o"), "href")


# Training sets, continued

@query(f"SELECT {ID.format('md5(doc_id::varchar)')} AS id, 'system:Be kind.|user:What does ' || source || ' say?|assistant:' || lang AS turns FROM documents")
def messages(spark, d):
    return convert.to_messages(qa_rows(spark, d), "Be kind.", ["doc_id"]).select("id", joined_turns("messages").alias("turns"))


@query(f"SELECT {ID.format('md5(doc_id::varchar)')} AS id, 'Be kind.' AS system, text || chr(10) || chr(10) || trim(split_part(t, '?', 1), chr(32) || chr(9) || chr(10) || chr(13)) || '?' AS user, trim(substr(t, instr(t, '?') + 1), chr(32) || chr(9) || chr(10) || chr(13)) AS assistant FROM (SELECT doc_id, text, ' What of ' || source || ' ? ' || lang || '. ' AS t FROM documents)")
def message_columns(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("context"), F.concat(F.lit(" What of "), "source", F.lit(" ? "), "lang", F.lit(". ")).alias("output"))
    return convert.to_columns(df, "Be kind.", ["doc_id"]).select("id", "system", "user", "assistant")


_KIND = "['base_document', 'summary_detailed', 'summary_extractive', 'summary_atomic_facts'][doc_id % 4 + 1]"
_AUXILIARY = f"""
k AS (SELECT doc_id, text, source, {_KIND} AS kind FROM documents),
f AS (SELECT * FROM k WHERE kind <> 'base_document' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
aux AS (SELECT {ID.format("md5(text || '|' || kind)")} AS id, text || chr(10) || chr(10) || {_instruction_sql()} AS asked, text AS answer FROM f)"""
_QA_ID = ID.format("md5(doc_id::varchar)")


@query(f"""
WITH {_AUXILIARY},
q AS (SELECT {_QA_ID} AS id, text || chr(10) || chr(10) || 'What does ' || source || ' say?' AS asked, lang AS answer FROM documents UNION ALL SELECT * FROM aux)
SELECT id, 'pretraining:<|user|>' || chr(10) || asked || chr(10) || '<|assistant|>' || chr(10) || answer AS turns FROM q
""")
def knowledge_pretraining(spark, d):
    return convert.knowledge_pretraining(qa_rows(spark, d), ["doc_id"], ["doc_id"]).select("id", joined_turns("messages").alias("turns"))


@query(f"""
WITH {_AUXILIARY},
{_raft_sql(f"SELECT {_QA_ID} AS id, text AS context FROM documents", 400000)},
q AS (SELECT {_QA_ID} AS id, 'What does ' || source || ' say?' AS asked, lang AS answer FROM documents)
SELECT q.id, 'user:' || docs || asked || '|assistant:' || answer AS turns FROM q JOIN told ON q.id = told.id
UNION ALL SELECT id, 'user:' || asked || '|assistant:' || answer FROM aux
""")
def knowledge_regular(spark, d):
    return convert.knowledge_regular(qa_rows(spark, d), ["doc_id"], ["doc_id"]).select("id", joined_turns("messages").alias("turns"))


@query(f"""
WITH {_AUXILIARY},
q AS (
  SELECT {_QA_ID} AS id, 'system:detailed thinking off|user:' || text || chr(10) || chr(10) || 'What does ' || source || ' say?' || '|assistant:' || lang AS turns, true AS unmask FROM documents
  UNION ALL SELECT id, 'user:' || asked || '|assistant:' || answer, true FROM aux
), r AS (SELECT conv_id::varchar AS id, 'user:' || text AS turns, false AS unmask FROM conversations WHERE turn = 0 ORDER BY md5('894375|' || conv_id::varchar), conv_id::varchar LIMIT (SELECT count(*) FROM q))
SELECT * FROM q UNION ALL SELECT * FROM r
""")
def training_mix(spark, d):
    buffer = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("id"), F.array(convert.turn("user", "text")).alias("messages"))
    out = convert.training_mix(qa_rows(spark, d), ["doc_id"], "off", replay=buffer, order=["doc_id"])
    return out.select("id", joined_turns("messages").alias("turns"), "unmask")


@query("SELECT conv_id::varchar AS id, CASE WHEN bool_or(role = 'system') THEN '' ELSE 'system:Be kind.|' END || string_agg(role || ':' || CASE role WHEN 'system' THEN 'Be kind.' ELSE text END, '|' ORDER BY turn) AS turns, '1' AS part FROM conversations GROUP BY conv_id UNION ALL SELECT 'b' || item_id, 'system:Be kind.|user:' || text, '2' FROM benchmark")
def recipe_mixed(spark, d):
    """Two JSON Lines folders, put together by a recipe."""
    recipe, extra = mix.Recipe(), {"metadata": F.lit("{}")}
    recipe.system = "Be kind."
    one = conversations(spark, d).select(F.col("conv_id").cast("string").alias("id"), "messages", F.lit(1).alias("part"))
    two = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.array(convert.turn("user", "text")).alias("messages"), F.lit(2).alias("part"))
    for part in (one, two):
        path = work(spark, "recipe")
        files.write_jsonl(part.withColumns(extra), path)
        recipe.add(path)
    return recipe.mixed(spark).select("id", joined_turns("messages").alias("turns"), F.get_json_object("metadata", "$.part").alias("part"))


# Taxonomies

@query("""
WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS o FROM benchmark)
SELECT 'knowledge->' || item_id AS taxonomy_path, k AS part, trim(CASE k WHEN 0 THEN text ELSE 'About ' || text END, chr(32) || chr(10)) AS document, 'Q1 ' || item_id AS icl_query_1, 'A3' AS icl_response_3, NULL AS seed_question FROM b, (VALUES (0::bigint), (1)) v(k) WHERE o % 2 = 0
UNION ALL SELECT 'skills->' || item_id, 0, NULL, NULL, NULL, text FROM b WHERE o % 2 = 1
""")
def taxonomy_samples(spark, d):
    """Knowledge leaves of two documents and skill leaves, from the items of the benchmark."""
    b = reshape.numbered(table(spark, d, "benchmark").select("item_id", "text"), ["item_id"])
    know, item = F.col("ordinal") % 2 == 0, F.col("item_id").cast("string")
    pairs = F.array(*[F.struct(F.concat(F.lit(f"Q{k} "), item).alias("question"), F.lit(f"A{k}").alias("answer")) for k in (1, 2, 3)])
    leaves = b.select(
        F.concat(F.when(know, F.lit("knowledge->")).otherwise(F.lit("skills->")), item).alias("taxonomy_path"), "ordinal", F.lit("t").alias("task_description"), F.lit("d").alias("domain"),
        F.when(know, F.array("text", F.concat(F.lit("About "), "text"))).alias("document"), F.lit("o").alias("document_outline"), F.lit("c").alias("context"), F.when(~know, F.col("text")).alias("question"), F.when(~know, F.lit("a")).alias("answer"), F.when(know, pairs).alias("questions_and_answers"),
    )
    knowledge, skills = ingest.leaf_samples(leaves)
    part = F.when(F.col("document").startswith("About "), 1).otherwise(0).cast("long")
    none = F.lit(None).cast("string")
    return knowledge.select("taxonomy_path", part.alias("part"), "document", "icl_query_1", "icl_response_3", none.alias("seed_question")).unionByName(skills.select("taxonomy_path", F.lit(0).cast("long").alias("part"), none.alias("document"), none.alias("icl_query_1"), none.alias("icl_response_3"), "seed_question"))


# Models, continued

_CONFIG = {"system": "", "introduction": "", "principles": "", "examples": "", "start_tags": [""], "end_tags": [""]}


@query("SELECT doc_id, trim(CASE lang WHEN 'en' THEN 'Text: ' || source WHEN 'de' THEN 'Text auf Deutsch: ' || source ELSE lang || ': ' || source END) AS output FROM documents")
def conditional_render(spark, d):
    configs = {"en": _CONFIG | {"generation": "Text: {{ source }}"}, "de": _CONFIG | {"generation": "Text auf Deutsch: {{ source }}"}, "any": _CONFIG | {"generation": "{{ lang }}: {{ source }}"}}
    step = Step("ConditionalLLMBlock", {"config_paths": {"en": "en", "de": "de", "All": "any"}, "selector_column_name": "lang", "output_cols": ["output"]})
    return generate(table(spark, d, "documents").select("doc_id", "lang", "source"), [step], Context(models.StubBackend(), configs=configs)).select("doc_id", "output")


@query("SELECT item_id, text || '[END]' AS answer FROM (SELECT item_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM benchmark)")
def stop_restored(spark, d):
    out = models.evaluate_once(models.complete(table(spark, d, "benchmark"), "text", "answer", models.StubBackend(), models.Options.of({"stop": "[END]"})))
    return out.select("item_id", F.col("answer")[0].alias("answer"))


@dataclass(frozen=True)
class Talk(models.StubBackend):
    """A chat model whose answer tells the number of messages and the last one; asked to reason, it goes through the steps."""

    def chat(self, messages, ids, model, options):
        return [[self.one(m, options)] for m in messages]

    @staticmethod
    def one(m: list[dict], options: models.Options) -> str:
        if m[0]["role"] != "system":
            return f"{len(m)}: {m[-1]['content']}"
        step = sum(x["role"] == "assistant" for x in m)
        sure = 0.9 if options.temperature or len(m[1]["content"]) % 2 else 0.1  # unsure at first of every other prompt
        actions = ["think", "generate", "reflect", "generate"]
        return json.dumps({"current_action": actions[min(step, 3)], "title": f"step {step}", "content": f"{step} {options.temperature} {m[1]['content']}", "confidence": sure, "next_action": ["generate", "terminate", "generate", "terminate"][min(step, 3)]})


@query("SELECT item_id, 'user:' || text || '|assistant:1: ' || text || '|user:Refine it.|assistant:3: Refine it.|user:As JSON.|assistant:5: As JSON.' AS turns, '5: As JSON.' AS answer FROM benchmark")
def conversation_chain(spark, d):
    df = table(spark, d, "benchmark").select("item_id", F.array(convert.turn("user", "text")).alias("messages"))
    return models.converse(df, "messages", "answer", ["Refine it.", "As JSON."], Talk()).select("item_id", joined_turns("messages").alias("turns"), "answer")


@query("SELECT item_id, '3 ' || CASE WHEN length(text) % 2 = 1 THEN '0.0' ELSE '0.7' END || ' ' || text AS answer FROM benchmark")
def reasoning(spark, d):
    return models.evaluate_once(models.reason(table(spark, d, "benchmark"), "text", "answer", Talk(), "Think.")).select("item_id", "answer")


@dataclass(frozen=True)
class Skilled(models.StubBackend):
    """A model of rules for the skill flows."""

    def complete(self, prompts, ids, model, options):
        return [[self.one(p, k) for k in range(options.n)] for p in prompts]

    @staticmethod
    def one(prompt: str, sample: int) -> str:
        task = re.search(r"(?s).*\nTask: (.*?)(?:\nAnswer: .*)?\n\nPut ", prompt)
        if "[Start of Response]" in prompt:
            return f"[Start of Response] Done: {task[1]} [End of Response]"
        if "1 to 3." in prompt:
            return f"[Start of Evaluation] x [End of Evaluation][Start of Score] {1 + len(task[1]) % 3} [End of Score]"
        if "Give 1 or 0." in prompt:
            return f"[Start of Evaluation] x [End of Evaluation][Start of Score] {1 - len(task[1]) % 2}.0 [End of Score]"
        if "Write a new context" in prompt:
            seed = re.search(r"(?s)\[Start of Context\](.*?)\[End of Context\]", prompt)[1]
            return f"[Start of Context] {sample % 3} {seed} [End of Context]"
        if "tasks about the context" in prompt:
            given = re.search(r"(?s).*Context:\n(.*?)\n\nPut ", prompt)[1]
            return "".join(f"[Start of Question] {'Ask' * k} {given}? [End of Question]" for k in (1, 2, 3))
        seed = re.search(r"(?s)\[Start of Question\](.*?)\[End of Question\]", prompt)[1]
        return "".join(f"[Start of Question] {w}: {seed} [End of Question]" for w in ("First", "Second"))


def skill_rows(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.lit("Do it.").alias("task_description"), tx.strip("text").alias("seed_question"), F.lit("Done.").alias("seed_response"), F.concat(F.lit("ctx "), F.col("item_id").cast("string")).alias("seed_context"))


@query("""
WITH q AS (SELECT DISTINCT w || ': ' || trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS question FROM benchmark, (VALUES ('First'), ('Second')) v(w))
SELECT question, 'Done: ' || question AS response FROM q WHERE length(question) % 2 = 0 AND 1 + length(question) % 3 >= 2
""")
def flow_skills(spark, d):
    return generate(skill_rows(spark, d), read_flow("skills.yaml"), Context(Skilled(), order=("item_id",))).select("question", "response")


@query("""
WITH q AS (SELECT s || ' ctx ' || item_id AS context, repeat('Ask', k::int) || ' ' || s || ' ctx ' || item_id || '?' AS question FROM benchmark, range(3) a(s), range(1, 4) b(k))
SELECT context || chr(10) || chr(10) || question AS question, 'Done: ' || question AS response FROM q WHERE length(question) % 2 = 0 AND 1 + length(question) % 3 >= 2
""")
def flow_grounded(spark, d):
    return generate(skill_rows(spark, d), read_flow("skills_grounded.yaml"), Context(Skilled(), order=("item_id",))).select("question", "response")


@dataclass(frozen=True)
class Summaries(Rules):
    """The model of rules, which writes summaries and says what kind a document is."""

    @staticmethod
    def one(prompt: str, sample: int) -> str:
        said = Summaries.summary(prompt)
        return Rules.one(prompt, sample) if said is None else said

    @staticmethod
    def summary(prompt: str) -> str | None:
        if told(prompt, "Say what kind of document"):
            return "A" if len(prompt) % 3 else "B"
        for introduction, word in (("Summarise the document", "Long"), ("List the facts", "Facts"), ("List the sentences", "Quotes")):
            if told(prompt, introduction):
                # Prompts are stripped: without a text nothing follows the title.
                text = prompt.removesuffix("[/INST]").partition("Title:")[2].partition("\n\n")[2]
                return " ".join([word, *last_words(text, 14)])
        return None


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, text FROM documents),
s AS (
  SELECT doc_id, kind, CASE WHEN kind = 'base_document' THEN w ELSE list_concat([word], list_slice(w, greatest(1, len(w) - 13), len(w))) END AS w
  FROM w, (VALUES ('summary_detailed', 'Long'), ('summary_extractive', 'Quotes'), ('summary_atomic_facts', 'Facts'), ('base_document', '')) v(kind, word)
),
p AS (SELECT doc_id, kind, 'What of ' || array_to_string(w[k + 1:k + 4], ' ') || '?' AS question, array_to_string(w[k + 5:k + 10], ' ') || ' ' AS response FROM s, (VALUES (0), (10)) v(k) WHERE len(w) > k + 4),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question ORDER BY doc_id, kind, response) = 1)
SELECT question, response, kind AS dataset_type FROM f WHERE length(question) % 3 <> 0 AND length(response) % 2 = 1
""")
def flow_summaries(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.col("source").alias("document_outline"), F.col("lang").alias("domain"), *[F.lit(v).alias(k) for k, v in EXAMPLE.items()])
    return flow_columns(df, read_flow("knowledge_summaries.yaml"), Context(Summaries(), order=("doc_id", "dataset_type", "response")), "question", "response", "dataset_type")


# Batches, errors, answers that are kept

@query("""
WITH b AS (SELECT doc_id, source, lang, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents),
m AS (SELECT batch, lang FROM (SELECT batch, lang, count(*) AS n FROM b WHERE lang IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY n DESC, lang) = 1)
SELECT doc_id, source, m.lang AS language FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY batch, source ORDER BY doc_id) = 1) f LEFT JOIN m USING (batch)
""")
def batched_majority(spark, d):
    """Batches of 64 documents: each batch's majority language, and its first document of each source."""
    steps = [Step("SetToMajorityValue", {"col_name": "lang"}), Step("RenameColumns", {"columns_map": {"lang": "language"}}, drop_duplicates=["source"])]
    df = table(spark, d, "documents").select("doc_id", "source", "lang")
    return Generator([steps], Context(order=("doc_id",)), 32, 2, ["doc_id"]).generate(df, scratch(spark, "batches"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{models.work_folder(spark)}/{name}-{uuid.uuid4().hex}"


PLAIN = {"system": "", "introduction": "", "principles": "", "examples": "", "generation": "{{ source }} {{ lang }} {{ doc_id }}", "start_tags": ["<"], "end_tags": [">"]}


@dataclass(frozen=True)
class Picky(models.StubBackend):
    """Answers a prompt with its length; refuses those whose length is a multiple of three."""

    def complete(self, prompts, ids, model, options):
        return [models.Failure(f"refused: {len(p)}") if len(p) % 3 == 0 else [f"<{len(p)}>"] for p in prompts]


@query("""
WITH p AS (SELECT doc_id, source, lang, CASE WHEN lang = 'fr' THEN 'no prompt for fr' WHEN n % 3 = 0 THEN 'refused: ' || n END AS reason
  FROM (SELECT *, length(trim(source || ' ' || lang || ' ' || doc_id)) AS n FROM documents))
SELECT coalesce(reason, 'none') AS reason, count(*) AS n, min(doc_id) AS first_doc FROM p GROUP BY 1
""")
def quarantined_rows(spark, d):
    """Documents that a step could not do, by reason, and those that it did."""
    quarantine = models.Quarantine(scratch(spark, "quarantine"))
    prompts = {k: "plain" for k in ("en", "de", "es")}
    ask = Step("ConditionalLLMBlock", {"block_name": "ask", "config_paths": prompts, "selector_column_name": "lang", "output_cols": ["answer"]})
    done = generate(table(spark, d, "documents").select("doc_id", "source", "lang"), [ask], Context(Picky(), configs={"plain": PLAIN}, quarantine=quarantine))
    bad = quarantine.rows(spark).select("reason", F.get_json_object("row", "$.doc_id").cast("long").alias("doc_id"))
    return done.select(F.lit("none").alias("reason"), "doc_id").unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, upper(source || ' ' || lang) AS answer, (SELECT count(DISTINCT source || ' ' || lang) FROM documents) AS asked FROM documents")
def stored_answers(spark, d):
    """Each distinct prompt is asked once, however many rows have it and however often they are run."""
    store, df = models.AnswerStore(scratch(spark, "answers")), table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("prompt"))
    for _ in range(2):
        out = models.complete(df, "prompt", "answer", Shouting(), store=store)
    kept = spark.read.option("recursiveFileLookup", "true").parquet(store.folder).agg(F.count(F.lit(1)).alias("asked"))
    return out.select("doc_id", F.col("answer")[0].alias("answer")).join(F.broadcast(kept))


@dataclass(frozen=True)
class Shouting(models.StubBackend):
    def complete(self, prompts, ids, model, options):
        return [[p.upper()] for p in prompts]


@query("""
WITH s AS (SELECT conv_id, turn, text, length(text) % 4 AS k FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN k = 0 THEN 'b' ELSE 'a' END AS answer, CASE k WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS calls, CASE WHEN k = 0 THEN 1 ELSE 0 END AS restarts, CASE k WHEN 2 THEN 2 ELSE 0 END AS duplicates, CASE k WHEN 3 THEN 'generate,reflect,think' WHEN 2 THEN 'generate,reflect,think' ELSE 'generate,reflect' END AS actions FROM s
""")
def reasoning_trace(spark, d):
    """Reasoning in rounds: rows that begin anew, repeat themselves, or need more rounds than others."""
    df = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    out = models.reason(df, "text", "answer", Paths(), "Reason.", trace="t")
    return out.select("conv_id", "turn", "answer", F.col("t.calls").alias("calls"), F.col("t.restarts").alias("restarts"), F.col("t.duplicates").alias("duplicates"), F.array_join(F.array_sort(F.map_keys("t.trajectory")), ",").alias("actions"))


@dataclass(frozen=True)
class Paths(models.StubBackend):
    """Four ways to reason, by the length of the prompt."""

    def chat(self, messages, ids, model, options):
        return [[self.one(m, bool(options.temperature))] for m in messages]

    @staticmethod
    def one(m: list[dict], again: bool) -> str:
        say = lambda action, then, content="", sure=0.9: json.dumps({"current_action": action, "title": "", "content": content, "confidence": sure, "next_action": then})
        k, n = sum(x["role"] == "assistant" for x in m), len(m[1]["content"]) % 4
        end = [say("generate", "reflect", "b" if again else "a"), say("reflect", "terminate", "so")]
        ways = {0: end if again else [say("think", "think", "1"), say("think", "think", "2", 0.2)], 1: end, 2: [say("think", "think", "same"), say("think", "generate", "same"), say("generate", "reflect", "a"), say("reflect", "terminate", "a")], 3: [say("think", "generate", "1"), *end]}
        return ways[n][min(k, len(ways[n]) - 1)]


@query("""
WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, lang, k, 'What of ' || array_to_string(w[k + 1:k + 4], ' ') || '?' AS question, array_to_string(w[k + 5:k + 10], ' ') || ' ' AS response FROM w, (VALUES (0), (10)) v(k) WHERE len(w) > k + 4),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question ORDER BY doc_id, response) = 1)
SELECT question, response FROM f WHERE length(question) % 3 <> 0 AND length(response) % 2 = 1 AND lang = 'en'
""")
def flow_rewritten(spark, d):
    """The question-answer flow for one language, whose filter stands last and is moved before the judges."""
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.col("source").alias("document_outline"), F.col("lang").alias("domain"), *[F.lit(v).alias(k) for k, v in EXAMPLE.items()])
    context = Context(Rules(), order=("doc_id", "response"))
    steps = [*read_flow("knowledge.yaml"), Step("FilterByValueBlock", {"filter_column": "domain", "filter_value": "en", "operation": "eq"})]
    return flow_columns(df, steps, context, "question", "response")


# Packaged flows with models of rules

@dataclass(frozen=True)
class Ruled(models.StubBackend):
    """A model of rules for the flows of one step, and for the reasoned one."""

    def complete(self, prompts, ids, model, options):
        return [[self.one(p)] for p in prompts]

    @staticmethod
    def one(prompt: str) -> str:
        if (said := Summaries.summary(prompt)) is not None:
            return said
        if told(prompt, "Answer from the document."):
            words = first_words(prompt.partition("document says.\n\n")[2].rpartition("\n\nWrite one question")[0], 20)
            return f"<think>[QUESTION] no [ANSWER] no</think>{pairs_of(words)}"
        if found := re.search(r"(?s)Text: (.*)\nFeeling:", prompt):
            return ("joy", "anger", "fear", "sadness", "love", "surprise")[len(found[1]) % 6]
        if found := re.search(r"(?s)Context: (.*)\nTask: (.*)\nAnswer: (.*?)(?: ?\[/INST\])?$", prompt):
            return f"{found[2]} in {found[1]}: {found[3]}"
        if found := re.search(r"(?s)Document:\n(.*)\n\nUse \[QUESTION\]", prompt):
            w = first_words(found[1], 4)
            return f"[QUESTION] {' '.join(w[:3])} [ANSWER] A) {w[3]} [END]" if len(w) > 3 else ""
        return Rules.one(prompt, 0)


@query("SELECT prompt, ['joy', 'anger', 'fear', 'sadness', 'love', 'surprise'][length(prompt) % 6 + 1] AS output, min(doc_id) AS doc_id FROM (SELECT doc_id, source || ' ' || lang AS prompt FROM documents) GROUP BY prompt")
def flow_annotation(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("prompt"), F.lit("What is felt?").alias("simple_task_description"))
    return generate(df, read_flow("annotation_simple.yaml"), Context(Ruled(), order=("doc_id",))).select("prompt", "output", "doc_id")


@query("SELECT output, min(doc_id) AS doc_id FROM (SELECT doc_id, source || ' in ' || lang || ': ' || n_chars % 10 AS output FROM documents) GROUP BY output")
def flow_grounded_simple(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.lit("Write.").alias("task_description"), F.col("lang").alias("seed_context"), F.col("source").alias("seed_question"), (F.col("n_chars") % 10).cast("string").alias("seed_response"))
    return generate(df, read_flow("grounded_simple.yaml"), Context(Ruled(), order=("doc_id",))).select("output", "doc_id")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT array_to_string(w[1:3], ' ') AS question, 'A) ' || w[4] AS answer, doc_id FROM w WHERE len(w) > 3 QUALIFY row_number() OVER (PARTITION BY question ORDER BY doc_id) = 1
""")
def flow_choices(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.col("lang").alias("domain"))
    out = flow_columns(df, read_flow("multiple_choice.yaml"), Context(Ruled(), order=("doc_id",)), "mmlubench_question", "mmlubench_answer", "doc_id")
    return out.select(F.col("mmlubench_question").alias("question"), F.col("mmlubench_answer").alias("answer"), "doc_id")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, kind, CASE WHEN kind = 'base_document' THEN w ELSE list_concat([word], list_slice(w, greatest(1, len(w) - 13), len(w))) END AS w
  FROM w, (VALUES ('summary_detailed', 'Long'), ('summary_extractive', 'Quotes'), ('summary_atomic_facts', 'Facts'), ('base_document', '')) v(kind, word)
)
SELECT doc_id, kind AS dataset_type, 'What of ' || array_to_string(w[k + 1:k + 4], ' ') || '?' AS question, array_to_string(w[k + 5:k + 10], ' ') || ' ' AS response FROM s, (VALUES (0), (10)) v(k) WHERE len(w) > k + 4
""")
def flow_reasoned(spark, d):
    """Summaries and the document itself, each asked about by a model that thinks before it answers."""
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.col("source").alias("document_outline"), F.col("lang").alias("domain"))
    return flow_columns(df, read_flow("knowledge_reasoned.yaml"), Context(Ruled()), "doc_id", "dataset_type", "question", "response")
