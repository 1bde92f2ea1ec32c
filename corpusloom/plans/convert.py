"""Generated rows into training and evaluation sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import columns, filters, models, reshape
from corpusloom.operators.columns import unused

#: Instructions for auxiliary rows, by kind of document: our own words.
INSTRUCTIONS: dict[str, Sequence[str]] = {
    "summary_detailed": ("Give a full summary of the text above.", "Summarise the document in detail.", "Write a thorough account of what the text says.", "Cover every main point of the text in a summary."),
    "summary_extractive": ("Pick out the sentences that carry the text.", "Quote the key passages of the document.", "List the most important sentences of the text."),
    "summary_atomic_facts": ("List the single facts in the text.", "Break the document down into separate facts.", "State each fact of the text on its own line."),
}


def turn(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), tx.column(content).alias("content"))


def question(df: DataFrame) -> Column:
    return tx.strip("question") if "question" in df.columns else tx.strip(tx.question_of("output"))


def response(df: DataFrame) -> Column:
    return tx.strip("response") if "response" in df.columns else tx.strip(tx.response_of("output"))


def to_messages(df: DataFrame, system: str, key: Sequence[str]) -> DataFrame:
    """id and messages: system, user, assistant."""
    return df.select(tx.row_id(*key).alias("id"), F.array(turn("system", F.lit(system)), turn("user", question(df)), turn("assistant", response(df))).alias("messages"))


def to_columns(df: DataFrame, system: str, key: Sequence[str]) -> DataFrame:
    """id, system, user (a context before the question) and assistant as columns."""
    asked = F.concat(F.coalesce(F.concat(F.col("context"), F.lit("\n\n")), F.lit("")), question(df)) if "context" in df.columns else question(df)
    return df.withColumns({"id": tx.row_id(*key), "system": F.lit(system), "user": asked, "assistant": response(df)})


def knowledge_qa(df: DataFrame, key: Sequence[str], keep_context: bool = False) -> DataFrame:
    """Question-answer messages over documents: id, messages, metadata, and the context apart if wanted."""
    fields: dict[str, Column | str] = {"sdg_document": "document", "domain": "domain", "dataset": F.lit("document_knowledge_qa")}
    if {"raw_document", "dataset_type"} <= set(df.columns):
        fields |= {"raw_document": "raw_document", "dataset_type": "dataset_type"}
    asked = F.col("question") if keep_context else F.concat("document", F.lit("\n\n"), "question")
    out = [tx.row_id(*key).alias("id"), F.array(turn("user", asked), turn("assistant", "response")).alias("messages"), tx.as_json(**fields).alias("metadata")]
    return df.select(*out, *([F.col("document").alias("context")] if keep_context else []))


def auxiliary(df: DataFrame, order: Sequence[str] | None = None, instructions: Mapping[str, Sequence[str]] = INSTRUCTIONS) -> DataFrame | None:
    """Instruction rows from generated documents of other kinds; None without a kind column."""
    if "dataset_type" not in df.columns:
        return None
    kept = ["raw_document", "document_outline", "domain", "dataset_type", "document"]
    made = columns.keep(filters.not_equal(df, "dataset_type", "base_document"), [*kept, *(order or [])])
    # A raw document that is the document itself goes through the aggregate once.
    same = unused("_same", made.columns)
    made = made.withColumn(same, F.col("raw_document").eqNullSafe(F.col("document"))).withColumn("raw_document", F.when(~F.col(same), F.col("raw_document")))
    made = reshape.first_per_key(made, ["document"], order)
    made = made.withColumn("raw_document", F.when(F.col(same), F.col("document")).otherwise(F.col("raw_document")))
    made = columns.rename(columns.keep(made, kept), {"raw_document": "context", "document": "response"})
    picked = F
    for kind, texts in instructions.items():
        pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (tx.hash_number("response", modulus=len(texts)) + 1).cast("int"))
        picked = picked.when(F.col("dataset_type") == kind, pick)
    wanted = picked.otherwise(F.raise_error(F.concat(F.lit("no instructions for "), F.coalesce("dataset_type", F.lit("null")))).cast("string"))
    meta = tx.as_json(dataset_type="dataset_type", raw_document="context", dataset=F.concat(F.lit("document_"), "dataset_type"), domain="domain")
    asked = F.concat("context", F.lit("\n\n"), wanted)
    return made.select(tx.row_id("response", "dataset_type").alias("id"), F.array(turn("user", asked), turn("assistant", "response")).alias("messages"), meta.alias("metadata"))


#: Places of the ring of contexts that are one row of the table that rows get their distractors from.
RING = 64


def raft(df: DataFrame, p: float, documents: int = 4, key: str = "id", seed: str = "raft") -> DataFrame:
    """Puts distractor contexts before the first user turn, the row's own among them with probability p.

    Distinct contexts stand on a ring in the order of their md5 (if one md5 had two, of their sha256); a row takes those from a
    hashed place on, leaving out its own. Fewer contexts than wanted: all; none: the row's own. Places are given to digests,
    and runs of RING places, with those that the last of them look ahead to, are one row each: so a context is shuffled
    twice and a row once, however many contexts each row takes.
    """
    digests = [F.md5(F.col("context").cast("binary")).alias("_md5"), F.sha2(F.col("context").cast("binary"), 256).alias("_sha")]
    places = reshape.numbered(df.select(*digests).distinct(), ["_md5", "_sha"], "_place")
    total = max(1, places.count())
    texts = df.select(digests[1], "context").groupBy("_sha").agg(F.first("context").alias("_other"))
    places = places.select(F.col("_sha").alias("_s"), "_place").hint("merge")
    ring = texts.join(places, F.col("_sha").eqNullSafe(F.col("_s")))
    # A place is in its own run, and in those whose last places look ahead to it, around the ring.
    run = lambda place: F.floor((place + total) % total / RING)
    runs = F.array_distinct(F.array(*[run(F.col("_place") - k) for k in range(documents + 1)]))
    ring = ring.select(F.explode(runs).alias("_run"), F.struct("_place", "_sha", "_other").alias("_spot")).groupBy("_run").agg(F.collect_list("_spot").alias("_spots"))
    with_own = tx.hash_number(F.lit(seed), key, modulus=1_000_000) < int(p * 1_000_000)
    wanted = F.when(with_own, F.lit(documents - 1)).otherwise(F.lit(documents))
    rows = df.withColumn("_own", with_own).withColumn("_wanted", wanted).withColumn("_start", tx.hash_number(F.lit(seed + "-start"), key, modulus=total))
    # Only rows that show their own context take its text along.
    rows = rows.withColumn("_mine", digests[1]).withColumn("context", F.when(F.col("_own") | (F.col("_wanted") == 0) | F.lit(total == 1), F.col("context")))
    joined = rows.withColumn("_at", run(F.col("_start"))).hint("merge").join(ring, F.col("_at") == F.col("_run"), "left")
    ahead = lambda s: (s["_place"] - F.col("_start") + total) % total
    near = F.filter("_spots", lambda s: (ahead(s) <= documents) & ~s["_sha"].eqNullSafe(F.col("_mine")))
    near = F.array_sort(F.transform(near, lambda s: F.struct(ahead(s).alias("k"), s["_other"].alias("c"))))
    joined = joined.withColumn("_picks", F.transform(F.slice(near, F.lit(1), F.col("_wanted")), lambda s: s["c"])).drop("_spots")
    picks = F.coalesce(F.col("_picks"), F.array().cast("array<string>"))
    chosen = F.when(F.col("_own") | (F.size(picks) == 0), F.concat(picks, F.array("context"))).otherwise(picks)
    shuffled = F.array_sort(F.transform(chosen, lambda c: F.struct(F.md5(F.concat(F.col(key).cast("string"), c).cast("binary")).alias("o"), c.alias("c"))))
    text = F.concat(F.array_join(F.transform(shuffled, lambda s: F.concat(F.lit("Document:\n"), s["c"], F.lit("\n\n"))), "\n"), F.lit("\n\n"))
    first = F.array_position(F.transform("messages", lambda m: m["role"]), "user")
    messages = F.transform("messages", lambda m, i: F.when(i + 1 == first, F.struct(m["role"].alias("role"), F.concat(text, m["content"]).alias("content"))).otherwise(m))
    meta = F.regexp_replace("metadata", '"dataset":"([^"]*)"', f'"dataset":"$1_raft_p{p}"')
    out = joined.withColumn("messages", messages).withColumn("metadata", meta)
    return out.select(*[c for c in df.columns if c != "context"])


def pretraining(df: DataFrame) -> DataFrame:
    """The first two turns as one pretraining message."""
    text = F.concat(F.lit("<|user|>\n"), F.col("messages")[0]["content"], F.lit("\n<|assistant|>\n"), F.col("messages")[1]["content"])
    return df.withColumn("messages", F.array(turn("pretraining", text)))


def knowledge_regular(df: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    return reshape.concat([raft(knowledge_qa(df, key, keep_context=True), 0.4), auxiliary(df, order)])


def knowledge_pretraining(df: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    aux = auxiliary(df, order)
    return reshape.concat([pretraining(knowledge_qa(df, key)), None if aux is None else pretraining(aux)])


def multiple_choice(df: DataFrame, question: str = "mmlubench_question", answer: str = "mmlubench_answer", evaluation: bool = False) -> DataFrame:
    """Sane generated multiple-choice rows; for an evaluation set with choices and coded answers."""
    out = columns.literal(filters.sane_choices(df, question, answer), "dataset_type", "mcq_qa")
    return choices_format(out, question, answer) if evaluation else out


def choices_format(df: DataFrame, question: str = "mmlubench_question", answer: str = "mmlubench_answer", codes: str = "fixed") -> DataFrame:
    """question without options, four choices, subject and the answer as a code of A to D (or of the letters present)."""
    made = df.withColumns({"answer": tx.strip(tx.answer_letter(answer)), "choices": tx.options(question), "question": tx.stem(question)})
    made = filters.four_choices(made.withColumnRenamed("domain", "subject")).drop(*[c for c in (question, answer) if c not in ("question", "answer")])
    return reshape.class_codes(made, "answer", ("A", "B", "C", "D") if codes == "fixed" else None)


def training_mix(df: DataFrame, key: Sequence[str], thinking: str | None = "on", unmask: bool | None = True, replay: DataFrame | None = None, keep_context: bool = False, order: Sequence[str] | None = None, seed: int = 894375) -> DataFrame:
    """Question-answer and auxiliary rows for training, in an order by hash; a replay buffer is cut to as many rows.

    unmask: True flags these rows for pretraining, with their turns kept; False makes pretraining messages of them; None
    leaves them as they are. thinking: the switch in a system turn before question-answer rows; None for no such turn.
    Rows of the buffer are not flagged.
    """
    pretrained = lambda d: d.withColumn("unmask", F.lit(True)) if unmask else pretraining(d) if unmask is not None else d
    qa = pretrained(knowledge_qa(df, key, keep_context))
    if thinking is not None:
        qa = qa.withColumn("messages", F.concat(F.array(turn("system", F.lit(f"detailed thinking {thinking}"))), "messages"))
    aux = auxiliary(df, order)
    every = reshape.concat([qa, None if aux is None else pretrained(aux)])
    if replay is not None:
        every = models.evaluate_once(every)  # counted, and then read
        kept = replay.withColumn("unmask", F.lit(False)) if unmask and "unmask" not in replay.columns else replay
        every = reshape.concat([every, reshape.sample_exact(kept, every.count(), replay.columns[:1], seed)])
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.to_json("messages")).cast("binary"))
    return every.orderBy(place)


def fused(df: DataFrame, group: str, order: str, text: str, threshold: int = 100) -> DataFrame:
    """Appends short texts to the text before them, within a group, with a blank line.

    A text starts a new one if it has more words than the threshold, or if no text with words came before.
    """
    w = Window.partitionBy(group).orderBy(order)
    earlier = F.max(F.when(F.col(text) != "", F.lit(1)).otherwise(F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = (tx.word_count(text) > threshold) | (F.coalesce(earlier, F.lit(0)) == 0)
    marked = df.withColumn("_start", start.cast("int")).withColumn("_run", F.sum("_start").over(w))
    runs = marked.groupBy(group, "_run").agg(F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_all"))
    return runs.select(group, order, F.array_join("_all.t", "\n\n").alias(text))
