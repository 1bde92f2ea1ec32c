"""Chat formatting with collapse of cumulative snapshots.

A conversation that was logged again and again as it grew is there as several conversations, each the beginning of the
next. Each turn gets the rolling hash of the turns up to it (128 bits, a running sum of hashes of place, role and text);
a conversation whose hash is one of another's proper beginnings goes by an anti-join, and of equal ones the smallest id
stays. What is left is maximal, and is rendered with a turn template. Hot beginnings (a common first turn) are made
distinct before they are shuffled.

Defined results: turns are in order of turn, role, text, nulls first; a turn that is repeated in all of these counts
once; null roles are `unknown`, null texts empty, texts of any length whole; a row without an id is a conversation of one turn,
as nothing says what it belongs to; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import workspace, written

TEMPLATE = ("<|", "|>\n", "<|end|>\n")
HASH = ["h0", "h1", "h2", "h3"]


def prefixes(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place, role, text, and the rolling hash of the turns up to this one."""
    turns = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    turns = turns.withColumn("lone", F.when(F.col("conv").isNull(), F.sha2(F.to_json(F.struct("turn", "role", "text")), 256)))
    order = Window.partitionBy("conv", "lone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.withColumn("place", F.row_number().over(order))
    low = F.lit(0xFFFFFFFF)
    for k in (0, 1):
        placed = placed.withColumn(f"x{k}", F.xxhash64(F.lit(k), "place", "role", "text"))
        placed = placed.withColumn(f"a{2 * k}", F.col(f"x{k}").bitwiseAND(low)).withColumn(f"a{2 * k + 1}", F.shiftrightunsigned(f"x{k}", 32))
    upto = Window.partitionBy("conv", "lone").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("conv", "lone", "place", "role", "text", *[F.sum(f"a{k}").over(upto).alias(h) for k, h in enumerate(HASH)])


def maximal(turns: DataFrame) -> DataFrame:
    """conv, place (number of turns), copies: the conversations that begin no longer one; equal ones once."""
    last = turns.groupBy("conv", "lone").agg(F.max(F.struct("place", *HASH)).alias("z")).select("conv", "lone", "z.*")
    ends = last.groupBy("place", *HASH).agg(F.min_by(F.struct("conv", "lone"), F.struct(F.col("conv").isNull(), "conv", "lone")).alias("one"), F.count(F.lit(1)).alias("copies"))
    # A row without an id has one turn, so it has no proper beginning.
    proper = turns.where("conv is not null").join(last.select(F.col("conv").alias("c"), F.col("place").alias("n")), F.col("conv") == F.col("c")).where("place < n")
    return ends.join(proper.select("place", *HASH).distinct(), ["place", *HASH], "left_anti").select("one.conv", "one.lone", "place", "copies")


def rendered(rows: DataFrame, template: tuple[str, str, str] = TEMPLATE, **names: str) -> DataFrame:
    """conv, n_turns, copies, chat: one row for each maximal conversation."""
    turns = written(prefixes(rows, **names), f"{workspace(rows.sparkSession, 'chat')}/turns")
    kept = maximal(turns).select(F.col("conv").alias("c"), F.col("lone").alias("l"), "copies")
    piece = F.concat(F.lit(template[0]), "role", F.lit(template[1]), "text", F.lit(template[2]))
    chats = turns.join(kept, F.col("conv").eqNullSafe(F.col("c")) & F.col("lone").eqNullSafe(F.col("l"))).groupBy("conv", "lone", "copies").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"))
    return chats.select("conv", F.size("pieces").cast("long").alias("n_turns"), "copies", F.array_join("pieces.piece", "").alias("chat"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("conv", "conv_id")


SQL = r"""
WITH t AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
), c AS (
  SELECT conv_id, list('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS l
  FROM t GROUP BY conv_id, lone
), m AS (
  SELECT conv_id, l FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.l[1] = c.l[1] AND len(b.l) > len(c.l) AND b.l[1:len(c.l)] = c.l)
)
SELECT min(conv_id) AS conv_id, len(l) AS n_turns, count(*) AS copies, array_to_string(l, '') AS chat FROM m GROUP BY l
"""
