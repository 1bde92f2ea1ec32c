"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Each document is a point: log size, bytes per code point, language and source. A node of the tree that is to hold k
shards is cut along its widest dimension at the weighted median, the place where the bytes on the left are to those
on the right as floor(k/2) to ceil(k/2), until every leaf is one shard of the target bytes. Medians are exact to
TOLERANCE of a shard: they come from histograms of BINS bins of the whole table that narrow in on the place, a round for
all nodes of a level at once. Nodes are a table like the rows; the driver only sees whether a round has left any.

Every coordinate is followed by a fixed pseudorandom part (from the text's checksum, then the id), so equal
coordinates, a hot source or a large group of equal texts are cut like any others.

Defined results: a null text has size 16 and checksum 0; texts of any length count whole; null metadata is a value of its own;
rows that agree in id and text go to one shard; an empty table gives no rows; further columns, whatever their names,
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, with_running_sum, workspace, written

BINS = 2048
#: A part of a node with no more rows than this is looked at key by key.
EXACT_ROWS = 16_384
#: Of the bytes of a shard; a median is looked for until it is this exact.
TOLERANCE = 1e-3
#: Nodes whose table is sent to every executor; more are joined by a shuffle.
SENT = 100_000
DIMS = ("by_size", "by_width", "by_lang", "by_source")


def points(docs: DataFrame, id_col: str, text_col: str, meta: tuple[str, str]) -> DataFrame:
    """id, size, crc and a key of 62 bits for each dimension: 30 bits of coordinate, 32 bits to tell equals apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda c: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise((F.crc32(F.col(c).cast("string")) + 1) / F.lit(2.0**32))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), (F.octet_length(text) / F.greatest(F.char_length(text), F.lit(1)) - 1).alias("width"), *[name(c).alias(f"m{i}") for i, c in enumerate(meta)])
    tie = F.shiftright("crc", 16) * F.lit(65536) + F.pmod(F.xxhash64("id", "crc"), F.lit(65536))
    key = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * F.lit(2.0**30 - 1)) * F.lit(2**32) + tie
    found = (F.log2(F.col("size").cast("double")) / 40, F.col("width") / 3, F.col("m0"), F.col("m1"))
    return base.select("id", "size", "crc", *[key(x).cast("long").alias(d) for d, x in zip(DIMS, found, strict=True)])


def widest(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, k, dim, low, high, goal, n of the nodes (node, k) that are to be cut: where, and after how many bytes."""
    ends = [f(d).alias(f"{name}{i}") for i, d in enumerate(DIMS) for f, name in ((F.min, "low"), (F.max, "high"))]
    found = rows.groupBy("node").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"), *ends).join(nodes.where("k > 1"), "node")
    lows, highs = (F.array(*[f"{name}{i}" for i in range(len(DIMS))]) for name in ("low", "high"))
    width = F.array(*[F.shiftright(f"high{i}", 32) - F.shiftright(f"low{i}", 32) for i in range(len(DIMS))])
    dim = F.array_position(width, F.array_max(width)).cast("int")
    return found.withColumn("dim", dim).select("node", "k", "dim", F.element_at(lows, F.col("dim")).alias("low"), (F.element_at(highs, F.col("dim")) + 1).alias("high"), F.expr("total * double(k div 2) / k").alias("goal"), "n")


def medians(rows: DataFrame, nodes: DataFrame, leaf_bytes: float, many: bool, where: str) -> DataFrame:
    """node, k, dim, at: the first key on the right of each node's cut."""
    sent = (lambda d: d) if many else F.broadcast
    step = F.when(F.col("n") <= EXACT_ROWS, 1).otherwise(F.expr(f"greatest(1L, (high - low + {BINS - 1}) div {BINS})"))
    todo, done, k = written(nodes.withColumn("step", step.cast("long")), f"{where}/todo0"), None, 0
    upto = Window.partitionBy("node").orderBy("bin")
    while not todo.isEmpty():
        keyed = rows.join(sent(todo.select("node", "dim", "low", "high", "step")), "node").withColumn("key", F.element_at(F.array(*DIMS), F.col("dim"))).where("key >= low and key < high")
        bins = keyed.groupBy("node", F.expr("(key - low) div step").alias("bin")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("m"), F.min("key").alias("start"), (F.max("key") + 1).alias("end"))
        summed = bins.withColumn("sum", F.sum("s").over(upto)).join(sent(todo), "node")
        # The part that is looked at next is no wider than its keys: one value of a dimension is left behind at once.
        start, end = F.col("start"), F.col("end")
        close = (F.col("s") <= TOLERANCE * leaf_bytes) | (F.col("step") == 1)
        at = F.when(close, F.when(F.expr("sum - goal <= goal - (sum - s)"), end).otherwise(start))
        looked = summed.where("sum >= goal and sum - s < goal").select("node", "k", "dim", start.alias("low"), end.alias("high"), F.expr("goal - (sum - s)").alias("goal"), F.col("m").alias("n"), at.alias("at"))
        k += 1
        looked = written(looked, f"{where}/looked{k}")
        found = looked.where("at is not null").select("node", "k", "dim", "at")
        done = found if done is None else done.union(found)
        todo = looked.where("at is null").drop("at").withColumn("step", step.cast("long"))
    return done if done is not None else nodes.select("node", "k", "dim", F.col("low").alias("at")).where("false")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, size, crc, shard, slot. The number of shards is given, or follows from the target bytes of a leaf."""
    spark = docs.sparkSession
    where = workspace(spark, "kd")
    rows = written(points(docs, id_col, text_col, meta).withColumn("node", F.lit(0)), f"{where}/level0")
    size = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-size // target_bytes))
    # A node is named by its first shard, and is to hold k of them.
    nodes = spark.range(1).select(F.lit(0).alias("node"), F.lit(shards).alias("k"))
    for level in range(1, (shards - 1).bit_length() + 1):
        cuts = written(medians(rows, widest(rows, nodes), size / shards, shards > SENT, f"{where}/level{level}"), f"{where}/cuts{level}")
        sent = cuts if shards > SENT else F.broadcast(cuts)
        right = F.element_at(F.array(*DIMS), F.col("dim")) >= F.col("at")
        cut = rows.join(sent, "node", "left").withColumn("node", F.when(right, F.expr("int(node + k div 2)")).otherwise(F.col("node")))
        rows = written(cut.select("id", "size", "crc", *DIMS, "node"), f"{where}/rows{level}")
        halves = F.when(F.col("k") > 1, F.array(F.struct("node", F.expr("int(k div 2)").alias("k")), F.struct(F.expr("int(node + k div 2)").alias("node"), F.expr("int(k - k div 2)").alias("k")))).otherwise(F.array(F.struct("node", "k")))
        nodes = written(nodes.select(F.inline(halves).alias("node", "k")), f"{where}/nodes{level}")
    placed = rows.select("id", "size", "crc", F.col("node").alias("shard"))
    most = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return with_running_sum(placed, ["shard"], ["id", "crc"], F.lit(1), "slot", most)


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), shards=40)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
