"""What the training-data operators share: the shared folder, written tables, running sums, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters of [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"


_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A local session that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return found.rstrip("/")


#: Bytes that go to a Python worker at once, and wait for it beside the heap, where the session has Spark's default.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "1m"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's size of batches for Python, if it is Spark's own: 64 MB, of which a task holds several on both sides."""
    if spark.conf.get(BATCH) in ("64MB", "64m", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(BATCH, BATCH_BYTES)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Deletes what the operators have written to the shared folder in this application: once results are stored."""
    forget(spark, *_made.pop(spark.sparkContext.applicationId, []))


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes df and reads it again: lineage ends here, and lost executors cost no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def unused(name: str, columns: Sequence[str]) -> str:
    """The name, with marks before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of text that a task turns into Python strings at once (a single longer text is taken whole), and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2000


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of at most SLICE_BYTES of text, or of one row."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(ends):
        upto = (ends[start - 1] if start else 0) + SLICE_BYTES
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, upto, side="right"))))
        yield start, stop - start
        start = stop


def given_back() -> None:
    """Hands memory that Arrow and malloc hold, but don't use, back: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sampled(rows: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """About `most` of the rows, chosen by a hash of id and text; rows that agree in both count once, so null or repeated ids
    and copies neither empty the sample nor swell it."""
    mark = unused("_mark", rows.columns)
    marked = rows.withColumn(mark, sample_hash(id_col, text_col))
    share = F.pmod(F.col(mark), F.lit(1 << 30)) / float(1 << 30)
    return marked.where(share < F.lit(most / max(1, rows.count()))).dropDuplicates([mark]).drop(mark)


def sample_hash(id_col: str, text_col: str) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.xxhash64(F.lit("sample"), text(id_col), text(text_col))


def map_texts(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, by: str = "text") -> DataFrame:
    """Like mapInPandas, in frames of bounded bytes of the text column: what a task holds does not follow its batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.slice(k, n).to_pandas(integer_object_nulls=True) for b in batches for k, n in slices(b[by]))
        try:
            for out in run(frames):
                yield pa.RecordBatch.from_pandas(out, schema=kind, preserve_index=False)
        finally:
            given_back()

    return df.mapInArrow(call, schema)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas, after which a task gives its memory back."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(frames)
        finally:
            given_back()

    return df.mapInPandas(call, schema)


def texts_udf(call: Callable[..., pa.Array], kind: str | T.DataType, others: int = 0):
    """A column function of texts, which come in lists of bounded bytes, with so many other columns beside them."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                text, *rest = batch if others else (batch,)
                parts = [call(text.slice(k, n).to_pylist(), *[r.slice(k, n).to_pylist() for r in rest]) for k, n in slices(text)]
                yield pa.concat_arrays(parts) if parts else call([], *[[] for _ in rest])
        finally:
            given_back()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]] if others else Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """What make gives, remembered in a worker process for later tasks, in place of what was remembered before."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def lists(values: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays of numbers as one Arrow array of lists."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([*values, np.zeros(0, kind.to_pandas_dtype())])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def squeezed(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


#: Rows that one task numbers, and buckets whose sums one task adds up.
ROWS_PER_BUCKET = 2000


def with_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str, most: int) -> DataFrame:
    """Adds the sum of value over the rows before each row of its group, in the order given by a hash of `order`, then `order`.

    A group may hold any share of the rows, at most `most`: it is cut into buckets by hash, each bucket is summed in a task
    of its own, and the bucket sums are added up alike. The columns of `order` must tell the rows of a group apart for
    the result to be the same in each run. df has no columns whose names begin with an underscore.
    """
    inside = lambda *by: Window.partitionBy(*group, *by).orderBy("_spread", *order).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_spread", F.xxhash64(*[F.col(c) for c in order])).withColumn("_value", value)
    if most <= ROWS_PER_BUCKET:
        return marked.withColumn(name, F.coalesce(F.sum("_value").over(inside()), F.lit(0)).cast("long")).select(*df.columns, name)
    buckets = -(-most // ROWS_PER_BUCKET)
    marked = marked.withColumn("_bucket", F.pmod(F.xxhash64("_spread", F.lit(len(order))), F.lit(buckets)))
    sums = marked.groupBy(*group, F.col("_bucket").alias("bucket")).agg(F.sum("_value").alias("total"))
    starts = with_running_sum(sums, group, ["bucket"], F.col("total"), "start", buckets)
    starts = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("bucket").alias("_b"), F.col("start").alias("_start"))
    summed = marked.withColumn("_inside", F.coalesce(F.sum("_value").over(inside("_bucket")), F.lit(0)))
    on = [summed[g].eqNullSafe(starts[f"_g{i}"]) for i, g in enumerate(group)] + [summed["_bucket"] == starts["_b"]]
    out = summed.join(starts, on, "left")
    return out.withColumn(name, (F.col("_inside") + F.col("_start")).cast("long")).select(*df.columns, name)


#: Wanted keys up to which a map of them is sent (16 to 32 bits a key, 64 MB at most); beyond, rows go to the join as they are.
MAPPED = 1 << 24


def maybe_wanted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, others: bool = False) -> DataFrame:
    """The rows of df whose key may be among the wanted ones: none that is is left out, few others stay. Or all the others.

    A bitmap of hashes, of a size by the number of wanted keys, is broadcast, so that rows no join needs are dropped where
    they are read. Its size is bounded; for more keys than it can tell, nothing is dropped. wanted is read twice.
    """
    n = wanted.count()
    if n > MAPPED:
        return df.where("false") if others else df
    size = max(1 << 18, 1 << (16 * n).bit_length())
    row, bucket, bits_, place_ = (unused(c, df.columns) for c in ("_row", "_bucket", "_map", "_place"))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(size))
    bits = wanted.select(place(wanted_key).alias("p")).groupBy(F.expr("int(p div 32768)").alias(bucket)).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias(bits_))
    rows = df.select(F.struct("*").alias(row), place(key).alias(place_)).withColumn(bucket, F.expr(f"int({place_} div 32768)"))
    bit = F.expr(f"cast(conv(hex(substring({bits_}, cast(({place_} % 32768) div 8 + 1 as int), 1)), 16, 10) as int)")
    is_set = bit.bitwiseAND(F.expr(f"shiftleft(1, cast({place_} % 8 as int))")) != 0
    if others:
        return rows.join(F.broadcast(bits), bucket, "left").where(~F.coalesce(is_set, F.lit(False))).select(f"{row}.*")
    return rows.join(F.broadcast(bits), bucket).where(is_set).select(f"{row}.*")


def components(links: DataFrame, where: str) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches.

    Alternates the large-star and small-star steps until the links no longer change; each round is written to
    the shared folder. Stars keep every round's size within the number of links, so a node with a great many
    neighbours costs no more than its links. Rounds are many and their joins small: they are merged where they are, not
    collected by the driver and sent out.
    """
    spark = links.sparkSession
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{where}/round0")
    mark, k = _fingerprint(edges), 0
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("merge")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        k += 1
        edges = written(small.distinct(), f"{where}/round{k}")
        now = _fingerprint(edges)
        if now == mark:
            break
        mark = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
