"""Compression of vectors into codes by member-resident Lloyd rounds.

Vectors are cut into PARTS equal consecutive parts, and each part position has a codebook of its own. A part is a row
that lives with the owner of its entry: rows are partitioned by (position, entry, salt), where salts cut an entry of
very many members into owners of some MEMBERS rows. In a round each owner's task sums up the members that reside with
it, so that a few sums for each task are all that is shuffled; the entries that follow go back to the tasks, which
assign their members again. Members that keep their entry stay in their owner's files; only those that change
it migrate, in the shuffle that places them with their new owners. Arithmetic is on whole numbers, so that
neither the order of rows nor of tasks can change a result.

What is sent and what comes to the driver are codebooks: PARTS * entries * dimension / PARTS numbers, whatever the table's size.

Defined results: a vector that is null or empty, or has null or non-finite components, is dropped; so is one of another
length than the kept vector of the smallest id. That length must be a multiple of PARTS. Whole components beyond
+-REACH count as +-REACH, so that sums and squares stay exact. The first codebook are the vectors of the smallest ids, ties by
the vectors themselves, null ids last; with fewer rows it has fewer entries. Equal rows are rows of their own with equal
codes; an empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import forget, given_back, small_batches, workspace, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole components reach this far: squared distances of 2^10 components stay below 2^63.
REACH = 1 << 26
#: Members of an owner, if all rows were of one entry.
MEMBERS = 4096
#: Distances that a task computes at once.
AT_ONCE = 1 << 21


def whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """id, label and v, the vector in whole numbers, of the rows that have one."""
    x = F.col(vector_col)
    fits = F.size(x) > 0
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    near = lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-REACH)), F.lit(REACH)).cast("int")
    return vectors.where(fits & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(x, near).alias("v"))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry to each row of x, the lowest of ties, and the squared distance; exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 52 else np.int64
    e = entries.astype(kind)
    norms = (e * e).sum(axis=1)
    at, far = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    rows = max(1, AT_ONCE // len(e))
    for k in range(0, len(x), rows):
        own = x[k : k + rows].astype(kind)
        d = norms - 2 * (own @ e.T)
        at[k : k + rows] = i = d.argmin(axis=1)
        far[k : k + rows] = (d[np.arange(len(own)), i] + (own * own).sum(axis=1)).astype(np.int64)
    return at, far


def assigned(members: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """members (row, id, label, pos, v) with the entry that is nearest now, and its squared distance as far."""
    sent = members.sparkSession.sparkContext.broadcast(books)
    kept_columns = [c for c in members.columns if c not in ("entry", "far")]
    kind = T.StructType([members.schema[c] for c in kept_columns]).add("entry", T.IntegerType()).add("far", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if not len(batch):
                    continue
                v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                pos = batch["pos"].to_numpy(zero_copy_only=False)
                entry, far = np.empty(len(batch), np.int32), np.empty(len(batch), np.int64)
                for p in np.unique(pos):
                    mine = np.flatnonzero(pos == p)
                    entry[mine], far[mine] = nearest(v[mine], sent.value[p])
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept_columns], pa.array(entry), pa.array(far)], [*kept_columns, "entry", "far"])
        finally:
            given_back()

    return members.mapInArrow(run, kind)


def updated(members: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks whose entries are the floors of their members' means; entries without members stay."""
    wide = books[0].shape[1]
    sums = members.groupBy("pos", "entry").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(wide)]).alias("s"))
    out = [b.copy() for b in books]
    for r in sums.collect():  # parts * entries rows
        out[r.pos][r.entry] = [s // r.n for s in r.s]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, members: int = MEMBERS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, codes, error) of each kept vector, and the codebooks, an array of entries for each part position."""
    spark = vectors.sparkSession
    small_batches(spark)
    where = workspace(spark, "vector_codes")
    kept = whole(vectors, id_col, vector_col, label_col, scale, parts)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    shape = kept.select("id", F.size("v").alias("n")).orderBy(F.col("id").asc_nulls_last()).first()
    if shape is None:
        return kept.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), []
    if shape.n % parts:
        raise ValueError(f"vectors of {shape.n} components can't be cut into {parts} equal parts")
    wide = shape.n // parts
    if any(len(r.v) != shape.n for r in first):
        first = kept.where(F.size("v") == shape.n).orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, wide)
    books = [start[:, p].copy() for p in range(parts)]
    rows = written(kept.where(F.size("v") == shape.n).withColumn("row", F.monotonically_increasing_id()), f"{where}/rows")
    salts = -(-rows.count() // members)
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.cast("int").alias("pos"), F.slice("v", p * wide + 1, wide).alias("v")))
    cuts = rows.select("row", "id", "label", F.inline(cut))
    home = lambda d: d.repartition("pos", "entry", F.pmod(F.xxhash64("row"), F.lit(salts)))  # noqa: E731  with its owner
    now, old = written(home(assigned(cuts, books).drop("far")), f"{where}/members0"), (f"{where}/members0",)
    for k in range(1, rounds + 1):
        books = updated(now, books)
        if k == rounds:  # the last assignment is read, not moved
            break
        before = now.withColumnRenamed("entry", "old")
        moved = assigned(before, books).withColumn("moved", F.col("old") != F.col("entry")).drop("old", "far")
        path = f"{where}/assigned{k}"
        moved.write.mode("overwrite").partitionBy("moved").parquet(path)
        found = spark.read.schema(moved.schema).parquet(path)
        arrived = written(home(found.where("moved").drop("moved")), f"{where}/arrived{k}")
        now = found.where("not moved").drop("moved").unionByName(arrived)
        forget(spark, *old)
        old = (path, f"{where}/arrived{k}")
    last = assigned(now.drop("entry"), books)
    codes = last.groupBy("row").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("codes"), F.sum("far").alias("error"))
    return codes.drop("row"), books


def label_errors(codes: DataFrame, where: str) -> DataFrame:
    """codes with label_error, the sum of the errors of rows of an equal label; nulls are equal."""
    codes = written(codes, f"{where}/codes")
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), f"{where}/labels")
    same = codes["label"].eqNullSafe(sums["label"])
    return codes.join(sums, same).drop(sums["label"])


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = label_errors(codes, workspace(spark, "vector_labels"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
