"""Operators that change the number of rows: unpivot, dedup, majority, explode, sampling, unions, anti-join."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import hash_number
from corpusloom.operators.columns import need, unused
from corpusloom.operators.stages import evaluate_once


def flatten(df: DataFrame, columns: Sequence[str], value: str, variable: str) -> DataFrame:
    """Wide to long: a row for each of the columns, nulls kept, the other columns repeated."""
    need(df, columns)
    return df.unpivot([c for c in df.columns if c not in columns], list(columns), variable, value)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """The first row of each key in the given order; any row of it without an order. Null keys are equal."""
    need(df, keys)
    if not order:
        return df.dropDuplicates(list(keys))
    # An aggregate, not a window: rows of a hot key are reduced where they are read.
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{k}") for k, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest) if rest else F.lit(1), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def majority(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Sets a column to its most frequent value (of equals the smallest; nulls don't count) over all rows, or by group.

    Counts are small before they meet: one row a value and group, from which one a group is joined back.
    """
    need(df, [column, *by])
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    modes = counts.groupBy(*by).agg(F.min_by("_value", F.struct((-F.col("_n")).alias("n"), "_value")).alias("_mode"))
    if not by:
        mode = modes.select(F.lit(0).alias("_k"), "_mode")
        return df.withColumn("_k", F.lit(0)).join(F.broadcast(mode), "_k", "left").withColumn(column, F.col("_mode")).select(*df.columns)
    right = modes.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "_mode")
    same = functools.reduce(lambda a, b: a & b, [df[c].eqNullSafe(right[f"_by{k}"]) for k, c in enumerate(by)])
    return df.join(right, same, "left").withColumn(column, F.col("_mode")).select(*df.columns)


def explode_list(df: DataFrame, column: str, position: str | None = None) -> DataFrame:
    """A row for each element, in order; none for an empty list."""
    names = [position, column] if position else ["_position", column]
    out = df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias(*names))
    return out if position else out.drop("_position").select(*df.columns)


def repeat(df: DataFrame, n: int | Column, index: str) -> DataFrame:
    """Each row n times, numbered."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1))) if not isinstance(n, int) or n > 0 else df.limit(0).withColumn(index, F.lit(0))


def iterate(df: DataFrame, n: int, step: Callable[[DataFrame], DataFrame], index: str = "iteration") -> DataFrame:
    """Runs a step over n numbered copies of the input: one plan, not n."""
    return step(repeat(df, n, index))


def concat(frames: Iterable[DataFrame | None]) -> DataFrame | None:
    """All rows of the frames there are, by column name; None for none."""
    frames = [f for f in frames if f is not None]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def numbered(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Numbers rows 0, 1, ... in order: by range partitions, whose sizes come first, so no task sees all rows.

    The ranges are written once: their sizes and their rows are then of one evaluation, whatever df is made of.
    """
    part, row, low, start, n = (unused(c, [*df.columns, name]) for c in ("_part", "_row", "_low", "_start", "_n"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = evaluate_once(ranged.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    sizes = spread.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.min(row).alias(low))
    starts = sizes.withColumn(start, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(starts), part).withColumn(name, F.col(start) + F.col(row) - F.col(low)).select(*df.columns, name)


def row_range(df: DataFrame, start: int, end: int, ordinal: str = "ordinal") -> DataFrame:
    return df.where((F.col(ordinal) >= start) & (F.col(ordinal) < end))


def batches(df: DataFrame, size: int, ordinal: str = "ordinal", name: str = "batch_id") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(ordinal) / size).cast("bigint"))


#: Up to so many sampled rows are a top-k; more are cut off at a place in the order of their hashes.
TOP = 100_000


def sample_exact(df: DataFrame, k: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly k rows without replacement (all, if there are fewer), the same in each run: the first by md5 of the key.

    A large sample is not sorted: counts of the first 16 bits of the hashes show in which of 65,536 ranges the k-th row
    is; rows of the ranges before are taken as they are, and only that range's are put in order.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    first = lambda d, n: d.orderBy(hashed, *key).limit(n)
    if k <= TOP:
        return first(df, k)
    prefix = F.substring(hashed, 1, 4)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = counts.where((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).first()
    return df if at is None else df.where(prefix < at["p"]).unionAll(first(df.where(prefix == at["p"]), k - at["before"]))


def sample_with_replacement(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, each drawn from all: also for more rows than there are."""
    rows = numbered(df, key, "_ordinal")
    total = df.count()
    if not total:
        return df
    draws = df.sparkSession.range(n).select(hash_number(F.lit(str(seed)), "id", modulus=total).alias("_ordinal"))
    return rows.join(draws, "_ordinal").select(*df.columns)


def sample_size(df: DataFrame, size: int | float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A recipe's sampling size: a whole number of rows, a fraction of them, or 1.0 for all."""
    if size == 1.0:
        return df
    return sample_with_replacement(df, size if isinstance(size, int) else int(df.count() * size), key, seed)


def missing(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of df whose values of the columns both tables have are not in done; nulls are equal."""
    common = [c for c in df.columns if c in done.columns]
    if not common:
        return df
    other = done.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(common)]).distinct()
    return df.join(other, functools.reduce(lambda a, b: a & b, [df[c].eqNullSafe(other[f"_{k}"]) for k, c in enumerate(common)]), "left_anti")


#: Rows of few-shot examples that may be sent to every executor.
EXAMPLES = 10_000


def with_examples(df: DataFrame, examples: DataFrame, example_order: str | None = None) -> DataFrame:
    """Each row with each example. The examples are a seed file's rows: their number is checked before they are sent; more than
    EXAMPLES are numbered and joined, a block of so many at a time."""
    if examples.limit(EXAMPLES + 1).count() > EXAMPLES:
        return _with_blocks(df, examples, example_order)
    # One literal of the plan, whatever the number of examples.
    kind = T.StructType([*examples.schema.fields, T.StructField("_place", T.IntegerType())])
    numbered_ = [r[0] for r in examples.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    text = "[" + ",".join(f'{r[:-1]}{"," if len(r) > 2 else ""}"_place":{k}}}' for k, r in enumerate(numbered_)) + "]"
    entry = unused("_example", df.columns)
    out = df.withColumn(entry, F.explode(F.from_json(F.lit(text), T.ArrayType(kind))))
    place = [F.col(entry)["_place"].alias(example_order)] if example_order else []
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(entry)[c].alias(c) for c in kind.names[:-1]], *place)


def _with_blocks(df: DataFrame, examples: DataFrame, example_order: str | None) -> DataFrame:
    entry, block, place, other = (unused(c, [*df.columns, *examples.columns]) for c in ("_example", "_block", "_place", "_other"))
    many = numbered(examples.withColumn(other, F.monotonically_increasing_id()), [other], place)
    packed = evaluate_once(many.select((F.col(place) / EXAMPLES).cast("long").alias(other), F.struct(*[F.col(f"`{c}`") for c in examples.columns], place).alias(entry)))
    last = packed.agg(F.max(other)).first()[0]
    rows = df.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last))))
    out = rows.join(packed, F.col(block) == F.col(other))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in examples.columns]
    return out.select(*kept, *[F.col(entry)[c].alias(c) for c in examples.columns], *([F.col(entry)[place].cast("int").alias(example_order)] if example_order else []))


def class_codes(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """A column as the place of its value among the sorted values, given or present. Unknown values are null."""
    if values is None:
        present = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
        table = numbered(present, ["_value"], "_code").withColumn("_code", F.col("_code").cast("int"))
    else:
        table = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(sorted(values))], "_value string, _code int")
    return df.join(table, F.col(column) == F.col("_value"), "left").withColumn(column, F.col("_code")).select(*df.columns)


def grouped_rows(df: DataFrame, key: str, order: str, name: str = "rows") -> DataFrame:
    """A row for each key with its rows in order, as an array; for seed files, whose groups are small."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
