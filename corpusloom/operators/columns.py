"""Projections: renaming, copying, dropping, combining and looking up columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def need(df: DataFrame, columns: Sequence[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}; there are {', '.join(df.columns)}")


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, with marks before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames all at once, so a name may move from one column to another."""
    need(df, list(names))
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError(f"two columns would have one name: {out}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, out, strict=True)])


def duplicate(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Copies columns under new names."""
    need(df, list(names))
    taken = [n for n in names.values() if n in df.columns]
    if taken:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
    return df.withColumns({n: F.col(f"`{c}`") for c, n in names.items()})


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drops those of the columns that there are."""
    return df.drop(*columns)


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keeps those of the columns that there are, in the table's order."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(columns)])


def literal(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def combine(df: DataFrame, columns: Sequence[str], output: str, separator: str = "\n\n", strict: bool = False) -> DataFrame:
    """Joins columns in the given order. A null makes the result null, or fails the job if strict."""
    need(df, columns)
    parts: list[Column] = []
    for c in columns:
        value = F.col(f"`{c}`").cast("string")
        if strict:
            value = F.coalesce(value, F.raise_error(F.lit(f"null in {c}")).cast("string"))
        parts += [value, F.lit(separator)]
    return df.withColumn(output, F.concat(*parts[:-1]))


def select_by(df: DataFrame, choice_map: Mapping[str, str], choice: str, output: str, strict: bool = True) -> DataFrame:
    """Takes, in each row, the column that choice_map names for the row's choice."""
    need(df, [choice, *choice_map.values()])
    other = F.raise_error(F.concat(F.lit("no column for choice "), F.coalesce(F.col(choice).cast("string"), F.lit("null")))).cast("string") if strict else F.lit(None)
    picked = F
    for value, c in choice_map.items():
        picked = picked.when(F.col(choice) == value, F.col(f"`{c}`"))
    return df.withColumn(output, picked.otherwise(other))


def populate(df: DataFrame, configs: Mapping[str, Mapping[str, str]], column: str, strict: bool = True) -> DataFrame:
    """Adds to each row the fields of the configuration that the column names, over columns of the same names.

    The configurations are a table of their own, as large as the flow's files, and are broadcast.
    """
    need(df, [column])
    fields = sorted({f for c in configs.values() for f in c})
    rows = [(key, *[None if c.get(f) is None else str(c[f]) for f in fields]) for key, c in configs.items()]
    table = df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["_key", *[f"_{f}" for f in fields]]))
    joined = df.join(F.broadcast(table), F.col(column) == F.col("_key"), "left")
    if strict:
        known = F.when(F.col("_key").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no configuration "), F.coalesce(F.col(column), F.lit("null")))).cast("boolean"))
        joined = joined.where(known)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in fields], *[F.col(f"`_{f}`").alias(f) for f in fields])
