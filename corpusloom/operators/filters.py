"""Row filters."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import to_float, to_int, token_count
from corpusloom.operators.columns import need

CONVERTERS = {"float": to_float, "int": to_int}
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": operator.eq, "ne": operator.ne, "ge": operator.ge, "gt": operator.gt, "le": operator.le, "lt": operator.lt,
    "contains": operator.eq, "like": lambda c, v: c.like(v), "rlike": lambda c, v: F.rlike(c, v),
}


def filter_by_value(df: DataFrame, column: str, value, operation: str | Callable[[Column, Column], Column] = "eq", convert: str | None = None) -> DataFrame:
    """Keeps rows for which the operation holds for any of the values. Nulls and, in comparisons, NaN are dropped.

    convert: "float" or "int" turns the column into numbers first and leaves it so; what can't be converted is null.
    """
    need(df, [column])
    name = operation.rpartition(".")[2] if isinstance(operation, str) else operation
    if isinstance(name, str) and name not in OPERATIONS:
        raise ValueError(f"unknown operation {name}; there are {', '.join(OPERATIONS)}")
    values: Sequence = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if convert:
        df = df.withColumn(column, CONVERTERS[convert](column))
    c = F.col(f"`{column}`")
    kept = df.where(c.isNotNull())
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) and name != "ne":
        kept = kept.where(~F.isnan(c))
    if name in ("eq", "contains"):
        return kept.where(c.isin(values))
    test = OPERATIONS[name] if isinstance(name, str) else name
    return kept.where(functools.reduce(operator.or_, [test(c, F.lit(v)) for v in values]))


def not_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with another value, nulls among them."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def min_tokens(df: DataFrame, column: str, tokens: int = 100, count: Callable[[str], int] | None = None) -> DataFrame:
    """Rows whose text has more tokens than this, by the words rule or a function of a text."""
    return df.where(token_count(column, count) > tokens)


def sane_choices(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Multiple-choice rows whose answer names an option and whose question lists options."""
    return df.where(F.col(answer).contains(")") & F.col(question).contains("A)"))


def four_choices(df: DataFrame, choices: str = "choices", answer: str = "answer") -> DataFrame:
    return df.where((F.size(choices) == 4) & F.col(answer).isin("A", "B", "C", "D"))
