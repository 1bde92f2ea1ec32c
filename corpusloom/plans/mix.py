"""Recipes: training sets put together from several files."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import reshape
from corpusloom.plans.convert import turn
from corpusloom.sources.files import read_named, read_yaml, write_jsonl, write_yaml

log = logging.getLogger("corpusloom")
COLUMNS = ("id", "messages", "metadata")


def with_metadata(df: DataFrame) -> DataFrame:
    """Folds all columns but id, messages and metadata into the JSON of metadata, in place of fields of their names.

    Null metadata has no fields; metadata that is not a JSON object fails the job.
    """
    extra = [c for c in df.columns if c not in COLUMNS]
    if "metadata" in df.columns and dict(df.dtypes)["metadata"] != "string":
        df = df.withColumn("metadata", F.to_json("metadata", {"ignoreNullFields": "false"}))
    if not extra:
        return df.withColumn("metadata", F.coalesce("metadata", F.lit("{}")) if "metadata" in df.columns else F.lit("{}")).select(*[c for c in COLUMNS if c in (*df.columns, "metadata")])
    inside = lambda c: F.nullif(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(""))
    new = inside(F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra]), {"ignoreNullFields": "false"}))
    old = F.lit(None).cast("string")
    if "metadata" in df.columns:
        fields = F.from_json("metadata", "map<string, variant>", {"mode": "FAILFAST"})
        old = F.when(F.col("metadata").isNotNull(), inside(F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(extra)), {"ignoreNullFields": "false"})))
    whole = F.concat(F.lit("{"), F.concat_ws(",", old, new), F.lit("}"))
    return df.withColumn("metadata", whole).select(*[c for c in COLUMNS if c in (*df.columns, "metadata")])


def with_system(messages: Column | str, prompt: str) -> Column:
    """Every system turn gets the prompt; without one it comes first."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    replaced = F.transform(messages, lambda m: F.when(m["role"] == "system", turn("system", F.lit(prompt))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return F.when(F.exists(messages, lambda m: m["role"] == "system"), replaced).otherwise(F.concat(F.array(turn("system", F.lit(prompt))), replaced))


class Recipe:
    """Files with sampling sizes, and a system prompt."""

    def __init__(self, path: str | Path | None = None):
        raw = read_yaml(path) if path else {}
        self.system = raw.get("sys_prompt", "")
        self.inputs: list[tuple[str, int | float]] = [(d["path"], d.get("sampling_size", 1.0)) for d in raw.get("datasets") or []]

    def add(self, path: str, sampling_size: int | float = 1.0) -> Recipe:
        self.inputs.append((path, sampling_size))
        return self

    def save(self, path: str | Path) -> None:
        write_yaml({"datasets": [{"path": p, "sampling_size": s} for p, s in self.inputs], "sys_prompt": self.system}, path)

    def mixed(self, spark: SparkSession, key: Sequence[str] = ("id",), seed: int = 42) -> DataFrame | None:
        parts = [with_metadata(reshape.sample_size(read_named(spark, p), s, key, seed)) for p, s in self.inputs]
        out = reshape.concat(parts)
        if out is None:
            return None
        out = out.withColumn("messages", with_system("messages", self.system))
        if set(out.columns) != set(COLUMNS):
            raise ValueError(f"training rows have exactly {', '.join(COLUMNS)}; these have {', '.join(out.columns)}")
        return out

    def save_mixed(self, spark: SparkSession, path: str) -> None:
        out = self.mixed(spark)
        if out is None:
            log.error("no datasets were added to the recipe")
        else:
            write_jsonl(out, path)
