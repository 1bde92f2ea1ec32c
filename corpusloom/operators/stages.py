"""Stages that leave the JVM: evaluated once and written, with errors of single rows, and a store of what was answered.

A stage is a non-deterministic Arrow function of one column, so Catalyst neither moves a filter through it nor runs it
twice. It gives a struct of value and error: a row that fails is a row with an error, and its batch goes on. Rows with errors fail
the job, or go to a quarantine: a table of step, reason and row.

An answer store keeps answers by the hash of what was asked of which model with which options. Each distinct request is
made once, in jobs of a bounded number of rows that are stored as they end; rows get their answers by an equi-join, so
equal rows, reruns and what is left after a failure ask only what is not stored.
"""

from __future__ import annotations

import hashlib
import json
import logging
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.operators.columns import unused

log = logging.getLogger("corpusloom")

#: A session setting for a folder that all executors share, where spark.checkpoint.dir is not to be used.
WORK = "corpusloom.work.dir"
_local: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: the setting WORK, or spark.checkpoint.dir. A local session without one gets a
    temporary folder."""
    folder = spark.conf.get(WORK, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: what models answer is written there")
        folder = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return folder.rstrip("/")


def evaluate_once(df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Writes what a model stage made to the shared folder, so that nothing calls the model again."""
    return evaluated(df, parts)[0]


def evaluated(df: DataFrame, parts: Sequence[str] = (), **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """evaluate_once, with counts of its rows (as `rows`, and of the conditions given) that the same job makes."""
    spark, seen = df.sparkSession, Observation()
    path = f"{work_folder(spark)}/model-{uuid.uuid4().hex}"
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(name) for name, c in counts.items()])
    watched.write.partitionBy(*parts).parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    found = observed(seen)
    if found is None:
        found = out.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(name) for name, c in counts.items()]).first().asDict()
    return out, found


def observed(seen: Observation, seconds: float = 10.0) -> dict[str, int] | None:
    """The counts of an observation whose job has ended. They come a moment later; None if they don't, because the job was
    planned anew without the part that was observed."""
    until = time.monotonic() + seconds
    while not seen._jo.future().isCompleted():
        if time.monotonic() > until:
            return None
        time.sleep(0.01)
    return seen.get


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_if_there(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """A table in a folder, or None where nothing was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


@dataclass(frozen=True)
class Failure:
    """What a backend gives in place of a row's answer. final: asking again is of no use."""

    reason: str
    final: bool = True


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


ERROR = T.StructType([T.StructField("reason", T.StringType()), T.StructField("final", T.BooleanType())])


def _called(df: DataFrame, name: str, kind: T.DataType, source: Column | str, call: Callable[[list], list]) -> DataFrame:
    """df with a column (value, error) that a function makes of another one, which alone is sent to Python."""
    out = T.StructType([T.StructField("value", kind), T.StructField("error", ERROR)])
    types = [to_arrow(kind), to_arrow(ERROR)]

    def run(values: pa.Array) -> pa.Array:
        found = call(values.to_pylist()) if len(values) else []
        bad = [isinstance(f, Failure) for f in found]
        value = pa.array([None if b else f for f, b in zip(found, bad, strict=True)], types[0])
        error = pa.array([{"reason": f.reason, "final": f.final} if b else None for f, b in zip(found, bad, strict=True)], types[1])
        return pa.StructArray.from_arrays([value, error], ["value", "error"])

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(run, out).asNondeterministic()(tx.column(source)))


def stage(df: DataFrame, output: str, kind: T.DataType, source: Column | str, call: Callable[[list], list], errors: str | None = None) -> DataFrame:
    """df with what a function makes of another column. A row that fails fails the job, or has its reason in `errors`."""
    made = unused("_made", [*df.columns, output, errors or ""])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (output, errors)]
    called = _called(df, made, kind, source, call)
    value, reason = F.col(made)["value"], F.col(made)["error"]["reason"]
    if errors is None:
        # The error is looked at in a projection of its own; a column that is made once is not made again for it.
        return called.select(*rest, F.when(reason.isNull(), value).otherwise(F.raise_error(reason).cast(kind)).alias(output))
    return called.select(*rest, value.alias(output), reason.alias(errors))


@dataclass(frozen=True)
class Quarantine:
    """A folder of rows that a step could not do: step, reason, row (JSON). `part` is where one job's rows go."""

    folder: str
    part: str = field(default_factory=lambda: f"run={uuid.uuid4().hex}")
    steps: list[str] = field(default_factory=list, compare=False)

    SCHEMA = "step string, reason string, row string"

    def of(self, part: str) -> Quarantine:
        """The same table for another job."""
        return Quarantine(self.folder, part)

    def emptied(self, spark: SparkSession) -> Quarantine:
        """This job's part of the table, without what an earlier try has left there."""
        delete(spark, f"{self.folder}/{self.part}")
        return self

    def take(self, df: DataFrame, reason: Column, step: str, rows: int | None = None) -> DataFrame:
        """The rows without a reason; the others are written to the table, unless their number is known to be 0."""
        number = len(self.steps)
        self.steps.append(step)
        if rows != 0:
            marked = unused("_reason", df.columns)
            bad = df.withColumn(marked, reason).where(F.col(marked).isNotNull())
            out = bad.select(F.lit(step).alias("step"), F.col(marked).alias("reason"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
            out.write.mode("overwrite").parquet(f"{self.folder}/{self.part}/{number}")
        return df.where(reason.isNull())

    def rows(self, spark: SparkSession, parts: Sequence[str] | None = None) -> DataFrame:
        """All rows in the table, or those of some jobs."""
        found = [read_if_there(spark, f"{self.folder}/{p}" if p else self.folder, self.SCHEMA) for p in (parts if parts is not None else [""])]
        found = [f for f in found if f is not None]
        out = found[0] if found else spark.createDataFrame([], self.SCHEMA)
        for f in found[1:]:
            out = out.unionAll(f)
        return out


@dataclass(frozen=True)
class AnswerStore:
    """Answers by the hash of a request, in a folder that all executors share.

    rows: requests that one job asks and stores. attempts: how often a request is made whose failure is not final.
    chunk: requests that are handed to the backend together; if it raises, all of them are tried again.
    """

    folder: str
    rows: int = 100_000
    attempts: int = 3
    chunk: int = 256

    def place(self, request: Mapping) -> str:
        """The folder of the answers to one kind of request: of a model with its options."""
        return f"{self.folder}/{hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:32]}"

    def _safely(self, call: Callable[[list], list]) -> Callable[[list], list]:
        def run(values: list) -> list:
            out = []
            for k in range(0, len(values), self.chunk):
                part = values[k : k + self.chunk]
                try:
                    out += call(part)
                except Exception as e:  # noqa: BLE001  what other rows were answered is kept
                    out += [Failure(f"{type(e).__name__}: {e}", final=False)] * len(part)
            return out

        return run

    def ask(self, df: DataFrame, output: str, kind: T.DataType, source: Column | str, call: Callable[[list], list], request: Mapping, errors: str | None = None) -> DataFrame:
        """df with the answers: those that are stored, and of the others each distinct one asked once.

        Rows that fail at last are errors like those of `stage`, and are asked again in the next run. df is evaluated once.
        """
        spark, where = df.sparkSession, self.place(request)
        names = [*df.columns, output, errors or ""]
        key, asked = unused("_key", names), unused("_asked", names)
        keyed = df.withColumn(asked, tx.column(source))
        keyed = evaluate_once(keyed.withColumn(key, F.sha2(F.coalesce(F.to_json(F.struct(F.col(asked))), F.lit("")), 256)))
        kinds = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", kind)])
        wanted = keyed.select(F.col(key).alias("key"), F.col(asked).alias("asked")).dropDuplicates(["key"])
        failed: DataFrame | None = None
        run, wave = uuid.uuid4().hex, "_wave"
        for attempt in range(self.attempts):
            known = read_if_there(spark, where, kinds)
            todo = wanted if failed is None else failed.where(~F.col("final")).select("key", "asked")
            todo, seen = evaluated((todo if known is None else todo.join(known.select("key"), "key", "left_anti")).withColumn(wave, F.pmod(F.xxhash64("key"), F.lit(1 << 20))))
            if not seen["rows"]:
                break
            bad: list[DataFrame] = [] if failed is None else [failed.where("final")]
            waves = -(-seen["rows"] // self.rows)
            for w in range(waves):
                mine = todo if waves == 1 else todo.where(F.col(wave) % waves == w)
                made, n = evaluated(_called(mine.drop(wave), "made", kind, "asked", self._safely(call)), errors=F.col("made")["error"].isNotNull())
                made.where("made.error is null").select("key", F.col("made")["value"].alias("value")).write.parquet(f"{where}/run={run}-{attempt}-{w}")
                if n["errors"]:
                    bad.append(made.where("made.error is not null").select("key", "asked", F.col("made")["error"]["reason"].alias("reason"), F.col("made")["error"]["final"].alias("final")))
            if not bad:
                failed = None
                break
            failed = bad[0]
            for b in bad[1:]:
                failed = failed.unionAll(b)
            log.info("attempt %s: requests failed", attempt + 1)
        known = read_if_there(spark, where, kinds)
        known = known if known is not None else spark.createDataFrame([], kinds)
        # Two runs side by side may both have stored an answer.
        answers = known.groupBy("key").agg(F.first("value").alias("value"), F.lit(None).cast("string").alias("reason"))
        if failed is not None:
            answers = answers.unionByName(failed.select("key", F.lit(None).cast(kind).alias("value"), "reason"))
        found = keyed.join(answers, F.col(key) == F.col("key"), "left")
        rest = [F.col(f"`{c}`") for c in df.columns if c not in (output, errors)]
        if errors is None:
            return found.select(*rest, F.when(F.col("reason").isNull(), F.col("value")).otherwise(F.raise_error(F.col("reason")).cast(kind)).alias(output))
        return found.select(*rest, F.col("value").alias(output), F.col("reason").alias(errors))
