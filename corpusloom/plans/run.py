"""Running flows over a table in batches, with a ledger and resume."""

from __future__ import annotations

import argparse
import functools
import logging
import operator
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import columns, models, reshape
from corpusloom.plans.flow import Context, EmptyResult, Step, generate, read_flow, scoped
from corpusloom.plans.rewrite import rewritten

log = logging.getLogger("corpusloom")


#: A table's batches are run in so many jobs at most, if none fails; and when so many jobs have failed, no job is halved.
WAVES, FAILURES = 64, 100
Spans = list[tuple[int, int]]


class Generator:
    """Chains flows over a table. With a checkpoint folder, finished batches are kept there and not made again.

    Rows are numbered in key order and cut into batches of batch_size * save_every, written in the order of their waves, of
    which there are at most WAVES however many batches there are. A wave is one job over its own folder of rows; `parallel`
    waves run side by side. A job that fails is tried again in halves down to single batches, of which those that fail are
    logged and left to the next run. What a job made is a folder of its own, entered in a ledger once it is whole.

    A batch is what a step looks at: its number goes with the rows through all steps as a scope, by which majorities are
    taken and first rows kept, and is dropped at the end. So the rows do not depend on how many batches share a job.
    """

    def __init__(self, flows: Sequence[Sequence[Step]], context: Context | None = None, batch_size: int | None = None, save_every: int = 1, key: Sequence[str] = (), parallel: int = 4):
        self.flows, self.context = flows, context or Context()
        self.batch_size, self.save_every, self.key, self.parallel = batch_size, save_every, key, parallel

    def _chain(self, df: DataFrame, context: Context | None = None) -> DataFrame:
        for steps in self.flows:
            df = generate(df, steps, context or self.context)
        return df

    def generate(self, df: DataFrame, checkpoint: str | None = None) -> DataFrame:
        if not self.batch_size or not checkpoint:
            return self._resumed_by_value(df, checkpoint) if checkpoint else self._chain(df)
        spark, names = df.sparkSession, df.columns
        context, batch = scoped(self.context, self.flows, names)
        wave = columns.unused("_wave", [*names, batch])
        rows = reshape.batches(reshape.numbered(df, list(self.key or names[:1]), wave), self.batch_size * self.save_every, wave, batch)
        total = rows.agg(F.max(batch)).first()[0]
        if total is None:
            raise EmptyResult("there are no rows")
        each = -(-(total + 1) // WAVES)
        rows = models.evaluate_once(rows.withColumn(wave, F.expr(f"int({batch} div {each})")), [wave])
        done, failed = ledger(spark, checkpoint), []

        def run(k: int, spans: Spans) -> None:
            if not spans:
                return
            mine = functools.reduce(operator.or_, [F.col(batch).between(*s) for s in spans])
            low, high = spans[0][0], spans[-1][1]
            try:
                own = replace(context, quarantine=context.quarantine.of(f"rows={low}-{high}").emptied(spark)) if context.quarantine else context
                self._chain(rows.where((F.col(wave) == k) & mine).select(*names, batch), own).drop(batch).write.mode("overwrite").parquet(f"{checkpoint}/rows={low}-{high}")
                note(spark, checkpoint, spans)
            except EmptyResult as e:  # so none of its batches has rows either
                log.warning("batches %s to %s: %s", low, high, e)
            except Exception as e:  # noqa: BLE001  a batch that fails is made in the next run
                log.error("batches %s to %s failed: %s", low, high, e)
                failed.append(spans)
                if low < high and len(failed) < FAILURES:
                    middle = (low + high) // 2
                    run(k, cut(spans, low, middle))
                    run(k, cut(spans, middle + 1, high))

        with ThreadPoolExecutor(self.parallel) as pool:
            list(pool.map(lambda k: run(k, without(k * each, min(total, (k + 1) * each - 1), done)), range(-(-(total + 1) // each))))
        if failed:
            log.warning("%s jobs failed", len(failed))
        if not (done := ledger(spark, checkpoint)):
            raise EmptyResult("no batch was finished")
        return spark.read.parquet(*sorted({f"{checkpoint}/rows={folder}" for _, _, folder in done}))

    def quarantined(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """step, reason, row of what finished jobs could not do."""
        if self.context.quarantine is None:
            raise ValueError("there is no quarantine")
        return self.context.quarantine.rows(spark, [f"rows={folder}" for folder in sorted({f for _, _, f in ledger(spark, checkpoint)})])

    def _resumed_by_value(self, df: DataFrame, checkpoint: str) -> DataFrame:
        """Seed rows whose values appear in what was saved are not made again; all of it is returned."""
        spark = df.sparkSession
        where = f"{checkpoint}/rows=0-0"
        if ledger(spark, checkpoint):
            rest = reshape.missing(df, spark.read.parquet(where))
            if not rest.isEmpty():
                models.evaluate_once(self._chain(rest)).write.mode("append").parquet(where)
        else:
            self._chain(df).write.mode("overwrite").parquet(where)
            note(spark, checkpoint, [(0, 0)])
        return spark.read.parquet(where)


def cut(spans: Spans, low: int, high: int) -> Spans:
    """The parts of spans from low to high."""
    return [(max(a, low), min(b, high)) for a, b in spans if a <= high and b >= low]


def without(low: int, high: int, done: Sequence[tuple]) -> Spans:
    """What of low to high is not done."""
    out, at = [], low
    for a, b in sorted((x[0], x[1]) for x in done if x[0] <= high and x[1] >= low):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return out + ([(at, high)] if at <= high else [])


def ledger(spark: SparkSession, folder: str) -> list[tuple[int, int, str]]:
    """(first, last, folder) of the finished runs of batches, in any store that Spark reads: a row or more a job."""
    try:
        return sorted((r[0], r[1], r[2]) for r in spark.read.schema("first long, last long, folder string").parquet(f"{folder}/ledger/*").distinct().collect())
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def finished(spark: SparkSession, folder: str) -> set[int]:
    """Numbers of the finished batches."""
    return {k for a, b, _ in ledger(spark, folder) for k in range(a, b + 1)}


def note(spark: SparkSession, folder: str, spans: Spans) -> None:
    """Enters batches that are written in the ledger, in a folder of the job's own: jobs end side by side."""
    name = f"{spans[0][0]}-{spans[-1][1]}"
    spark.createDataFrame([(*s, name) for s in spans], "first long, last long, folder string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/{name}")


def main(arguments: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Runs a flow over a JSON Lines file.")
    p.add_argument("--ds_path", required=True)
    p.add_argument("--save_path", required=True)
    p.add_argument("--flow", required=True)
    p.add_argument("--endpoint", required=True)
    p.add_argument("--bs", type=int, default=8)
    p.add_argument("--num_workers", type=int, default=32)
    p.add_argument("--checkpoint_dir", default=None)
    p.add_argument("--save_freq", type=int, default=2)
    p.add_argument("--dataset_start_index", type=int, default=0)
    p.add_argument("--dataset_end_index", type=int, default=None)
    p.add_argument("--work_dir", default=None, help="a folder that all executors share, for what models answer; else spark.checkpoint.dir")
    p.add_argument("--answers", default=None, help="a folder where answers are kept, so that no request is made twice")
    p.add_argument("--quarantine", default=None, help="a folder for rows that a step can't do; without it they fail their batch")
    p.add_argument("--rewrite", action="store_true", help="put filters before the model steps that don't need them")
    p.add_argument("--debug", action="store_true")
    a = p.parse_args(arguments)
    from corpusloom.sources.files import read_jsonl, write_jsonl

    spark = SparkSession.builder.appName("corpusloom").config("spark.speculation", "false").getOrCreate()
    if a.work_dir:
        spark.conf.set(models.WORK, a.work_dir)
    models.work_folder(spark)  # on a cluster, fails before any work if there is none
    seed = read_jsonl(spark, a.ds_path)
    if a.debug:
        seed = reshape.sample_exact(seed, 30, seed.columns)
    if a.dataset_start_index or a.dataset_end_index is not None:
        seed = reshape.row_range(reshape.numbered(seed, seed.columns), a.dataset_start_index, a.dataset_end_index if a.dataset_end_index is not None else 1 << 62).drop("ordinal")
    context = Context(models.HttpBackend(a.endpoint, workers=a.num_workers), store=models.AnswerStore(a.answers) if a.answers else None, quarantine=models.Quarantine(a.quarantine) if a.quarantine else None)
    steps = read_flow(a.flow)
    if a.rewrite:
        steps = rewritten(steps, seed.columns, context)
    made = Generator([steps], context, a.bs, a.save_freq, seed.columns).generate(seed, a.checkpoint_dir)
    write_jsonl(made, a.save_path)


if __name__ == "__main__":
    main()
