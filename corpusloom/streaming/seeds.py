"""Continuous generation: seed files that arrive in a folder go through a flow, each once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.flow import Context, Step, generate


def generate_stream(spark: SparkSession, seeds: str, schema: str, steps: Sequence[Step], output: str, checkpoint: str, context: Context | None = None, files_per_batch: int = 16):
    """Starts a query that appends what a flow makes of new JSON Lines files to a Parquet folder.

    Flows hold no state between rows of different files, so no watermark is needed; a micro-batch that is tried again
    overwrites its own part of the output.
    """

    def one(batch: DataFrame, number: int) -> None:
        generate(batch, steps, context, fail_on_empty=False).write.mode("overwrite").parquet(f"{output}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(seeds)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
