"""Structured Streaming over run records and file states.

The batch operators stay as they are: run records are aggregated by a watermarked window, and a
stream of file states keeps an index fresh by upserting each micro-batch by path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgrid.operators.experiments import refresh_plan
from symgrid.schemas import RUNS


def run_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON Lines files of run records as they come."""
    return spark.readStream.schema(RUNS).json(folder).where("task_id is not null")


def live_success(runs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, arm, runs, graded, wins) for each window of start times; later records than ``late`` are dropped."""
    timed = runs.withColumn("at", F.timestamp_seconds("started_at")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", window), "arm").agg(F.count("*").alias("runs"), F.count("success").alias("graded"), F.count(F.when(F.col("success"), 1)).alias("wins"))
    return grouped.select(F.col("window.start").alias("start"), "arm", "runs", "graded", "wins")


def live_report(runs: DataFrame, report: Callable[[DataFrame], DataFrame], store: str, out: str, checkpoint: str) -> StreamingQuery:
    """After each micro-batch the report over all records so far; a batch that comes again replaces its own records."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{store}/batch={number:09d}")
        report(batch.sparkSession.read.schema(RUNS).json(f"{store}/batch=*")).write.mode("overwrite").parquet(out)

    return runs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_refresh(states: DataFrame, stored: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keep a table of parsed files fresh: each micro-batch of (path, sha256, content) replaces the rows of changed paths.

    The table is versioned by micro-batch, so one that comes again writes the same version.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = f"{stored}/v{number + 1}"
        batch = batch.dropDuplicates(["path"])
        if number == 0:
            parse(batch).write.mode("overwrite").parquet(new)
            return
        old = spark.read.parquet(f"{stored}/v{number}")
        plan = refresh_plan(old.select("path", "sha256"), batch.select("path", "sha256"))
        changed = batch.join(plan.where("action = 'parse'").select("path"), "path", "left_semi")
        kept = old.join(changed.select("path"), "path", "left_anti")
        kept.unionByName(parse(changed)).write.mode("overwrite").parquet(new)

    return states.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
