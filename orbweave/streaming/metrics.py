"""Following an append-only log with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.tables import shared_folder


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def metric_totals(log: DataFrame) -> DataFrame:
    """Counts and maxima by kind; works on a static and on a streaming log."""
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def follow(spark: SparkSession, folder: str, schema, pattern: str, out: str) -> None:
    """Read what a log folder holds now and stop; a second call goes on from there.

    Each batch replaces its own folder below `out`, so a repeated batch changes nothing.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    log = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    metric_totals(log).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()


def tail_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = checkpoint_folder(spark)
    follow(spark, sf_dir, schema, "events*.parquet", out)
    done = spark.read.parquet(out)
    return done.where(F.col("batch") == done.agg(F.max("batch").alias("b")).first()["b"]).drop("batch")
