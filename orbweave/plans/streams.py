"""Queries that merge a stream of events into tables, with a writer that is killed on the way."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from orbweave.plans.registry import query
from orbweave.plans.scans import finished, place
from orbweave.sources.tables import load
from orbweave.streaming.merge import MergedTable, merge_stream


def merged(spark, d, schema, keys, version, shape):
    """Events in files of their own, one a batch; the first run dies between the write and the
    commit of its second batch, and the next run goes on."""
    at, e = place(spark, "merged"), load(spark, d, "events")
    e.repartitionByRange(4, "event_id").write.parquet(f"{at}/events")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/events")
    table = MergedTable(spark, f"{at}/table", schema, keys, version)

    def dies(number: int) -> None:
        if number == 1:
            raise RuntimeError("killed before the commit")

    try:
        merge_stream(stream, table, f"{at}/state", shape, 2, dies)
    except StreamingQueryException as died:
        if "killed before the commit" not in str(died):
            raise
    merge_stream(stream, table, f"{at}/state", shape, 2)
    return finished(table.read(), at)


@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id, event_type")
def merged_totals(spark, d):
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    return merged(spark, d, "user_id long, event_type string, n long, cents long", ["user_id", "event_type"], None, lambda b: b.select("user_id", "event_type", F.lit(1).cast("long").alias("n"), cents))


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def merged_latest(spark, d):
    return merged(spark, d, "user_id long, event_id long, event_type string, value double", ["user_id"], "event_id", lambda b: b)
