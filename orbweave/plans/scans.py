"""Queries that write stand-ins to the shared folder and read them with the scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orbweave.plans.registry import query
from orbweave.sources import tables as S
from orbweave.sources.tables import load


def place(spark, name: str) -> str:
    return f"{S.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def finished(df, *folders: str):
    """`df`, written, and the folders that it was read from deleted."""
    out = S.kept(df)
    for at in folders:
        S.remove(out.sparkSession, at)
    return out


def _torn_log(spark, d) -> str:
    """Events as JSON lines, every ninth one torn as by a killed writer."""
    at, e = place(spark, "log"), load(spark, d, "events")
    line = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}"))
    e.select(F.when(F.col("event_id") % 9 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(at)
    return at


EVENT = "event_id long, props struct<k:long>"


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 9 <> 0")
def torn_log_records(spark, d):
    at = _torn_log(spark, d)
    good, _ = S.json_lines(spark, at, EVENT, ["event_id"])
    return finished(good.select("event_id", F.col("props.k").alias("k")), at)


@query("SELECT 'not JSON' AS reason, count(*) AS n FROM events WHERE event_id % 9 = 0")
def torn_log_quarantine(spark, d):
    at = _torn_log(spark, d)
    _, bad = S.json_lines(spark, at, EVENT, ["event_id"])
    return finished(bad.groupBy("reason").agg(F.count("*").alias("n")), at)


@query("""WITH o AS (SELECT o_orderkey, o_orderkey // 4000 AS split, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT printf('%d_%05d', split, n) AS key, o_orderkey AS id FROM o WHERE o_orderkey % 10 <> 3""")
def keyed_lines(spark, d):
    """Orders as files of JSON lines in the order of their keys, some of the lines blank."""
    at = place(spark, "lines")
    line = F.when(F.col("o_orderkey") % 10 != 3, F.to_json(F.struct(F.col("o_orderkey").alias("id")))).otherwise("")
    o = load(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 4000).alias("split"), "o_orderkey", line.alias("value"))
    o.repartition("split").sortWithinPartitions("split", "o_orderkey").drop("o_orderkey").write.partitionBy("split").text(at)
    good, _ = S.keyed_json_lines(spark, at, "id long", ["id"], name=F.regexp_extract("file", "split=([^/]+)/", 1))
    return finished(good.select("key", "id"), at)


@query("SELECT n_name AS name, n_regionkey AS region, CASE WHEN n_nationkey % 8 = 3 THEN 'missing region' END AS reason FROM nation WHERE n_nationkey % 8 <> 3 UNION ALL SELECT NULL, NULL, 'missing region' FROM nation WHERE n_nationkey % 8 = 3")
def record_files(spark, d):
    """A file for each nation; some lack a field and go to quarantine."""
    at = place(spark, "records")
    whole = F.struct(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 8 != 3, F.col("n_regionkey")).alias("region"))
    load(spark, d, "nation").select("n_nationkey", F.to_json(whole).alias("value")).write.partitionBy("n_nationkey").text(at)
    good, bad = S.record_folder(spark, at, "name string, region int", ["region"], "*.txt")
    good = good.select("name", "region", F.lit(None).cast("string").alias("reason"))
    return finished(good.union(bad.select(F.lit(None), F.lit(None), "reason")), at)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS uid, 'glbs/' || n_name || '.glb' AS path FROM nation")
def manifest_paths(spark, d):
    at = place(spark, "manifest")
    entry = F.struct(F.col("n_nationkey").cast("string"), F.concat(F.lit("glbs/"), "n_name", F.lit(".glb")))
    whole = load(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    whole.write.partitionBy("n_regionkey").text(at)  # a file each
    return finished(S.manifest(spark, f"{at}/*"), at)


@query("SELECT s_suppkey, s_name FROM supplier")
def append_only_log(spark, d):
    """Half of the suppliers, then all of them twice: each is there once."""
    at, s = place(spark, "append"), load(spark, d, "supplier").select("s_suppkey", "s_name")
    for part in (s.where("s_suppkey % 2 = 0"), s, s):
        S.append_new(spark, part, at, ["s_suppkey"])
    return finished(spark.read.parquet(at), at)


@query("SELECT s_suppkey, CAST(2 AS BIGINT) AS rows FROM supplier WHERE s_suppkey % 4 = 1 AND upper(s_name) <> s_name")
def write_once_conflicts(spark, d):
    """Suppliers whose stored record a second writer would change."""
    s = load(spark, d, "supplier").select("s_suppkey", "s_name")
    return S.conflicts(s, s.withColumn("s_name", F.when(F.col("s_suppkey") % 4 == 1, F.upper("s_name")).otherwise(F.col("s_name"))), ["s_suppkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM customer")
def upsert_latest(spark, d):
    """A later version of every third customer, and a late copy of the first one."""
    old = load(spark, d, "customer").select("c_custkey", "c_name", F.lit(1).alias("version"))
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(2).alias("version"))
    late = old.where("c_custkey % 5 = 0").withColumn("version", F.lit(0))
    return S.upsert(S.upsert(old, new, ["c_custkey"], "version"), late, ["c_custkey"], "version")


@query("SELECT count(*) AS count, CAST(max(len(embedding)) AS INT) AS dim, true AS same FROM embeddings")
def vector_sink(spark, d):
    """What the sink says of an index it wrote, and whether that is what it was given."""
    e = load(spark, d, "embeddings")
    at = place(spark, "index")
    said = S.write_vectors(e, at).select("count", "dim", F.col("digest").alias("written"))
    both = said.crossJoin(F.broadcast(S.index_descriptor(e).select("digest")))  # one row each
    return finished(both.select("count", "dim", (F.col("digest") == F.col("written")).alias("same")), at)
