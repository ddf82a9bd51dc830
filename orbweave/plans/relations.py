"""Queries of joins, aggregates, windows, splits and sets: operators on stand-in tables; their
SQL is written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import relations as R
from orbweave.operators import summaries as S
from orbweave.plans.registry import query
from orbweave.plans.relational import mean, r6
from orbweave.sources.tables import NODES_SQL, load, nodes

NEXT = "pairs AS (SELECT a.house, a.idx AS i, b.idx AS j, a.asset AS asset_a, b.asset AS asset_b FROM nodes a JOIN nodes b ON a.house = b.house AND b.idx = a.idx + 1)"
MASK = "substring(sha256(concat('7:', CAST(p_partkey AS VARCHAR(20)), ':{}')), 1, 4) >= '4ccc'"
SPLIT = """keyed AS (SELECT o_orderkey AS id, sha256(concat('42:', CAST(o_orderkey AS VARCHAR(20)))) AS h FROM orders),
sizes AS (SELECT substring(h, 1, 2) AS b, count(*) AS m FROM keyed GROUP BY substring(h, 1, 2)),
blocks AS (SELECT b, sum(m) OVER (ORDER BY b) - m AS before, sum(m) OVER () AS n FROM sizes),
ranked AS (SELECT id, before + row_number() OVER (PARTITION BY substring(h, 1, 2) ORDER BY h, id) AS rn, n FROM keyed JOIN blocks ON b = substring(h, 1, 2)),
split AS (SELECT id, CASE WHEN rn * 10 <= n * 8 + CASE WHEN n * 8 % 10 > 5 OR n * 8 % 10 = 5 AND CAST(floor(n * 8 / 10) AS BIGINT) % 2 = 1 THEN 10 - n * 8 % 10 ELSE -(n * 8 % 10) END THEN 'train' ELSE 'test' END AS split FROM ranked)"""
EDGES = f"""{NODES_SQL}, support AS (SELECT DISTINCT a.house, a.idx AS i, b.idx AS j FROM nodes a JOIN nodes b ON a.house = b.house AND b.idx = a.idx + 1 WHERE b.asset % 2 = 0),
adjacency AS (SELECT DISTINCT a.house, a.idx AS i, b.idx AS j FROM nodes a JOIN nodes b ON a.house = b.house AND b.idx IN (a.idx + 1, a.idx + 2))"""


def _support(spark, d):
    """Edges of support: from each node to the next one, if that is of an even asset."""
    return R.next_edges(nodes(spark, d), ["asset"]).where("asset_b % 2 = 0").select("house", "i", "j")


def _masks(spark, d):
    kinds = [S.bernoulli(F.col("p_partkey"), n, 7, 0.7).alias(n) for n in ("text", "image", "pc")]
    return load(spark, d, "part").select("p_partkey", *kinds)


@query("""SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""")
def admitted(spark, d):
    return R.admitted(load(spark, d, "documents").select("doc_id"), "doc_id", (load(spark, d, "labels"), "doc_id"), (load(spark, d, "embeddings"), "vec_id"))


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AND EXISTS (SELECT 1 FROM embeddings WHERE vec_id = p_partkey)")
def eligible(spark, d):
    return R.admitted(load(spark, d, "part").select("p_partkey"), "p_partkey", (load(spark, d, "lineitem"), "l_partkey"), (load(spark, d, "embeddings"), "vec_id"))


@query(f"""WITH {NODES_SQL}, {NEXT} SELECT house, i, j, p.p_type AS text_a, q.p_type AS text_b FROM pairs JOIN part p ON p.p_partkey = asset_a JOIN part q ON q.p_partkey = asset_b""")
def edge_texts(spark, d):
    t = nodes(spark, d).join(load(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("text")), "asset")
    return R.next_edges(t, ["text"])


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def unmapped(spark, d):
    return R.unmapped(load(spark, d, "part").select("p_partkey"), "p_partkey", load(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_partkey")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'signup' THEN event_id END AS head FROM events),
w AS (SELECT event_id, event_type, max(head) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM e)
SELECT event_id, section FROM w WHERE event_type = 'error'""")
def asof_section(spark, d):
    head = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return R.last_before(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], head, "section").where("event_type = 'error'").select("event_id", "section")


@query("SELECT c_custkey, sha256(c_name) AS ref FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE sha256(replace(s_name, 'Supplier', 'Customer')) = sha256(c_name))")
def dangling_refs(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("ref"))
    return R.unmapped(c, "ref", load(spark, d, "supplier").select(F.sha2(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")), 256).alias("digest")), "digest")


@query("SELECT p_partkey AS asset, CASE WHEN vec_id IS NULL THEN NULL ELSE p_partkey END AS positive, CASE WHEN vec_id IS NULL THEN 'no cloud' END AS skipped FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def positive_map(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("asset"), F.col("vec_id").alias("positive"))
    p = load(spark, d, "part").select(F.col("p_partkey").alias("asset")).join(e, "asset", "left")
    return p.withColumn("skipped", F.when(F.col("positive").isNull(), "no cloud"))


@query("SELECT DISTINCT l_suppkey AS ref FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def missing_refs(spark, d):
    return R.unmapped(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("ref")).distinct(), "ref", load(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey")


@query("""WITH refs AS (SELECT doc_id, concat('vectors.npz#', CAST(doc_id AS VARCHAR(20))) AS uri, coalesce(n_chars < 100, true) AS degraded FROM documents)
SELECT doc_id, uri, label FROM refs JOIN embeddings ON vec_id = CAST(split_part(uri, '#', 2) AS BIGINT) WHERE NOT degraded""")
def deref_index(spark, d):
    docs = load(spark, d, "documents").where("n_chars >= 100").select("doc_id", F.concat(F.lit("vectors.npz#"), "doc_id").alias("uri"))
    e = load(spark, d, "embeddings").select("vec_id", "label")
    return R.dereferenced(R.admitted(docs, "doc_id", (e, "vec_id")), "uri", e, "vec_id")


@query("""SELECT p_partkey, CASE WHEN vec_id IS NULL THEN 'no vector' WHEN p_size > 40 THEN 'too large' END AS reason FROM part LEFT JOIN embeddings ON vec_id = p_partkey WHERE vec_id IS NULL OR p_size > 40""")
def reasoned_exclusion(spark, d):
    both = load(spark, d, "part").join(load(spark, d, "embeddings").select("vec_id"), F.col("vec_id") == F.col("p_partkey"), "left")
    return R.excluded(both, [(F.col("vec_id").isNull(), "no vector"), (F.col("p_size") > 40, "too large")]).select("p_partkey", "reason")


@query(f"""WITH {NODES_SQL}, {NEXT}, k AS (SELECT least(p.p_type, q.p_type) AS a, greatest(p.p_type, q.p_type) AS b FROM pairs JOIN part p ON p.p_partkey = asset_a JOIN part q ON q.p_partkey = asset_b),
g AS (SELECT a, b, count(*) AS m FROM k GROUP BY a, b)
SELECT CAST(sum(m) AS BIGINT) AS n_edges, count(*) AS n_keys, {r6("1 - CAST(count(*) AS DOUBLE) / nullif(CAST(sum(m) AS DOUBLE), 0e0)")} AS hit_rate FROM g""")
def pair_collapse(spark, d):
    t = nodes(spark, d).join(load(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("text")), "asset")
    return R.collapsed(R.next_edges(t, ["text"]), "text_a", "text_b")


@query(f"""WITH {NODES_SQL}, c AS (SELECT house, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM nodes GROUP BY house)
SELECT n.house, {mean("x")} AS cx, {mean("y")} AS cy, {mean("z")} AS cz, {r6("sqrt(max((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)))")} AS max_radius, {r6("var_pop(x)")} AS vx, {r6("var_pop(y)")} AS vy
FROM nodes n JOIN c ON c.house = n.house GROUP BY n.house""")
def cloud_stats(spark, d):
    return S.moments(nodes(spark, d), "house")


@query(f"WITH {NODES_SQL} SELECT house, max(x) - min(x) AS dx, {r6('max(y) - min(y)')} AS dy, {r6('max(z) - min(z)')} AS dz, {r6('(max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))')} AS volume FROM nodes GROUP BY house")
def bbox(spark, d):
    return S.boxes(nodes(spark, d), "house")


@query(f"""WITH q AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
m AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT count(*) AS quarantined, max(n) AS manifest, coalesce({r6("CAST(count(*) AS DOUBLE) / nullif(max(n), 0)")}, 0e0) AS rate FROM (SELECT user_id FROM q EXCEPT SELECT user_id FROM a) x CROSS JOIN m""")
def quarantine_rate(spark, d):
    e = load(spark, d, "events")
    users = lambda kind: e.where(F.col("event_type") == kind).select("user_id").distinct()
    bad = users("error").subtract(users("purchase")).agg(F.count("*").alias("quarantined"))
    both = bad.crossJoin(F.broadcast(e.agg(F.count_distinct("user_id").alias("manifest"))))  # one row each
    rate = both.withColumn("rate", S.share(F.col("quarantined"), F.col("manifest")))
    return rate.withColumn("manifest", F.when(F.col("quarantined") > 0, F.col("manifest")))


@query("SELECT event_type AS resource, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 1e2 AS total, count(*) AS n FROM events GROUP BY event_type")
def cost_totals(spark, d):
    return S.ledger(load(spark, d, "events"), "event_type", "value")


@query("""SELECT coalesce(l_returnflag, 'all') AS variant, coalesce(l_linestatus, 'all') AS condition, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def table1_cube(spark, d):
    return S.cube(load(spark, d, "lineitem"), {"l_returnflag": "variant", "l_linestatus": "condition"}, n=F.count("*"), quantity=F.sum(F.col("l_quantity").cast("long")))


@query("""WITH v AS (SELECT DISTINCT l_returnflag AS variant FROM lineitem), c AS (SELECT DISTINCT o_orderpriority AS condition FROM orders),
f AS (SELECT l_returnflag AS variant, o_orderpriority AS condition, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate GROUP BY l_returnflag, o_orderpriority)
SELECT v.variant, c.condition, coalesce(CAST(f.n AS VARCHAR(20)), 'NA') AS cell, CASE WHEN f.n IS NULL THEN 'NA' WHEN f.n < 30 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'value' END AS kind
FROM v CROSS JOIN c LEFT JOIN f ON f.variant = v.variant AND f.condition = c.condition""")
def cell_grid(spark, d):
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    cells = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate < o_orderdate").groupBy(F.col("l_returnflag").alias("variant"), F.col("o_orderpriority").alias("condition")).agg(F.count("*").alias("n"))
    return S.grid(li.select(F.col("l_returnflag").alias("variant")), o.select(F.col("o_orderpriority").alias("condition")), cells, 30)


@query(f"""WITH h AS (SELECT l_orderkey AS house, count(*) AS n, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done, sum(CAST(l_quantity AS BIGINT)) AS score FROM lineitem GROUP BY l_orderkey)
SELECT n AS n_objects, count(*) AS n_total, count(CASE WHEN done = n THEN 1 END) AS n_complete, count(CASE WHEN done < n THEN 1 END) AS n_incomplete, coalesce({r6("CAST(count(CASE WHEN done = n THEN 1 END) AS DOUBLE) / nullif(count(*), 0)")}, 0e0) AS completion_rate,
{r6("CAST(sum(CASE WHEN done = n THEN score END) AS DOUBLE) / nullif(count(CASE WHEN done = n THEN 1 END), 0)")} AS mean_over_complete FROM h GROUP BY n""")
def scene_scores(spark, d):
    h = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_objects"), (F.count_if(F.col("l_linestatus") == "F") == F.count("*")).alias("complete"), F.sum(F.col("l_quantity").cast("long")).alias("score"))
    return S.completion(h, "n_objects")


@query("""SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS running, CAST(round(value * 100) AS BIGINT) - lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def metric_series(spark, d):
    return S.series(load(spark, d, "events"), "user_id", ["ts", "event_id"], F.round(F.col("value") * 100).cast("long")).select("event_id", "user_id", "running", "delta")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id FROM r WHERE (rn - 1) % (CAST(floor(n / 20) AS BIGINT) + 1) = 0 OR rn = n""")
def downsample(spark, d):
    return S.downsampled(load(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 20).drop("ts")


@query(f"SELECT user_id, count(*) AS done, {r6('count(*) * 1e6 / nullif(max(epoch_us(ts)) - min(epoch_us(ts)), 0)')} AS per_second FROM events GROUP BY user_id")
def throughput(spark, d):
    return S.throughput(load(spark, d, "events"), "user_id", "ts")


@query("""SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS number FROM events""")
def equation_numbers(spark, d):
    """A purchase takes two numbers, a click one, anything else none."""
    rows = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return S.series(load(spark, d, "events"), "user_id", ["ts", "event_id"], rows.cast("long")).select("event_id", "user_id", F.col("running").alias("number"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, CAST(rn AS BIGINT) AS rn, l_partkey, l_extendedprice FROM r WHERE rn <= 2""")
def topk_per_group(spark, d):
    return S.top_k(load(spark, d, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"], 2).select("l_orderkey", "rn", "l_partkey", "l_extendedprice")


@query(f"WITH {SPLIT} SELECT id, split FROM split")
def split_80_20(spark, d):
    return R.seeded_split(load(spark, d, "orders"), "o_orderkey", 42)


@query(f"""WITH {SPLIT}, c AS (SELECT count(CASE WHEN split = 'test' THEN 1 END) AS n_test, count(*) AS n_all FROM split)
SELECT 'A' AS protocol, n_test AS n_query, n_test AS n_gallery FROM c UNION ALL SELECT 'B', n_test, n_all FROM c""")
def eval_protocols(spark, d):
    return R.protocols(R.seeded_split(load(spark, d, "orders"), "o_orderkey", 42))


@query(f"WITH {NODES_SQL}, {SPLIT} SELECT house, idx, asset FROM nodes WHERE EXISTS (SELECT 1 FROM split WHERE id = house AND split = 'train') AND EXISTS (SELECT 1 FROM part WHERE p_partkey = asset AND p_size > 10)")
def enumerate_samples(spark, d):
    train = R.seeded_split(load(spark, d, "orders"), "o_orderkey", 42).where("split = 'train'")
    big = load(spark, d, "part").where("p_size > 10")
    return R.admitted(R.admitted(nodes(spark, d).select("house", "idx", "asset"), "house", (train, "id")), "asset", (big, "p_partkey"))


@query(f"WITH {EDGES} SELECT house, i, j FROM support UNION SELECT house, i, j FROM adjacency")
def semantic_candidates(spark, d):
    return _support(spark, d).union(R.near_edges(nodes(spark, d), 2)).distinct()


@query(f"WITH {EDGES} SELECT house, i, j FROM adjacency EXCEPT SELECT house, i, j FROM support")
def adjacency_minus_support(spark, d):
    return R.near_edges(nodes(spark, d), 2).subtract(_support(spark, d))


@query(f"WITH {EDGES} SELECT house, i, j FROM adjacency UNION ALL SELECT house, j AS i, i AS j FROM adjacency")
def symmetric_edges(spark, d):
    return R.symmetric_edges(R.near_edges(nodes(spark, d), 2))


@query("""SELECT user_id, bool_and(event_type <> 'error') AS all_ready, bool_or(event_type = 'purchase') AS any_ready, count(CASE WHEN event_type IN ('purchase', 'error') THEN 1 END) = count(*) AS all_settled FROM events GROUP BY user_id""")
def join_readiness(spark, d):
    return S.readiness(load(spark, d, "events"), "user_id", "event_type", "purchase", "error")


@query("""SELECT user_id, min(ts) AS started, count(CASE WHEN event_type IN ('purchase', 'error') THEN 1 END) AS ended FROM events GROUP BY user_id HAVING count(CASE WHEN event_type IN ('purchase', 'error') THEN 1 END) <= 5""")
def unfinished_runs(spark, d):
    return S.unfinished(load(spark, d, "events"), "user_id", "ts", F.col("event_type").isin("purchase", "error"), 6)


@query(f"SELECT p_partkey, {MASK.format('text')} AS text, {MASK.format('image')} AS image, {MASK.format('pc')} AS pc FROM part")
def modality_mask(spark, d):
    return _masks(spark, d)


@query(f"""WITH m AS (SELECT {MASK.format('text')} AS text, {MASK.format('image')} AS image, {MASK.format('pc')} AS pc FROM part)
SELECT {r6("avg(CASE WHEN text THEN 0e0 ELSE 1e0 END)")} AS text, {r6("avg(CASE WHEN image THEN 0e0 ELSE 1e0 END)")} AS image, {r6("avg(CASE WHEN pc THEN 0e0 ELSE 1e0 END)")} AS pc, {r6("avg(CASE WHEN text OR image OR pc THEN 0e0 ELSE 1e0 END)")} AS all_masked FROM m""")
def mask_rates(spark, d):
    return S.mask_rates(_masks(spark, d), ["text", "image", "pc"])


@query("SELECT d.doc_id, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND d.n_chars <= 2000")
def encode_worklist(spark, d):
    d_ = load(spark, d, "documents").where("n_chars <= 2000").select("doc_id", "source")
    return R.admitted(d_, "doc_id", (load(spark, d, "labels").where("quality = 1"), "doc_id"))


@query(f"WITH {NODES_SQL} SELECT house, count(*) AS n_nodes, count(*) - 1 AS n_chain, count(DISTINCT asset) AS n_assets FROM nodes GROUP BY house")
def scene_index(spark, d):
    return S.scene_sizes(nodes(spark, d), "house", "asset")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def failure_counts(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT lang AS stage, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY lang")
def stage_counts(spark, d):
    return load(spark, d, "documents").groupBy(F.col("lang").alias("stage")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


@query(f"WITH {NODES_SQL} SELECT house, idx, asset FROM nodes")
def node_index(spark, d):
    return nodes(spark, d).select("house", "idx", "asset")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_sorted(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT DISTINCT l_partkey AS asset FROM lineitem")
def keys_in_use(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("asset")).distinct()


@query("""SELECT l_orderkey AS house, count(*) AS views, count(DISTINCT sha256(concat(CAST(l_partkey AS VARCHAR(20)), l_returnflag))) AS distinct_views,
count(CASE WHEN l_quantity < 2 THEN 1 END) AS blank, count(CASE WHEN l_quantity < 2 THEN 1 END) = count(*) AS all_blank FROM lineitem GROUP BY l_orderkey""")
def distinct_views(spark, d):
    li = load(spark, d, "lineitem").withColumn("house", F.col("l_orderkey"))
    return S.view_checks(li, "house", F.sha2(F.concat("l_partkey", "l_returnflag"), 256), F.col("l_quantity") < 2)
