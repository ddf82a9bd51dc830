"""Retrieval and evaluation over embeddings. Queries are rows whose id 20 divides; each is
compared with all other rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.functions.vectors import doubles, r6
from orbweave.operators.compose import compose
from orbweave.operators.search import batch_losses, scores, self_found, target_ranks
from orbweave.plans.registry import query
from orbweave.sources import tables
from orbweave.sources.tables import file_inventory, load

SIMS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, g.vec_id AS id, g.label, q.label AS query_label, floor(list_cosine_similarity(q.v, g.v) * 1e9 + 5e-1) / 1e9 AS sim
FROM e q JOIN e g ON q.vec_id % 20 = 0 AND g.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)"""


def _sides(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles(F.col("embedding")).alias("vec"))
    return e.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("label").alias("query_label"), "vec"), e


def _top(spark, d, k):
    q, g = _sides(spark, d)
    return scores(q.drop("query_label"), g, k).join(q.select("query_id", "query_label"), "query_id")


@query(f"""WITH {SIMS} SELECT query_id, rank, id, floor(sim * 1e6 + 5e-1) / 1e6 AS sim, label = query_label AS hit, max(CASE WHEN label = query_label THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS recalled FROM r WHERE rank <= 5""")
def retrieve_topk(spark, d):
    hit = F.col("label") == F.col("query_label")
    return _top(spark, d, 5).select("query_id", "rank", "id", r6(F.col("sim")).alias("sim"), hit.alias("hit"), F.max(hit.cast("int")).over(W.partitionBy("query_id")).alias("recalled"))


@query(f"""WITH {SIMS}, h AS (SELECT query_id, query_label, max(CASE WHEN rank = 1 AND label = query_label THEN 1e0 ELSE 0e0 END) AS h1, max(CASE WHEN label = query_label THEN 1e0 ELSE 0e0 END) AS h5 FROM r WHERE rank <= 5 GROUP BY query_id, query_label)
SELECT query_label AS condition, count(*) AS n_query, floor(avg(h1) * 1e6 + 5e-1) / 1e6 AS r1, floor(avg(h5) * 1e6 + 5e-1) / 1e6 AS r5 FROM h GROUP BY query_label""")
def recall_at_k(spark, d):
    hit = F.col("label") == F.col("query_label")
    h = _top(spark, d, 5).groupBy("query_id", "query_label").agg(F.max(F.when(hit & (F.col("rank") == 1), 1.0).otherwise(0.0)).alias("h1"), F.max(F.when(hit, 1.0).otherwise(0.0)).alias("h5"))
    return h.groupBy(F.col("query_label").alias("condition")).agg(F.count("*").alias("n_query"), r6(F.avg("h1")).alias("r1"), r6(F.avg("h5")).alias("r5"))


@query(f"""WITH {SIMS}, t AS (SELECT query_id, max(sim) AS best FROM s WHERE label = query_label GROUP BY query_id)
SELECT s.query_id, 1 + count(CASE WHEN s.sim > t.best THEN 1 END) AS target_rank FROM s JOIN t ON t.query_id = s.query_id GROUP BY s.query_id""")
def target_rank(spark, d):
    """Rank of the best row of the query's own label, safe under ties."""
    return target_ranks(*_sides(spark, d))


@query(f"WITH {SIMS} SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids, max(sim) AS best, min(sim) AS fifth FROM r WHERE rank <= 5 GROUP BY query_id")
def retrieval_trace(spark, d):
    t = _top(spark, d, 5).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("t"), F.max("sim").alias("best"), F.min("sim").alias("fifth"))
    return t.select("query_id", F.array_join(F.transform("t", lambda x: x["id"].cast("string")), ",").alias("ids"), "best", "fifth")


@query(f"WITH {SIMS} SELECT query_id, id AS chosen, row_number() OVER (ORDER BY query_id) - 1 AS step FROM r WHERE rank = 1")
def compose_parallel(spark, d):
    """One retrieval for all slots at once; slots keep the order of their query. They are
    numbered in blocks of ids, which the sizes of earlier blocks move up."""
    top = _top(spark, d, 1).select("query_id", F.col("id").alias("chosen"), F.floor(F.col("query_id") / 65536).alias("block"))
    sizes = top.groupBy("block").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("block").orderBy("query_id"))
    moved = top.withColumn("place", place).join(sizes.select("block", before.alias("before")), "block")
    return moved.select("query_id", "chosen", (F.col("before") + F.col("place") - 1).alias("step"))


def _scenes(spark, d, slots):
    """Scenes of the query rows of `slots` consecutive query ids, and the gallery."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("region"), doubles(F.col("embedding")).alias("vec"))
    scene = F.floor(F.col("id") / (20 * slots)).cast("long")
    return e.where(F.col("id") % 20 == 0).select(scene.alias("scene"), F.col("id").alias("query_id"), "vec", "region"), e


@query()
def compose_iterative(spark, d, slots: int = 25, weight: float = 0.3):
    """Slots of a scene filled one after another; each choice shifts the next query."""
    return compose(*_scenes(spark, d, slots), "iterative", weight)[0]


@query()
def compose_region(spark, d):
    """Scenes of up to five slots filled from the region of each query (its label)."""
    return compose(*_scenes(spark, d, 5), "region")[0]


@query("SELECT vec_id // 600 AS scene, count(*)::INT AS n_queries, least(count(*), 7)::INT AS placed, least(count(*), 7)::INT AS calls, CASE WHEN count(*) > 7 THEN 'EXHAUSTED' ELSE 'SUCCESS' END AS status, CASE WHEN count(*) > 7 THEN 'object_budget' END AS terminated_by FROM embeddings WHERE vec_id % 20 = 0 GROUP BY vec_id // 600")
def compose_exits(spark, d):
    """How scenes of up to 30 slots end if seven objects are allowed."""
    return compose(*_scenes(spark, d, 30), max_objects=7)[1]


@query(f"""WITH {SIMS}, k AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id // 600 ORDER BY query_id) - 1 AS step FROM r WHERE rank = 1)
SELECT query_id // 600 AS scene, step, query_id, id AS chosen, floor(sim * 1e6 + 5e-1) / 1e6 AS sim FROM k WHERE step < 25""")
def compose_at_once(spark, d):
    """All slots of a scene by one retrieval, within the budget of 25 objects."""
    objects, _ = compose(*_scenes(spark, d, 30), "parallel")
    return objects.withColumn("sim", r6(F.floor(F.col("sim") * 1e9 + 0.5) / 1e9))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, g.vec_id AS id, floor(list_cosine_similarity(q.v, g.v) * 1e9 + 5e-1) / 1e9 AS sim FROM e q JOIN e g ON q.vec_id % 20 = 0)
SELECT query_id, max(CASE WHEN id = query_id THEN sim END) = max(sim) AS found FROM s GROUP BY query_id""")
def self_retrieval(spark, d):
    """Whether a row of the index is among the best matches of its own vector, ties included."""
    q, g = _sides(spark, d)
    return self_found(q, g)


BATCH = """e AS (SELECT vec_id, CAST(floor(vec_id / 32) AS BIGINT) AS batch, CAST(embedding AS DOUBLE[]) AS q, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + 2e-1 * sin(CAST(vec_id * 64 + i AS DOUBLE))) AS g FROM embeddings),
s AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.q, b.g) AS sim FROM e a JOIN e b ON a.batch = b.batch)"""


def _batches(spark, d):
    """Losses of towers q and g in batches of 32 ids."""
    v = doubles(F.col("embedding"))
    other = F.transform(v, lambda x, i: x + F.lit(0.2) * F.sin((F.col("vec_id") * 64 + i + 1).cast("double")))
    e = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).cast("long").alias("batch"), v.alias("q"), other.alias("g"))
    return batch_losses(e, 0.5)


def _loss_sql(side):
    return f"SELECT batch, avg(l) AS l FROM (SELECT batch, {side}, ln(sum(exp(sim / 5e-1))) - max(CASE WHEN i = j THEN sim END) / 5e-1 AS l FROM s GROUP BY batch, {side}) x GROUP BY batch"


@query(f"WITH {BATCH} SELECT batch, floor(l * 1e6 + 5e-1) / 1e6 AS loss FROM ({_loss_sql('i')}) y")
def info_nce(spark, d):
    return _batches(spark, d).select("batch", r6(F.col("forward")).alias("loss"))


@query(f"WITH {BATCH} SELECT a.batch, floor((a.l + b.l) / 2 * 1e6 + 5e-1) / 1e6 AS loss FROM ({_loss_sql('i')}) a JOIN ({_loss_sql('j')}) b ON a.batch = b.batch")
def info_nce_sym(spark, d):
    return _batches(spark, d).select("batch", r6((F.col("forward") + F.col("backward")) / 2).alias("loss"))


@query(f"WITH {BATCH}, m AS (SELECT batch, i, max(sim) AS best, max(CASE WHEN i = j THEN sim END) AS own FROM s GROUP BY batch, i) SELECT batch, count(*) AS n, count(CASE WHEN own >= best - 1e-12 THEN 1 END) AS right_ones FROM m GROUP BY batch")
def batch_accuracy(spark, d):
    return _batches(spark, d).select("batch", "n", "right_ones")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id AS id, floor(floor(list_cosine_similarity(a.v, b.v) * 1e9 + 5e-1) / 1e9 * 1e6 + 5e-1) / 1e6 AS sim FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id""")
def cosine_pairs(spark, d):
    """All pairs of a query and another row."""
    q, g = _sides(spark, d)
    return scores(q.drop("query_label"), g.drop("label"), decimals=6)


@query()
def index_descriptor(spark, d):
    """Size, width and content digest of an index."""
    return tables.index_descriptor(load(spark, d, "embeddings"))


# The ablation variants.
VARIANTS = [
    ("full", True, None, "point_encoder_and_fuser", None, 0.30, "equivariant", "iterative"),
    ("no_iterative", False, "full", None, None, 0.30, "equivariant", "parallel"),
    ("no_layout", True, None, "point_encoder_and_fuser", None, 0.30, None, "iterative"),
    ("layout_gat", True, None, "point_encoder_and_fuser", None, 0.30, "gat", "iterative"),
    ("fusion_mean", True, None, "point_encoder_and_fuser", "mean", 0.30, "equivariant", "iterative"),
    ("fusion_mlp", True, None, "point_encoder_and_fuser", "mlp", 0.30, "equivariant", "iterative"),
    ("dropout_10", True, None, "point_encoder_and_fuser", None, 0.10, "equivariant", "iterative"),
    ("dropout_50", True, None, "point_encoder_and_fuser", None, 0.50, "equivariant", "iterative"),
    ("fuser_only", True, None, "fuser_only", None, 0.30, "equivariant", "iterative"),
    ("zero_pad", True, None, "point_encoder_and_fuser", None, 0.30, "equivariant", "iterative"),
]


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v:e}" if isinstance(v, float) else f"'{v}'"


VARIANT = "variant_id string, requires_training boolean, reuses string, train_scope string, fusion string, dropout double, layout string, mode string"


@query(f"""WITH v(variant_id, requires_training, reuses, train_scope, fusion, dropout, layout, mode, n) AS (VALUES {", ".join(f"({', '.join(map(_value, v))}, {n})" for n, v in enumerate(VARIANTS))}),
r AS (SELECT vec_id % 13 AS n, count(*) AS results FROM embeddings WHERE vec_id % 13 <> 4 GROUP BY vec_id % 13)
SELECT coalesce(variant_id, 'variant ' || r.n) AS variant_id, requires_training, reuses, train_scope, fusion, dropout, layout, mode, coalesce(results, 0) AS results,
CASE WHEN variant_id IS NULL THEN 'not registered' WHEN results IS NULL THEN 'no results' WHEN requires_training THEN 'trained' ELSE 'reuses ' || reuses END AS state FROM v FULL OUTER JOIN r ON r.n = v.n""")
def variant_registry(spark, d):
    """The registered variants against results that name a variant (vectors, by their id)."""
    v = spark.createDataFrame([(*v, n) for n, v in enumerate(VARIANTS)], f"{VARIANT}, n long")
    e = load(spark, d, "embeddings").select((F.col("vec_id") % 13).alias("n")).where("n <> 4")
    both = e.groupBy("n").agg(F.count("*").alias("results")).join(F.broadcast(v), "n", "full")  # one row a variant
    state = F.when(F.col("variant_id").isNull(), "not registered").when(F.col("results").isNull(), "no results").when(F.col("requires_training"), "trained").otherwise(F.concat(F.lit("reuses "), F.col("reuses")))
    name = F.coalesce("variant_id", F.concat(F.lit("variant "), F.col("n").cast("string")))
    names = [c.split(" ")[0] for c in VARIANT.split(", ")][1:]
    return both.select(name.alias("variant_id"), *names, F.coalesce("results", F.lit(0)).alias("results"), state.alias("state"))


@query()
def file_sizes(spark, d):
    """Inventory of the input files: name and whether it exceeds 1,024 bytes."""
    f = file_inventory(spark, d, "*.parquet")
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", (F.col("length") > 1024).alias("plausible"))


@query("SELECT event_type, count(*) AS n, floor(max(value) * 1e6 + 5e-1) / 1e6 AS most FROM events GROUP BY event_type")
def stream_metrics(spark, d):
    from orbweave.streaming.metrics import tail_metrics

    return tail_metrics(spark, d).select("event_type", "n", r6(F.col("most")).alias("most"))
