"""Queries over vectors, modalities and points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from orbweave.functions import vectors as V
from orbweave.operators import cameras, clouds
from orbweave.operators.aggregates import vector_aggregates
from orbweave.operators.sampling import draw_exactly, farthest
from orbweave.plans.registry import query
from orbweave.sources.tables import NODES_SQL, load, nodes

# Three modalities of one vector: as it is, reversed and negated; presence by bits of the id.
SLOTS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS t, list_reverse(CAST(embedding AS DOUBLE[])) AS i, list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x / 2) AS p,
CASE WHEN vec_id & 1 > 0 THEN 1e0 ELSE 0e0 END AS mt, CASE WHEN vec_id & 2 > 0 THEN 1e0 ELSE 0e0 END AS mi, CASE WHEN vec_id & 4 > 0 THEN 1e0 ELSE 0e0 END AS mp FROM embeddings),
u AS (SELECT vec_id, unnest(t) AS t, unnest(i) AS i, unnest(p) AS p, unnest(range(64)) AS pos, mt, mi, mp FROM e)"""


def _r6(x):
    return f"floor(({x}) * 1e6 + 5e-1) / 1e6"


def slots(spark, d):
    v = V.doubles(F.col("embedding"))
    bit = lambda b: F.col("vec_id").bitwiseAND(F.lit(b)) > 0
    e = load(spark, d, "embeddings").select("vec_id", v.alias("t"), F.reverse(v).alias("i"), F.transform(v, lambda x: -x / 2).alias("p"))
    return e, [F.col("t"), F.col("i"), F.col("p")], [bit(1), bit(2), bit(4)]


def _long(df, value):
    out = df.select("vec_id", F.posexplode(value).alias("pos", "v"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), V.r6(F.col("v")).alias("v"))


@query(f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e), u AS (SELECT vec_id, n, unnest(v) AS x, unnest(range(64)) AS pos FROM n) SELECT vec_id, pos, {_r6('x / greatest(n, 1e-12)')} AS v FROM u")
def l2_normalise(spark, d):
    e, (t, _, _), _ = slots(spark, d)
    return _long(e, V.unit(t))


@query(f"SELECT vec_id, {_r6('sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))')} AS norm FROM embeddings")
def vector_norm(spark, d):
    e, (t, _, _), _ = slots(spark, d)
    return e.select("vec_id", V.r6(V.norm(t)).alias("norm"))


@query(f"WITH {SLOTS} SELECT vec_id, pos, {_r6('CASE WHEN mi > 0 THEN i ELSE 1e-2 * pos END')} AS v FROM u")
def mask_fill(spark, d):
    """An absent image becomes a learned token; here the ramp 0.01 * position."""
    e, (t, i, _), (_, mi, _) = slots(spark, d)
    return _long(e, F.when(mi, i).otherwise(F.transform(t, lambda x, n: n * F.lit(0.01))))


@query(f"WITH {SLOTS} SELECT vec_id, pos, {_r6('(t * mt + i * mi + p * mp) / greatest(mt + mi + mp, 1e0)')} AS v FROM u")
def fuse_mean(spark, d):
    e, s, m = slots(spark, d)
    return _long(e, V.mean_of(s, m))


@query(f"WITH {SLOTS} SELECT vec_id, pos, {_r6('CASE WHEN mt + mi + mp > 0 THEN (t * mt * exp(2e-1) + i * mi * exp(-1e-1) + p * mp * exp(4e-1)) / (mt * exp(2e-1) + mi * exp(-1e-1) + mp * exp(4e-1)) ELSE (t + i + p) / 3 END')} AS v FROM u")
def fuse_gated(spark, d):
    e, s, m = slots(spark, d)
    w = V.softmax_weights([0.2, -0.1, 0.4], m)
    e = e.select("vec_id", *[V.scaled(x, k).alias(n) for x, k, n in zip(s, w, "tip")])
    return _long(e, V.add(V.add(F.col("t"), F.col("i")), F.col("p")))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _mlp(fused: pd.Series) -> pd.Series:
    import numpy as np

    if not len(fused):
        return fused
    x = np.stack(fused)
    n = x.shape[1]
    w = np.sin(np.arange(n * 16).reshape(n, 16) * 0.37) / np.sqrt(n)
    h = x @ w
    h = h * 0.5 * (1 + np.tanh(0.7978845608 * (h + 0.044715 * h**3)))
    return pd.Series(list(h @ w[:64].T))


@query()
def fuse_mlp(spark, d):
    """Linear, GELU, linear on the mean, with supplied weights, in Arrow batches."""
    e, s, m = slots(spark, d)
    return e.select("vec_id", _mlp(V.mean_of(s, m)).alias("fused"))


@query()
def fuse_masked_mlp(spark, d):
    """The same on all three slots side by side; absent ones hold a learned token, here the
    ramp 0.01 * position."""
    e, s, m = slots(spark, d)
    token = [F.when(p, x).otherwise(F.transform(x, lambda _, n: n * F.lit(0.01))) for x, p in zip(s, m)]
    return e.select("vec_id", _mlp(F.concat(*token)).alias("fused"))


@query(f"WITH {SLOTS} SELECT vec_id, pos, {_r6('(t * mt + i * mi + p * mp) / greatest(mt + mi + mp, 1e0) + CASE WHEN vec_id % 5 = 0 THEN 0e0 ELSE 5e-1 * p END')} AS v FROM u")
def layout_residual(spark, d):
    e, s, m = slots(spark, d)
    layout = F.transform(s[2], lambda x: F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(x))
    return _long(e, V.add(V.mean_of(s, m), layout, 0.5))


@query(f"WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS pos FROM embeddings) SELECT label, pos, {_r6('avg(v)')} AS mean, {_r6('max(v)')} AS most FROM x GROUP BY label, pos")
def pool_views(spark, d):
    e = load(spark, d, "embeddings").select("label", "embedding")
    both = vector_aggregates(e, ["label"], "embedding", {"mean": "mean", "most": "max"})
    return both.select("label", F.posexplode(F.arrays_zip("mean", "most")).alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), V.r6(F.col("v.mean")).alias("mean"), V.r6(F.col("v.most")).alias("most"))


@query(f"WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS pos FROM embeddings) SELECT label, pos, count(*) AS n, {_r6('ln(sum(exp(v * 10)))')} AS lse FROM x GROUP BY label, pos")
def logsumexp_views(spark, d):
    e = load(spark, d, "embeddings").select("label", F.transform(V.doubles(F.col("embedding")), lambda x: x * 10).alias("v"))
    a = vector_aggregates(e, ["label"], "v", {"lse": "logsumexp"})
    return a.select("label", "n", F.posexplode("lse").alias("pos", "lse")).select("label", F.col("pos").cast("long").alias("pos"), "n", V.r6(F.col("lse")).alias("lse"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 AS non_finite FROM embeddings")
def non_finite(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).alias("non_finite"))


@query("""WITH m AS (SELECT CAST(range AS BIGINT) AS mask FROM range(1, 8)), e AS (SELECT vec_id, vec_id % 8 AS bits FROM embeddings)
SELECT mask, count(*) AS n, count(CASE WHEN bits & mask = mask THEN 1 END) AS complete, count(CASE WHEN bits & mask > 0 THEN 1 END) AS usable FROM e CROSS JOIN m GROUP BY mask""")
def modality_conditions(spark, d):
    """Seven subsets of three modalities: rows that hold all or any of a subset."""
    e = load(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("bits"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("mask"))
    both = F.col("bits").bitwiseAND(F.col("mask"))
    return e.groupBy("mask").agg(F.count("*").alias("n"), F.count_if(both == F.col("mask")).alias("complete"), F.count_if(both > 0).alias("usable"))


@query("SELECT e.vec_id, CAST(len(embedding) + 64 AS BIGINT) AS width, d.lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def assemble_examples(spark, d):
    """Vectors and records joined by id, two modalities side by side."""
    e, (t, i, _), _ = slots(spark, d)
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return e.join(docs, e.vec_id == docs.doc_id).select("vec_id", F.size(F.concat(t, i)).cast("long").alias("width"), "lang")


_PC = f"""{NODES_SQL}, c AS (SELECT house, idx, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM nodes WINDOW w AS (PARTITION BY house)),
r AS (SELECT *, max(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY house) AS r FROM c),
pc AS (SELECT house, idx, {_r6('CASE WHEN r > 0 THEN x / r ELSE 0e0 END')} AS x, {_r6('CASE WHEN r > 0 THEN y / r ELSE 0e0 END')} AS y, {_r6('CASE WHEN r > 0 THEN z / r ELSE 0e0 END')} AS z, r = 0 AS degenerate FROM r)"""


@query(f"WITH {_PC} SELECT * FROM pc")
def pc_norm(spark, d):
    """Points about their centroid, scaled to radius 1; one point is degenerate, not NaN."""
    n = clouds.normalised(nodes(spark, d).select("house", "idx", "x", "y", "z"), "house")
    return n.select("house", "idx", *[V.r6(F.col(c)).alias(c) for c in "xyz"], "degenerate")


@query(f"WITH {_PC} SELECT house, idx, x, y, z, 5e-1 AS r, 5e-1 AS g, 5e-1 AS b FROM pc")
def depth_shell(spark, d):
    """All houses as inputs of a point encoder, shown point by point; those of one place are zeros."""
    n = nodes(spark, d).select("house", "idx", "x", "y", "z")
    s = clouds.shells(n, "house", "idx", 10_000, degenerate=True).select("house", F.posexplode("cloud").alias("idx", "p"))
    return s.select("house", F.col("idx").cast("long").alias("idx"), *[(V.r6(F.get("p", F.lit(i))) if i < 3 else F.get("p", F.lit(i))).alias(c) for i, c in enumerate("xyzrgb")])


def _transform(n):
    return n.select("house", "idx", V.r6(0.6 * F.col("x") - 0.8 * F.col("y") + 1).alias("x"), V.r6(0.8 * F.col("x") + 0.6 * F.col("y") - 2).alias("y"), V.r6(F.col("z") + 3).alias("z"))


@query(f"WITH {NODES_SQL} SELECT house, idx, {_r6('6e-1 * x - 8e-1 * y + 1')} AS x, {_r6('8e-1 * x + 6e-1 * y - 2')} AS y, {_r6('z + 3')} AS z FROM nodes")
def apply_transform(spark, d):
    return _transform(nodes(spark, d))


_BOXES = f"""{NODES_SQL}, f AS (SELECT house, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS reach FROM nodes GROUP BY house),
o AS (SELECT house, k, cx, cy, cz, cx + reach * 15e-1 * cos(radians(20e0)) * cos(k * 2 * pi() / 11) AS x, cy + reach * 15e-1 * cos(radians(20e0)) * sin(k * 2 * pi() / 11) AS y, cz + reach * 15e-1 * sin(radians(20e0)) AS z FROM (SELECT *, unnest(range(11)) AS k FROM f))"""


def _r4(c):
    return F.floor(c * 1e4 + 0.5) / 1e4


def _orbit(spark, d):
    return cameras.place_cameras(cameras.frames_of(nodes(spark, d), "house"), 11, lambda k, n: cameras.orbit_directions(k, n, 20.0), 1.5)


@query(f"WITH {_BOXES} SELECT house, k, floor(x * 1e4 + 5e-1) / 1e4 AS x, floor(y * 1e4 + 5e-1) / 1e4 AS y, floor(z * 1e4 + 5e-1) / 1e4 AS z FROM o")
def orbit_dirs(spark, d):
    """Eleven cameras around each house, 20 degrees above its middle."""
    return _orbit(spark, d).select("house", "k", *[_r4(F.col(c)).alias(c) for c in "xyz"])


@query(f"""WITH {_BOXES}, a AS (SELECT *, acos(1 - 2 * (k + 5e-1) / 7) AS phi, pi() * (1 + sqrt(5e0)) * (k + 5e-1) AS theta FROM (SELECT *, unnest(range(7)) AS k FROM f))
SELECT house, k, floor((cx + reach * 2e0 * cos(theta) * sin(phi)) * 1e4 + 5e-1) / 1e4 AS x, floor((cy + reach * 2e0 * sin(theta) * sin(phi)) * 1e4 + 5e-1) / 1e4 AS y, floor((cz + reach * 2e0 * cos(phi)) * 1e4 + 5e-1) / 1e4 AS z FROM a""")
def fibonacci_dirs(spark, d):
    """Seven cameras spread over a sphere around each house."""
    c = cameras.place_cameras(cameras.frames_of(nodes(spark, d), "house"), 7, cameras.sphere_directions, 2.0)
    return c.select("house", "k", *[_r4(F.col(a)).alias(a) for a in "xyz"])


@query(f"""WITH {_BOXES}, b AS (SELECT house, k, x - cx AS x, y - cy AS y, z - cz AS z, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS n, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS m FROM o)
SELECT house, k, {', '.join(f"CASE WHEN n > 0 THEN floor({e} * 1e4 + 5e-1) / 1e4 END AS {c}" for c, e in (("back_x", "x / n"), ("back_y", "y / n"), ("back_z", "z / n"), ("right_x", "-y / m"), ("right_y", "x / m"), ("up_z", "m / n")))} FROM b""")
def look_at(spark, d):
    """Axes of the orbit's cameras, which look at the middle of their house."""
    axes = cameras.look_at(_orbit(spark, d))
    return axes.select("house", "k", *[_r4(F.col(c)).alias(c) for c in ("back_x", "back_y", "back_z", "right_x", "right_y", "up_z")])


_PIXELS = "p AS (SELECT p_partkey AS k, (p_partkey % 16 + 5e-1) / 16 * 2 - 1 AS u, 1 - (floor(p_partkey / 16) % 16 + 5e-1) / 16 * 2 AS v, p_retailprice / 1000 AS depth FROM part)"


def _pixels(spark, d):
    col, row = F.col("p_partkey") % 16, F.floor(F.col("p_partkey") / 16) % 16
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), ((col + 0.5) / 16 * 2 - 1).alias("u"), (1 - (row + 0.5) / 16 * 2).alias("v"), (F.col("p_retailprice") / 1000).alias("depth"))


def _world(p, pitch=20.0, yaw=30.0):
    """World points of pixels (u, v, depth) with the columns before them."""
    half = F.tan(F.radians(F.lit(60.0)) / 2)
    yaw = yaw if isinstance(yaw, Column) else F.lit(yaw)
    cp, sp, cy, sy = (f(F.radians(a)) for a in (F.lit(pitch), yaw) for f in (F.cos, F.sin))
    x, y, z = F.col("u") * half * F.col("depth"), F.col("v") * half * F.col("depth"), F.col("depth")
    down, ahead = y * cp - z * sp, y * sp + z * cp
    rest = [c for c in p.columns if c not in ("u", "v")]
    return p.select(*rest, V.r6(x * cy + ahead * sy + 1).alias("x"), V.r6(down + 2).alias("y"), V.r6(ahead * cy - x * sy + 3).alias("z"))


@query(f"""WITH {_PIXELS}, c AS (SELECT k, u * tan(radians(60e0) / 2) * depth AS x, v * tan(radians(60e0) / 2) * depth AS y, depth AS z FROM p),
r AS (SELECT k, x, y * cos(radians(20e0)) - z * sin(radians(20e0)) AS y, y * sin(radians(20e0)) + z * cos(radians(20e0)) AS z FROM c)
SELECT k, {_r6('x * cos(radians(30e0)) + z * sin(radians(30e0)) + 1')} AS x, {_r6('y + 2')} AS y, {_r6('z * cos(radians(30e0)) - x * sin(radians(30e0)) + 3')} AS z FROM r""")
def unproject(spark, d):
    """Pixels with depth to world points: pitch, then yaw, then the camera's place."""
    return _world(_pixels(spark, d)).select("k", "x", "y", "z")


# Frames of assets (suppliers): a view for each line number, its yaw by the view; rays that
# hit nothing have infinite depths, of either sign, or lie beyond the cut.
_FRAMES = """f AS (SELECT l_suppkey AS asset, l_linenumber AS view, l_orderkey AS pixel, (l_orderkey % 16 + 5e-1) / 16 * 2 - 1 AS u, 1 - (l_orderkey // 16 % 16 + 5e-1) / 16 * 2 AS v,
CASE WHEN l_quantity = 1 THEN CAST('inf' AS DOUBLE) WHEN l_quantity = 2 THEN CAST('-inf' AS DOUBLE) ELSE l_extendedprice / 30000 END AS depth, row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_orderkey ORDER BY l_extendedprice, l_partkey, l_quantity, l_tax, l_discount) AS again FROM lineitem)"""


def frames(spark, d):
    li = load(spark, d, "lineitem")
    again = F.row_number().over(W.partitionBy("l_suppkey", "l_linenumber", "l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_quantity", "l_tax", "l_discount"))
    depth = F.when(F.col("l_quantity") == 1, float("inf")).when(F.col("l_quantity") == 2, float("-inf")).otherwise(F.col("l_extendedprice") / 30000)
    u, v = (F.col("l_orderkey") % 16 + 0.5) / 16 * 2 - 1, 1 - (F.floor(F.col("l_orderkey") / 16) % 16 + 0.5) / 16 * 2
    return li.select(F.col("l_suppkey").alias("asset"), F.col("l_linenumber").alias("view"), F.col("l_orderkey").alias("pixel"), again.alias("again"), u.alias("u"), v.alias("v"), depth.alias("depth"))


def fused(frames, far: float, n: int):
    """(asset, at, view, x, y, z): exactly n world points of each asset, of the hits of all
    its views, in the order of a hash; an asset with fewer hits repeats them, one without
    any gives none (see unseen). Depths that aren't finite or not under `far` are no hits."""
    hits = frames.where((F.col("depth") < far) & (F.col("depth") > float("-inf")))
    h = F.md5(F.concat_ws(":", "asset", "view", "pixel", "again"))
    world = _world(hits.withColumn("by", F.conv(F.substring(h, 1, 15), 16, 10).cast("long")), 20.0, F.col("view") * 30.0)
    return draw_exactly(world.select("asset", "view", "by", "x", "y", "z"), "asset", "by", n).drop("by")


def unseen(frames, far: float):
    """(asset): assets that no view hits."""
    hit = F.max((F.col("depth") < far) & (F.col("depth") > float("-inf")))
    return frames.groupBy("asset").agg(F.coalesce(hit, F.lit(False)).alias("hit")).where("not hit").select("asset")


@query(f"""WITH {_FRAMES}, h AS (SELECT * FROM f WHERE isfinite(depth) AND depth < 12e-1), c AS (SELECT *, u * tan(radians(60e0) / 2) * depth AS cx, v * tan(radians(60e0) / 2) * depth AS cy, radians(view * 30e0) AS yaw FROM h),
r AS (SELECT *, cy * cos(radians(20e0)) - depth * sin(radians(20e0)) AS ry, cy * sin(radians(20e0)) + depth * cos(radians(20e0)) AS rz FROM c),
w AS (SELECT asset, view, {_r6('cx * cos(yaw) + rz * sin(yaw) + 1')} AS x, {_r6('ry + 2')} AS y, {_r6('rz * cos(yaw) - cx * sin(yaw) + 3')} AS z,
row_number() OVER (PARTITION BY asset ORDER BY substring(md5(asset || ':' || view || ':' || pixel || ':' || again), 1, 15)) - 1 AS rank, count(*) OVER (PARTITION BY asset) AS have FROM r)
SELECT asset, unnest(range(rank, 500, have)) AS at, view, x, y, z FROM w WHERE rank < 500""")
def fuse_depth(spark, d):
    """500 points of each asset from the hits of its views."""
    return fused(frames(spark, d), 1.2, 500)


@query()
def rewrite_struct(spark, d):
    """Rooms as nested records, their ceilings emptied and one object kept."""
    n = load(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.array("n_name").alias("ceilings")))).alias("rooms"))
    return n.select("n_regionkey", F.transform("rooms", lambda r: r.withField("ceilings", F.slice(r["ceilings"], 1, 0))).alias("rooms"), F.filter("rooms", lambda r: r["id"] == F.array_min(F.transform("rooms", lambda q: q["id"]))).alias("kept"))


@query()
def farthest_points(spark, d):
    return farthest(nodes(spark, d), 3)
