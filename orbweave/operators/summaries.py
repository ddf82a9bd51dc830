"""Aggregates and windows: boxes, moments, ledgers, cubes, series and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def six(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def share(part: Column, whole: Column) -> Column:
    """part / whole to six decimals, 0 of nothing."""
    return F.coalesce(six(part.cast("double") / F.nullif(whole, F.lit(0))), F.lit(0.0))


def boxes(points: DataFrame, group: str) -> DataFrame:
    """(group, dx, dy, dz, volume) of the box around each group's points."""
    d = [F.max(c) - F.min(c) for c in "xyz"]
    return points.groupBy(group).agg(d[0].alias("dx"), six(d[1]).alias("dy"), six(d[2]).alias("dz"), six(d[0] * d[1] * d[2]).alias("volume"))


def exact_mean(c: Column) -> Column:
    """The mean of numbers of five decimals: whole hundred-thousandths are added, so the sum
    is the same in any order."""
    return F.sum(F.round(c * 100000).cast("long")).cast("double") / (F.count("*") * 1e5)


def moments(points: DataFrame, group: str) -> DataFrame:
    """(group, cx, cy, cz, max_radius, vx, vy) of each group's points: centre, the farthest
    point from it, and variances."""
    centre = points.groupBy(group).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]).withColumnRenamed(group, "g_")
    met = points.join(centre, points[group].eqNullSafe(F.col("g_")))
    d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"])
    return met.groupBy(group).agg(*[exact_mean(F.col(c)).alias(f"c{c}") for c in "xyz"], six(F.sqrt(F.max(d2))).alias("max_radius"), six(F.var_pop("x")).alias("vx"), six(F.var_pop("y")).alias("vy"))


def ledger(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(resource, total, n): exact sums of amounts of two decimals."""
    cents = F.sum(F.round(F.col(value) * 100).cast("long"))
    return rows.groupBy(F.col(group).alias("resource")).agg((cents / 1e2).alias("total"), F.count("*").alias("n"))


def cube(rows: DataFrame, keys: dict[str, str], **measures: Column) -> DataFrame:
    """Measures of all subsets of the keys ({column: name}); "all" stands for any value."""
    flat = rows.select(*[F.col(k).alias(n) for k, n in keys.items()], *[c for c in rows.columns if c not in keys])
    cells = flat.cube(*keys.values()).agg(*[F.grouping(n).alias(f"g_{n}") for n in keys.values()], *[m.alias(n) for n, m in measures.items()])
    return cells.select(*[F.when(F.col(f"g_{n}") == 1, "all").otherwise(F.col(n)).alias(n) for n in keys.values()], *measures)


def grid(variants: DataFrame, conditions: DataFrame, cells: DataFrame, least: int) -> DataFrame:
    """(variant, condition, cell, kind) of every combination: a count, NA where there is none,
    and INSUFFICIENT_EVIDENCE below `least`. Both sides are distinct names, of which a table
    that is read has few; the cells are aggregated before."""
    all_of = variants.distinct().crossJoin(conditions.distinct())
    met = all_of.join(cells, ["variant", "condition"], "left")
    kind = F.when(F.col("n").isNull(), "NA").when(F.col("n") < least, "INSUFFICIENT_EVIDENCE").otherwise("value")
    return met.select("variant", "condition", F.coalesce(F.col("n").cast("string"), F.lit("NA")).alias("cell"), kind.alias("kind"))


def completion(scenes: DataFrame, group: str) -> DataFrame:
    """(group, n_total, n_complete, n_incomplete, completion_rate, mean_over_complete): a mean
    is over complete scenes only, and the counts beside it say over how many. `scenes` has
    complete (boolean) and score."""
    done = F.count_if("complete")
    rate = share(F.col("n_complete"), F.col("n_total"))
    mean = six(F.col("score_").cast("double") / F.nullif(F.col("n_complete"), F.lit(0)))
    g = scenes.groupBy(group).agg(F.count("*").alias("n_total"), done.alias("n_complete"), F.sum(F.when(F.col("complete"), F.col("score"))).alias("score_"))
    return g.select(group, "n_total", "n_complete", (F.col("n_total") - F.col("n_complete")).alias("n_incomplete"), rate.alias("completion_rate"), mean.alias("mean_over_complete"))


def bernoulli(key: Column, name: str, seed: int, share_: float) -> Column:
    """True with the given probability, by the first 16 bits of a hash of seed, key and name:
    the same for a key in any run, and independent for each name."""
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{name}")), 256), 1, 4)
    return F.conv(h, 16, 10).cast("int") >= int(65536 * (1 - share_))


def mask_rates(rows: DataFrame, names: list[str]) -> DataFrame:
    """Shares of rows in which each of the columns is masked (false), and in which all are."""
    off = lambda c: six(F.avg(F.when(c, 0.0).otherwise(1.0)))
    return rows.agg(*[off(F.col(n)).alias(n) for n in names], off(reduce(lambda a, b: a | b, [F.col(n) for n in names])).alias("all_masked"))


def series(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """`rows` with running (sum so far) and delta (since the row before) of a whole number."""
    w = W.partitionBy(group).orderBy(*order)
    v = rows.withColumn("v_", value)
    return v.withColumn("running", F.sum("v_").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("delta", F.col("v_") - F.lag("v_").over(w)).drop("v_")


def downsampled(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """Every s-th row of a group from its first on, and always its last: s is the least stride
    by which no more than `most` rows and the last one stay."""
    w, ordered = W.partitionBy(*group), W.partitionBy(*group).orderBy(*order)
    n = rows.withColumn("rn_", F.row_number().over(ordered)).withColumn("n_", F.count("*").over(w))
    stride = F.floor(F.col("n_") / most) + 1
    return n.where(((F.col("rn_") - 1) % stride == 0) | (F.col("rn_") == F.col("n_"))).drop("rn_", "n_")


def throughput(rows: DataFrame, group: str, ts: str) -> DataFrame:
    """(group, done, per_second) over the time from the first row to the last; null if none."""
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return rows.groupBy(group).agg(F.count("*").alias("done"), six(F.count("*") * 1e6 / F.nullif(span, F.lit(0))).alias("per_second"))


def top_k(rows: DataFrame, group: str, order: list[Column | str], k: int, out: str = "rn") -> DataFrame:
    """The first k rows of each group in an order, with their rank; tasks keep k of a group
    before they are sent on."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn(out, rank).where(F.col(out) <= k).withColumn(out, F.col(out).cast("long"))


def readiness(rows: DataFrame, group: str, state: str, good: str, bad: str) -> DataFrame:
    """(group, all_ready, any_ready, all_settled) of a group's tasks, whose states are `good`,
    `bad` or neither yet."""
    s = F.col(state)
    return rows.groupBy(group).agg(F.bool_and(s != bad).alias("all_ready"), F.bool_or(s == good).alias("any_ready"), (F.count_if(s.isin(good, bad)) == F.count("*")).alias("all_settled"))


def unfinished(rows: DataFrame, group: str, ts: str, ended: Column, least: int) -> DataFrame:
    """(group, started, ended): runs of which fewer than `least` rows say that they ended."""
    g = rows.groupBy(group).agg(F.min(ts).alias("started"), F.count_if(ended).alias("ended"))
    return g.where(F.col("ended") < least)


def scene_sizes(nodes: DataFrame, group: str, asset: str) -> DataFrame:
    """(group, n_nodes, n_chain, n_assets): nodes, edges of the chain through them, assets."""
    return nodes.groupBy(group).agg(F.count("*").alias("n_nodes"), (F.count("*") - 1).alias("n_chain"), F.count_distinct(asset).alias("n_assets"))


def view_checks(views: DataFrame, group: str, digest: Column, blank: Column) -> DataFrame:
    """(group, views, distinct_views, blank, all_blank): a render that failed shows the same
    image from all sides, or nothing."""
    return views.groupBy(group).agg(F.count("*").alias("views"), F.count_distinct(digest).alias("distinct_views"), F.count_if(blank).alias("blank"), (F.count_if(blank) == F.count("*")).alias("all_blank"))
