"""Point clouds: normalised about their centroid, prepared as input of a point encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The grey of points whose colour isn't known: the middle of the range, which says nothing.
GREY = 0.5


def normalised(points: DataFrame, group: str) -> DataFrame:
    """`points` (x, y, z) about their group's centroid, scaled so that the farthest one has
    distance 1, and `degenerate`: whether all points of the group are one (then zeros)."""
    w = W.partitionBy(group)
    n = points.withColumns({c: F.col(c) - F.avg(c).over(w) for c in "xyz"})
    r = F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).over(w)
    n = n.withColumn("r_", r).withColumn("degenerate", F.col("r_") == 0)
    return n.withColumns({c: F.when(F.col("degenerate"), 0.0).otherwise(F.col(c) / F.col("r_")) for c in "xyz"}).drop("r_")


def shells(points: DataFrame, group: str, order: str, most: int, grey: float = GREY, degenerate: bool = False) -> DataFrame:
    """(group, n, cloud): each group's points, normalised, as rows [x, y, z, grey, grey, grey] in
    the order of `order`, which is what a point encoder takes when depth is all that is known.
    A point that isn't finite, a cloud of more than `most` points (a cloud is one row) or one
    that is a single place raises and is named: an encoder would give a vector for it, and no
    one would see that it means nothing. With `degenerate`, clouds of a single place come too,
    as zeros, for callers that tell them by that."""
    whole = [F.abs(c) < float("inf") for c in "xyz"]
    fit = F.coalesce(whole[0] & whole[1] & whole[2], F.lit(False))
    n = normalised(points.withColumn("fit_", fit), group)
    sizes = points.groupBy(group).agg(F.count("*").alias("n_")).withColumnRenamed(group, "g_")
    n = n.join(sizes, n[group].eqNullSafe(F.col("g_")))
    why = F.when(~F.col("fit_"), "a point that isn't finite").when(F.col("n_") > most, f"more than {most} points").when(F.col("degenerate") & F.lit(not degenerate), "one place only")
    told = F.concat(F.lit("cloud "), F.coalesce(F.col(group).cast("string"), F.lit("null")), F.lit(" has "), why)
    row = F.array("x", "y", "z", *[F.lit(grey)] * 3)
    checked = n.select(group, F.struct(F.col(order).alias("o"), F.when(why.isNull(), row).otherwise(F.raise_error(told).cast("array<double>")).alias("p")).alias("p"))
    return checked.groupBy(group).agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list("p")), lambda p: p["p"]).alias("cloud"))
