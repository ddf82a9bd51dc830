"""Checks that report what breaks a rule, over tables of any origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.sources.tables import kept


def leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """(leaked): keys on both sides; 0 is right."""
    return train.select(key).intersect(test.select(key)).agg(F.count("*").alias("leaked"))


def completeness(manifest: DataFrame, admitted: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """(missing, strangers, duplicates) of admitted and quarantined together against the
    manifest; zeros are right."""
    sides = manifest.select(key, F.lit(1).alias("listed"), F.lit(0).alias("settled"))
    for part in (admitted, quarantined):
        sides = sides.unionByName(part.select(key, F.lit(0).alias("listed"), F.lit(1).alias("settled")))
    each = sides.groupBy(key).agg(F.max("listed").alias("listed"), F.sum("settled").alias("settled"))
    total = F.sum(F.greatest(F.col("settled") - 1, F.lit(0)))
    return each.agg(F.count_if(F.col("settled") == 0).alias("missing"), F.count_if(F.col("listed") == 0).alias("strangers"), F.coalesce(total, F.lit(0)).alias("duplicates"))


def batch_faults(batches: DataFrame, batch: list[str], positive: str, size: int) -> DataFrame:
    """(batch..., n, repeats): batches of more than `size` rows or in which a positive repeats."""
    per = batches.groupBy(*batch, positive).agg(F.count(F.lit(1)).alias("m"))
    each = per.groupBy(*batch).agg(F.sum("m").alias("n"), (F.sum("m") - F.count(F.lit(1))).alias("repeats"))
    return each.where((F.col("n") > size) | (F.col("repeats") > 0))


def coverage(trained: DataFrame, saved: DataFrame, frozen: list[str]) -> DataFrame:
    """(name, fault) of parameters: trained but not saved, saved but neither trained nor
    frozen, or trained under a frozen prefix. Both tables have a column `name`."""
    t, s = trained.select("name", F.lit(True).alias("t")).distinct(), saved.select("name", F.lit(True).alias("s")).distinct()
    still = F.array_max(F.array(F.lit(False), *[F.startswith("name", F.lit(p)) for p in frozen]))
    fault = F.when(F.col("t") & still, "frozen but trained").when(F.col("t") & F.col("s").isNull(), "not saved").when(F.col("t").isNull() & ~still, "saved but never trained")
    return t.join(s, "name", "full").select("name", fault.alias("fault")).where("fault is not null")


def unreached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes that no root (a node that edges leave but none enters) leads to."""
    seen = kept(edges.select(F.col("src").alias("id")).subtract(edges.select("dst")))
    new = seen
    while new.limit(1).count():
        new = kept(edges.join(new, edges.src == new.id, "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = kept(seen.union(new))
    return nodes.select("id").join(seen, "id", "left_anti")


def cyclic(edges: DataFrame) -> DataFrame:
    """(id): nodes on a cycle or between two, by peeling off ends that lead nowhere."""
    left = kept(edges.select("src", "dst").distinct())
    while True:
        inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner = kept(inner.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if inner.count() == left.count():
            return left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        left = inner


def required(value: Column, holds: Column, message: str) -> Column:
    """`value`, or an error that says why not; a null condition doesn't hold."""
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


# Fixed value: the kinds of fusion that a stage may name.
FUSIONS = ("mean", "mlp", "gated")


def stage_fault(fusion: Column, width: Column, use_layout: Column, wanted: int) -> Column:
    """Why a stage can't be built, or null: the layout's width counts only where it is used."""
    told = F.concat(F.lit("fusion = "), fusion, F.lit(" is unknown"))
    wide = F.concat(F.lit("layout width "), width.cast("string"), F.lit(f" is not {wanted}"))
    return F.when(fusion.isNull(), "fusion is required").when(~fusion.isin(*FUSIONS), told).when(use_layout & (width != wanted), wide)


def checkpoints(wanted: DataFrame, held: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, digest, refusal): the checkpoint of each wanted key, or what to do about it."""
    h = held.select(F.col(key).alias("k_"), digest)
    told = F.concat(F.lit("no checkpoint of "), F.col(key).cast("string"), F.lit(": train it first"))
    return wanted.join(h, F.col(key) == F.col("k_"), "left").select(key, digest, F.when(F.col("k_").isNull(), told).alias("refusal"))


def layout_entries(houses: DataFrame) -> DataFrame:
    """`houses` (house, n or null, branch) with how the layout enters a model: a house without
    nodes has none, a model without a layout branch refuses one."""
    entry = F.when(F.col("n").isNull(), "no layout").when(~F.col("branch"), "refused: no layout branch").when(F.col("n") == 1, "context without edges").otherwise("batch of one")
    return houses.withColumn("entry", entry).withColumn("n", F.coalesce("n", F.lit(0)))


def iteration_counts(rows: DataFrame, run: list[str], order: list[str], starts: Column) -> DataFrame:
    """`rows` with iteration (0 before the first start), in_iteration and in_run: rows so far,
    the first count beginning anew with each iteration."""
    so_far = lambda w: w.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    it = rows.withColumn("iteration", F.count_if(starts).over(so_far(W.partitionBy(*run))))
    n = it.withColumn("in_iteration", F.count("*").over(so_far(W.partitionBy(*run, "iteration"))))
    return n.withColumn("in_run", F.count("*").over(so_far(W.partitionBy(*run))))
