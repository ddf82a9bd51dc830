"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.llm.common import cut, few, plain, table, unused

WORD = r"[^\x20\x09-\x0D]+"


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """`sources` (source, source_size, weight) with a target.

    Each round shares what is left by weight among the open sources and clamps those that
    exceed max_epochs times their size; it ends when none does. Only two sums a round
    reach the driver, and the table of sources stays distributed. Sources of no size or of
    a null or non-positive weight get 0. If all are clamped, the budget isn't reached.
    """
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    level = 0.0
    while True:
        clamped = F.col("weight") * F.lit(level) >= F.col("cap")
        row = s.agg(
            F.sum(F.when(clamped & (F.col("weight") > 0), F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        new = (float(budget) - row["held"]) / row["open"]
        if new <= level:
            break
        level = new
    return s.withColumn("target", F.when(F.col("weight") > 0, F.least("cap", F.col("weight") * F.lit(level))).otherwise(0.0)).drop("cap")


def mix_sources(docs: DataFrame, weights, share: float = 1.5, max_epochs: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target and mix_copies (whole repetitions).

    `weights` maps the DataFrame (source, source_size) to one with a weight column. A
    source's target over its size is its number of epochs: the whole part repeats every
    row; for the fraction, rows are taken in the order of a seeded hash until the next
    would pass the quota by more than half of itself. A row's hash is
    that of its id; where ids repeat or are null, rows are written once with a number each,
    and their hash is that of id, text and number, so that repeated rows are taken one by
    one (how many of equal rows are, depends on how the table is dealt to tasks). A null
    source is a source; a null or empty text has size
    0 and is taken as its hash says. Columns of these four names in `docs` are replaced.
    An empty table gives no rows. Only sizes and hashes shuffle: the cut-off hash of each
    source goes back to the rows, so texts never move.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    columns = docs.columns
    (row,) = unused(docs, "mix_row_")
    parts = [F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))]
    ids = docs.agg(F.count_distinct(F.col(id_col)).alias("ids"), F.count(F.lit(1)).alias("n")).first()
    if ids["ids"] < ids["n"]:
        docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        parts += [F.md5(F.coalesce(text_col, F.lit(""))), F.col(row).cast("string")]
    key = F.md5(F.concat_ws(":", *parts))
    names = {"size": n_words(F.col(text_col)), "source": F.col(source_col)}
    name, whole, upto = unused(docs, "mix_source_", "mix_whole_", "mix_upto_")
    skinny = cut(docs.select(names["source"].alias("source"), names["size"].alias("size"), key.alias("key")))
    many = skinny.select("source").distinct().count()
    sources = cut(skinny.groupBy("source").agg(F.sum("size").alias("source_size")), many)
    total = sources.agg(F.sum("source_size").alias("t"), F.count(F.lit(1)).alias("n")).first()
    plan = cut(water_fill(weights(sources), share * (total["t"] or 0), max_epochs), many)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(epochs)).withColumn("quota", F.col("target") - F.floor(epochs) * F.col("source_size"))
    plan = few(plan.select("source", "source_size", "target", "whole", "quota"), total["n"])
    # Running sizes in hash order: blocks of hashes first, then within the block of the quota.
    block = F.substring("key", 1, 3)
    sums = skinny.groupBy("source", block.alias("block")).agg(F.sum("size").alias("in_block"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    edge = sums.join(plan, sums.source.eqNullSafe(plan.source)).where("before <= quota and before + in_block > quota").select(sums.source, "block", "before", "quota")
    edge = cut(edge, many)
    at = skinny.withColumn("block", block)
    at = at.join(few(edge.withColumnRenamed("source", "s").withColumnRenamed("block", "b"), total["n"]), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    at = at.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("quota").alias("quota"))
    run = F.sum("size").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = at.withColumn("upto", F.col("before") + run - F.col("size") / 2).where("upto <= quota").groupBy("source").agg(F.max("key").alias("last_key"))
    edges = edge.select(F.col("source").alias("es"), F.col("block").alias("edge_block")).join(last, F.col("es").eqNullSafe(F.col("source")), "left").select("es", F.coalesce("last_key", "edge_block").alias("upto_key"))
    plan2 = plan.join(edges, plan.source.eqNullSafe(edges.es), "left")
    # No edge: the quota is the whole source (or nothing at all).
    plan2 = plan2.select(F.col("source").alias(name), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias(whole), F.coalesce("upto_key", F.when(F.col("quota") > 0, F.lit("g")).otherwise(F.lit(""))).alias(upto))
    plan2 = few(cut(plan2, many), total["n"])
    out = docs.join(plan2, F.col(source_col).eqNullSafe(F.col(name)))
    copies = F.col(whole) + F.when(key <= F.col(upto), 1).otherwise(0)
    return out.withColumn("mix_size", n_words(F.col(text_col))).withColumn("mix_copies", copies.cast("int")).select(*map(plain, columns), "mix_size", "mix_source_size", "mix_target", "mix_copies")


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Weights 5, 2, 1, repeating over the sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), F.pmod(rank, F.lit(3)) + 1))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = mix_sources(docs, cycle_weights, 1.5, 2.0)
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"))


# The level of the water in one step: sources by what fills them, and the first of them that
# the level over all later ones doesn't fill.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 2e0 * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS fills, coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS held, sum(weight) OVER (ORDER BY cap / weight DESC, n DESC) AS open, 15e-1 * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT arg_min((budget - held) / open, {'fills': fills, 'n': n}) AS level FROM o WHERE (budget - held) / open < fills),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM l), 'inf'::DOUBLE)) AS target FROM w),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, whole, target - whole * source_size AS quota, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('11:' || d.doc_id)) AS upto FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN upto - size / 2 <= quota THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
