"""Admission, references, sets of edges and seeded splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.operators.places import counted, stretches


def admitted(rows: DataFrame, key: str, *others: tuple[DataFrame, str]) -> DataFrame:
    """The rows whose key each of the other tables (table, its key) has. A null key has none."""
    return reduce(lambda d, o: d.join(o[0].select(F.col(o[1]).alias("k_")), F.col(key) == F.col("k_"), "left_semi"), others, rows)


def unmapped(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """The rows whose key the other table lacks; a null key is lacking."""
    return rows.join(other.select(F.col(other_key).alias("k_")), F.col(key) == F.col("k_"), "left_anti")


def next_edges(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """(house, i, j, and for each of `carry` its value at both ends, named <c>_a and <c>_b): an
    edge from each node of a house to the one that follows it by idx."""
    w = W.partitionBy("house").orderBy("idx")
    then = nodes.select("house", F.col("idx").alias("i"), F.lead("idx").over(w).alias("j"), *[x for c in carry for x in (F.col(c).alias(f"{c}_a"), F.lead(c).over(w).alias(f"{c}_b"))])
    return then.where("j is not null")


def near_edges(nodes: DataFrame, steps: int) -> DataFrame:
    """(house, i, j): an edge from each node to each of the `steps` nodes after it by idx."""
    w = W.partitionBy("house").orderBy("idx")
    after = nodes.select("house", F.col("idx").alias("i"), F.array(*[F.lead("idx", s).over(w) for s in range(1, steps + 1)]).alias("to"))
    return after.select("house", "i", F.explode(F.filter("to", lambda j: j.isNotNull())).alias("j"))


def last_before(rows: DataFrame, group: list[str], order: list[str], head: Column, out: str) -> DataFrame:
    """`rows` with `out`: the last value of `head` that isn't null on any earlier row of the
    group; null where there is none. A row's own value doesn't count."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(head, ignorenulls=True).over(w))


def dereferenced(rows: DataFrame, uri: str, index: DataFrame, index_key: str) -> DataFrame:
    """`rows` with the columns of the index row that a reference "<file>#<row>" names; one that
    names no row of the index, or is no reference, raises and is shown."""
    number = F.try_element_at(F.split(uri, "#"), F.lit(2)).try_cast("long")
    met = rows.withColumn("n_", number).join(index.withColumn("there_", F.lit(True)), F.col("n_") == F.col(index_key), "left")
    told = F.concat(F.lit("reference to no row: "), F.coalesce(F.col(uri), F.lit("null")))
    return met.where(F.when(F.col("there_"), True).otherwise(F.raise_error(told).cast("boolean"))).drop("n_", "there_", index_key)


def excluded(rows: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """The rows that a reason holds for, with the first one as `reason`."""
    why = reduce(lambda w, r: w.when(r[0], r[1]), reasons[1:], F.when(reasons[0][0], reasons[0][1]))
    return rows.withColumn("reason", why).where("reason is not null")


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Each edge (house, i, j) both ways."""
    ends = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return edges.select("house", F.explode(ends).alias("e")).select("house", "e.i", "e.j")


def collapsed(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(n_edges, n_keys, hit_rate): edges against their distinct unordered pairs of values. What
    a store of answers by pair saves; null without edges."""
    pairs = edges.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("m"))
    rate = 1 - F.count("*").cast("double") / F.nullif(F.sum("m").cast("double"), F.lit(0.0))
    return pairs.agg(F.sum("m").alias("n_edges"), F.count("*").alias("n_keys"), (F.floor(rate * 1e6 + 0.5) / 1e6).alias("hit_rate"))


def half_even(n: int, tenths: int) -> int:
    """n * tenths / 10, halves to the even number."""
    whole, rest = divmod(n * tenths, 10)
    return whole + (rest > 5 or rest == 5 and whole % 2)


def seeded_split(rows: DataFrame, key: str, seed: int, tenths: int = 8) -> DataFrame:
    """(id, split): `tenths` of ten of the distinct keys, by the order of a seeded hash, are
    "train", the rest "test". The split of a table is the same however it is dealt to tasks."""
    ids = rows.select(F.col(key).alias("id")).where("id is not null").distinct()
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    s = stretches(ids.withColumn("h", h), [], ["h", "id"])
    most = half_even(s.count(), tenths)
    return counted(s, ["id", "h"], "position").select("id", F.when(F.col("position") < most, "train").otherwise("test").alias("split"))


def protocols(split: DataFrame) -> DataFrame:
    """(protocol, n_query, n_gallery): A searches the test side in itself, B in everything."""
    n = split.agg(F.count_if(F.col("split") == "test").alias("test"), F.count("*").alias("all"))
    rows = F.array(F.struct(F.lit("A").alias("protocol"), F.col("test").alias("n_query"), F.col("test").alias("n_gallery")), F.struct(F.lit("B").alias("protocol"), F.col("test").alias("n_query"), F.col("all").alias("n_gallery")))
    return n.select(F.inline(rows))
