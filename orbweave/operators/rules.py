"""Rules over records: violations, completeness, states, lookups and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_violation(rules: list[tuple[Column, str | Column]]) -> Column:
    """The message of the first rule (condition, message) whose condition holds, else null. A
    condition that is null doesn't hold."""
    if not rules:
        return F.lit(None).cast("string")
    (holds, message), *rest = rules
    out = F.when(holds, message)
    for holds, message in rest:
        out = out.when(holds, message)
    return out


def outside(value: Column, least: float | int, most: float | int) -> Column:
    """Whether a value lies outside its bounds; a missing one or one that is no number does."""
    return value.isNull() | F.isnan(value.cast("double")) | (value < least) | (value > most)


def blank(text: Column) -> Column:
    return F.trim(text) == ""


def complete(required: list[Column], conditions: list[Column]) -> Column:
    """Whether all required values are there and all conditions hold; null doesn't hold."""
    out = F.lit(True)
    for c in [*(r.isNotNull() for r in required), *conditions]:
        out = out & F.coalesce(c, F.lit(False))
    return out


def strangers(rows: DataFrame, contract: str, column: str, allowed: list[str]) -> DataFrame:
    """(contract, name, n): values of a column that its contract doesn't name, null included."""
    known = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return rows.where(~known).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(contract).alias("contract"), "name", "n")


def work_list(population: DataFrame, records: DataFrame, key: str, done: Column) -> DataFrame:
    """The rows of `population` without a record that is done. Null keys are always work."""
    return population.join(records.where(done).select(key), key, "left_anti")


def unmatched(rows: DataFrame, dimension: DataFrame, key: str, dim_key: str) -> DataFrame:
    """(key, n): keys that the dimension lacks, and how many rows have them."""
    missing = rows.join(dimension.select(F.col(dim_key).alias("k_")).distinct(), F.col(key) == F.col("k_"), "left_anti")
    return missing.groupBy(key).agg(F.count("*").alias("n"))


def strict_lookup(rows: DataFrame, dimension: DataFrame, key: str, dim_key: str) -> DataFrame:
    """`rows` with the dimension's columns; a key that it lacks, or has twice, raises and is
    named. A null key counts as missing."""
    twice = dimension.groupBy(dim_key).count().where("count > 1").orderBy(dim_key).first()
    if twice is not None:
        raise ValueError(f"{dim_key} = {twice[0]} is there {twice['count']} times")
    met = rows.join(dimension.withColumn("there_", F.lit(True)), rows[key] == dimension[dim_key], "left")
    told = F.concat(F.lit(f"no row for {key} = "), F.coalesce(rows[key].cast("string"), F.lit("null")))
    return met.where(F.when(F.col("there_"), True).otherwise(F.raise_error(told).cast("boolean"))).drop("there_")


def match_states(rows: DataFrame, cache: DataFrame, key: str, cache_key: str, degraded: Column) -> DataFrame:
    """`rows` with `state`: covered, degraded (there, but marked so) or uncached."""
    known = cache.select(F.col(cache_key).alias("k_"), F.coalesce(degraded, F.lit(False)).alias("d_"))
    state = F.when(F.col("k_").isNull(), "uncached").when(F.col("d_"), "degraded").otherwise("covered")
    return rows.join(known, F.col(key) == F.col("k_"), "left").withColumn("state", state).drop("k_", "d_")


def coverage_by(states: DataFrame, group: str) -> DataFrame:
    """(group, n, covered, degraded, uncached, covered_fraction)."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("covered", "degraded", "uncached")]
    share = F.floor(F.col("covered") / F.col("n") * 1e6 + 0.5) / 1e6
    return states.groupBy(group).agg(F.count("*").alias("n"), *counts).withColumn("covered_fraction", share)


def provenance(records: DataFrame, registry: DataFrame, key: str, digest: Column, declared: Column, current: Column) -> DataFrame:
    """`records` with `state`: none (not registered), current (made under the present
    contract), declared (older, but its content is what was declared) or unaccounted.
    Conditions see the columns of both tables; `registry` has one row a key."""
    at = registry.withColumn("there_", F.lit(True))
    state = F.when(F.col("there_").isNull(), "none").when(F.coalesce(current, F.lit(False)), "current").when(F.coalesce(declared & (digest == F.col("declared_digest")), F.lit(False)), "declared").otherwise("unaccounted")
    return records.join(at, key, "left").withColumn("state", state).drop("there_")


def compared(ours: DataFrame, published: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ours, published, verdict) of every cell of either side: holds if ours is no less,
    differs if it is, missing if we lack it, and not published."""
    a, b = ours.select(key, F.col(value).alias("ours")), published.select(key, F.col(value).alias("published"))
    verdict = F.when(F.col("published").isNull(), "not published").when(F.col("ours").isNull(), "missing").when(F.col("ours") >= F.col("published"), "holds").otherwise("differs")
    return a.join(b, key, "full").select(key, "ours", "published", verdict.alias("verdict"))


def read_states(keys: DataFrame, records: DataFrame, key: str, readable: Column) -> DataFrame:
    """`keys` with `state`: absent, unreadable (there, but not to be used) or record."""
    there = records.select(F.col(key).alias("k_"), F.coalesce(readable, F.lit(False)).alias("r_"))
    state = F.when(F.col("k_").isNull(), "absent").when(F.col("r_"), "record").otherwise("unreadable")
    return keys.join(there, F.col(key) == F.col("k_"), "left").withColumn("state", state).drop("k_", "r_")


def registry_faults(registry: DataFrame, key: str, identity: Column, rules: list[tuple[Column, str]]) -> DataFrame:
    """(key, violation): rows whose identity another row has, or that break a rule. Counts of
    identities are aggregated first, so a value that many rows have is no one's window."""
    rows = registry.select("*", identity.alias("identity_"))
    again = rows.groupBy("identity_").agg(F.count("*").alias("n_")).where("n_ > 1 and identity_ is not null")
    why = first_violation([(F.col("n_") > 1, "duplicate"), *rules])
    return rows.join(again, "identity_", "left").select(key, why.alias("violation")).where("violation is not null")


def promotion(staged: DataFrame, promoted: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): promote what isn't promoted, same if it is and equal, else refused: what
    was promoted once never changes."""
    old = promoted.select(F.col(key).alias("k_"), F.col(digest).alias("d_"))
    status = F.when(F.col("k_").isNull(), "promote").when(F.col("d_").eqNullSafe(F.col(digest)), "same").otherwise("refused")
    return staged.join(old, F.col(key) == F.col("k_"), "left").select(key, status.alias("status"))


def largest_remainder(rows: DataFrame, group: str, place: str, weight: str, total: int, out: str = "points") -> DataFrame:
    """`rows` with `out`: `total` shared out within each group in proportion to the weights,
    whole numbers that add up to it. What rounding down leaves goes to the largest remainders
    (ties by `place`); a group without weight gives all to its first place."""
    w, sum_ = W.partitionBy(group), F.col("sum_")
    shares = rows.withColumn("sum_", F.sum(weight).over(w)).withColumn("first_", F.min(place).over(w))
    share = F.when(sum_ > 0, F.col(weight) / sum_ * total).when(F.col(place) == F.col("first_"), float(total)).otherwise(0.0)
    parts = shares.withColumn("share_", share).withColumn("base_", F.floor("share_").cast("long"))
    rest = F.floor((F.col("share_") - F.floor("share_")) * 1e9 + 0.5)
    order = W.partitionBy(group).orderBy(F.desc("rest_"), place)
    ranked = parts.withColumn("rest_", rest).withColumn("left_", total - F.sum("base_").over(w)).withColumn("rank_", F.row_number().over(order))
    given = F.col("base_") + (F.col("rank_") <= F.col("left_")).cast("long")
    return ranked.withColumn(out, given).drop("sum_", "first_", "share_", "base_", "rest_", "left_", "rank_")


def first_by(rows: DataFrame, group: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The row of each group that comes first (or last) by `order`; nulls come first, ties go
    to the least (greatest) row. One aggregate, so a group of any size is combined in parts."""
    rest = [c for c in rows.columns if c not in group and c not in order]
    pick = F.max if last else F.min
    one = rows.groupBy(*group).agg(pick(F.struct(*order, *rest)).alias("r_"))
    return one.select(*[c if c in group else F.col("r_")[c].alias(c) for c in rows.columns])


def greatest_with_witness(rows: DataFrame, group: list[str], value: str, witness: str, out: str = "most") -> DataFrame:
    """(group..., out, witness): the greatest value of each group, and its least witness (a number).
    Both are compared as they are; nothing is packed into one number. Null values don't count
    unless a group has no other."""
    best = F.max_by(F.struct(value, witness), F.struct(F.col(value), -F.col(witness)))
    return rows.groupBy(*group).agg(best.alias("r_")).select(*group, F.col("r_")[value].alias(out), F.col("r_")[witness].alias(witness))


def worst(rows: DataFrame, group: list[str], ranked: dict[str, Column], rest: str, out: str = "worst") -> DataFrame:
    """(group..., out): the last of the named classes, in their order, that any row of the group
    falls into. A row's class is the first whose condition holds, else `rest`, the worst."""
    names = [*ranked, rest]
    at = F.lit(len(ranked))
    for n, holds in reversed(list(enumerate(ranked.values()))):
        at = F.when(holds, n).otherwise(at)
    found = rows.groupBy(*group).agg(F.max(at).alias("n_"))
    return found.select(*group, F.element_at(F.array(*map(F.lit, names)), F.col("n_") + 1).alias(out))


def encoder_decisions(published: Column, actual: Column, pooling: Column) -> dict[str, Column]:
    """What follows from how an encoder was published and how it is used ("frozen" or
    "trainable"), and from how views are pooled. Only the output of a frozen encoder may be
    cached, view by view if one is drawn at random each time."""
    frozen = actual == "frozen"
    layout = F.when(~frozen, "none").when(pooling == "random_single_view", "per_view").otherwise("aggregated")
    return {"deviates": (published == "trainable") & frozen, "exceeds": (published == "frozen") & (actual == "trainable"), "may_use_cache": frozen, "cache_layout": layout}


def extents_agree(stored: Column, measured: Column, least: float = 0.5, most: float = 3.0, slack: float = 0.25) -> Column:
    """Whether two extents are of one size: their ratio lies within bounds, or they differ by no
    more than `slack` of the larger one."""
    ratio = stored / measured
    return ~(((ratio < least) | (ratio > most)) & (F.abs(stored - measured) > slack * F.greatest(stored.cast("double"), measured.cast("double"))))


def or_else(value: Column, default: str) -> Column:
    """A value as text, or the default where it is null or couldn't be read."""
    return F.coalesce(value.cast("string"), F.lit(default))


def classified(rows: DataFrame, classes: dict[str, Column], rest: str, out: str) -> DataFrame:
    """(out, n): how many rows fall into each class, by the first condition that holds."""
    at = first_violation([(holds, name) for name, holds in classes.items()])
    return rows.groupBy(F.coalesce(at, F.lit(rest)).alias(out)).agg(F.count("*").alias("n"))


def repaired(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, attempts, status, reason) after at most two attempts, whose violations are given:
    each key is a record or in quarantine, never both."""
    failed = F.col(first).isNotNull()
    bad = failed & F.col(second).isNotNull()
    return rows.select(key, F.when(failed, 2).otherwise(1).cast("long").alias("attempts"), F.when(bad, "quarantine").otherwise("record").alias("status"), F.when(bad, F.col(second)).alias("reason"))


def enriched(side: Column, version: int) -> list[Column]:
    """What is added to an accepted record: its volume, units and the version of the prompt."""
    volume = side.cast("double") * side * side
    return [volume.alias("volume"), F.lit("cm").alias("dimension_unit"), F.lit("kg").alias("mass_unit"), F.lit(version).cast("long").alias("prompt_version")]
