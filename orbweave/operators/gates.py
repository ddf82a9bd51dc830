"""Gates: criteria give verdicts, and a verdict stands only while its inputs are what they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.walks import closure

# The verdicts and their return codes.
RC = {"PASS": 0, "FAIL": 2, "BLOCKED": 3, "INVALIDATED": 4}


def rc(verdict: Column) -> Column:
    out = F.when(verdict == "PASS", RC["PASS"])
    for name in ("FAIL", "BLOCKED", "INVALIDATED"):
        out = out.when(verdict == name, RC[name])
    return out.cast("long")


def judged(criteria: DataFrame) -> DataFrame:
    """`criteria` (gate, criterion, observed, least, most) with verdict and rc. An observation
    within its bounds (null: none) passes; one that is missing or not a number blocks."""
    seen = F.col("observed").isNotNull() & ~F.isnan("observed")
    fits = F.coalesce(F.col("observed") >= F.col("least"), F.lit(True)) & F.coalesce(F.col("observed") <= F.col("most"), F.lit(True))
    verdict = F.when(~seen, "BLOCKED").when(fits, "PASS").otherwise("FAIL")
    return criteria.withColumn("verdict", verdict).withColumn("rc", rc(F.col("verdict")))


def gate_verdicts(criteria: DataFrame) -> DataFrame:
    """(gate, verdict, rc, failed): of all criteria of a gate; one that fails fails it, else one
    that blocks blocks it. `failed` is the first criterion that doesn't pass."""
    j = judged(criteria)
    bad = F.min(F.when(F.col("verdict") != "PASS", F.struct(F.when(F.col("verdict") == "FAIL", 0).otherwise(1).alias("o"), "criterion")))
    g = j.groupBy("gate").agg(bad.alias("bad"))
    verdict = F.when(F.col("bad").isNull(), "PASS").when(F.col("bad.o") == 0, "FAIL").otherwise("BLOCKED")
    return g.select("gate", verdict.alias("verdict"), rc(verdict).alias("rc"), F.col("bad.criterion").alias("failed"))


def standing(verdicts: DataFrame, used: DataFrame, inputs: DataFrame, depends: DataFrame) -> DataFrame:
    """(gate, verdict, rc, reason): what stored verdicts are worth now.

    verdicts: gate, verdict; used: gate, input, digest (what each verdict was given); inputs:
    input, digest (what there is now); depends: src, dst (dst uses what src has passed). A
    verdict is INVALIDATED if an input has another digest or is gone, or if any gate that it
    depends on, however far up, is invalidated; else it stands. A stored null digest never
    matches. `reason` names the least changed input, or else the least gate further up.
    """
    now = inputs.select("input", F.col("digest").alias("now"))
    changed = used.join(now, "input", "left").where("digest is null or now is null or digest <> now")
    own = changed.groupBy("gate").agg(F.min("input").alias("input"))
    down = closure(depends.select("src", "dst")).where("a <> b")
    above = down.join(own, down.a == own.gate).groupBy(F.col("b").alias("gate")).agg(F.min("a").alias("above"))
    all_of = verdicts.join(own, "gate", "left").join(above, "gate", "left")
    lost = F.col("input").isNotNull() | F.col("above").isNotNull()
    verdict = F.when(lost, "INVALIDATED").otherwise(F.col("verdict"))
    why = F.when(F.col("input").isNotNull(), F.concat(F.lit("input "), F.col("input").cast("string"))).when(F.col("above").isNotNull(), F.concat(F.lit("gate "), F.col("above").cast("string")))
    return all_of.select("gate", verdict.alias("verdict"), rc(verdict).alias("rc"), why.alias("reason"))
