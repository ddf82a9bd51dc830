"""Composition of scenes: slots are filled by retrieval, under budgets, until each scene ends."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.functions.vectors import add, dot, unit
from orbweave.operators.search import meet
from orbweave.sources.tables import kept, remove, shared_folder

MODES = ("iterative", "region", "parallel")
STATE = "scene, slot, tries, placed, calls, layout, taken, terminated_by"


def nearest_free(queries: DataFrame, gallery: DataFrame, regions: bool) -> DataFrame:
    """(query_id, id) of the best object that is not the query, not in its array `taken` and,
    if `regions`, in its region; ties by id. Queries without such an object give none."""

    def f(sim, left, right):
        import pyarrow as pa

        own, ids = np.asarray(left["query_id"]), np.asarray(right["id"])
        shut = own[:, None] == ids[None]
        taken = left["taken"].combine_chunks()
        row = np.repeat(np.arange(len(own)), np.asarray(taken.value_lengths().fill_null(0)))
        order = np.argsort(ids)
        gone = np.asarray(taken.flatten())
        at = order[np.minimum(np.searchsorted(ids, gone, sorter=order), max(len(ids) - 1, 0))] if len(ids) else gone[:0]
        hit = ids[at] == gone[: len(at)]
        shut[row[: len(at)][hit], at[hit]] = True
        if regions:
            shut |= np.asarray(left["region"])[:, None] != np.asarray(right["region"])[None]
        sim[shut] = -np.inf
        if not len(ids):
            return {"query_id": pa.array(own[:0]), "id": pa.array(ids), "near": pa.array(np.zeros(0))}
        best = sim.max(1)
        chosen = np.where(sim == best[:, None], ids[None], np.iinfo(np.int64).max).min(1)
        some = best > -np.inf
        return {"query_id": pa.array(own[some]), "id": pa.array(chosen[some]), "near": pa.array(best[some])}

    met = meet(queries.select("query_id", "vec", "taken", "region"), gallery.select("id", "vec", "region"), f, "query_id long, id long, near double")
    return met.groupBy("query_id").agg(F.min_by("id", F.struct(-F.col("near"), "id")).alias("id"))


def compose(queries: DataFrame, gallery: DataFrame, mode: str = "iterative", weight: float = 0.3, least: float | None = None, max_objects: int = 25, max_seconds: float = 600.0, max_calls: int = 30, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, DataFrame]:
    """(objects, scenes): the objects placed, and how each scene ended.

    `queries`: scene, query_id, vec, region; `gallery`: id, vec, region. A scene's slots are
    its queries in the order of their ids. A call retrieves the best object that the scene
    hasn't got for the query, shifted by `weight` times the mean of what is placed (region:
    among objects of the query's region; parallel: unshifted, all slots at once, and slots
    may get the same object). An object less similar to what was asked than `least` isn't
    placed; the slot is asked once more, unshifted, and then the scene ends.

    objects: scene, step, query_id, chosen, sim. scenes: scene, n_queries, placed, calls,
    status (SUCCESS, or EXHAUSTED and then terminated_by: object_budget, call_budget,
    time_budget or no_candidate). Objects of exhausted scenes are there too; means are for
    scenes of status SUCCESS. All scenes share rounds, one call each; a round's objects and
    states are written under its number before the next begins, so a round that is repeated
    replaces itself and counts nothing twice. Time is the clock's since the first round, read
    between rounds. Regions are compared by equality, a null one equals none.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    spark, began = queries.sparkSession, clock()
    at = f"{shared_folder(spark)}/compose-{uuid.uuid4().hex}"
    region = F.coalesce(F.xxhash64("region"), F.lit(0)) if mode == "region" else F.lit(0)
    g = kept(gallery.select("id", unit(F.col("vec")).alias("vec"), (F.when(gallery["region"].isNull(), -1).otherwise(region) if mode == "region" else region).cast("long").alias("region")))
    slot = F.row_number().over(W.partitionBy("scene").orderBy("query_id")) - 1
    asked = kept(queries.select("scene", "query_id", unit(F.col("vec")).alias("vec"), region.cast("long").alias("region"), slot.alias("slot")))
    sizes = kept(asked.groupBy("scene").agg(F.count("*").cast("int").alias("n_queries")))
    bound = min(max_objects, max_calls)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    def placed_rows(q: DataFrame) -> DataFrame:
        """Each call with what it found; `id` is null where that isn't placed."""
        near = nearest_free(q, g, mode == "region").join(g.select("id", F.col("vec").alias("object")), "id")
        sim = dot(F.col("object"), F.col("vec"))
        found = q.join(near, "query_id", "left").withColumn("sim", sim)
        fits = F.lit(True) if least is None else F.col("sim") / F.greatest(F.sqrt(dot(F.col("vec"), F.col("vec"))), F.lit(1e-12)) >= least
        return found.withColumn("id", F.when(fits, F.col("id")))

    def ended(state: DataFrame) -> DataFrame:
        s = state.join(sizes, "scene")
        status = F.when(F.col("placed") == F.col("n_queries"), "SUCCESS").otherwise("EXHAUSTED")
        return s.select("scene", "n_queries", "placed", "calls", status.alias("status"), F.when(status == "EXHAUSTED", F.col("terminated_by")).alias("terminated_by"))

    columns = ["scene", F.col("slot").cast("long").alias("step"), "query_id", F.col("id").alias("chosen"), "sim"]
    if mode == "parallel":
        q = asked.where(F.col("slot") < bound).withColumn("taken", F.array().cast("array<long>"))
        done = written(placed_rows(q).select(*columns), "objects/round=0")
        got = done.groupBy("scene").agg(F.count("chosen").cast("int").alias("placed"), F.count("*").cast("int").alias("calls"))
        why = F.when(F.col("placed") < F.col("calls"), "no_candidate").when(F.col("calls") >= max_objects, "object_budget").otherwise("call_budget")
        state = sizes.select("scene").join(got, "scene", "left").na.fill(0, ["placed", "calls"]).withColumn("terminated_by", why)
        return done.where("chosen is not null"), ended(state)

    zero = [F.lit(0).alias(c) for c in ("slot", "tries", "placed", "calls")]
    start = F.when(F.lit(bound <= 0), "object_budget" if max_objects <= 0 else "call_budget")
    state = written(sizes.select("scene", *zero, F.lit(None).cast("array<double>").alias("layout"), F.array().cast("array<long>").alias("taken"), start.alias("terminated_by")), "state/0")
    asked.limit(0).select("scene", F.lit(0).cast("long").alias("step"), "query_id", F.col("query_id").alias("chosen"), F.lit(0.0).alias("sim")).write.parquet(f"{at}/objects/round=0")
    for n in range(1, max_calls + 1):
        live = state.where("terminated_by is null")
        if not live.limit(1).count():
            break
        shifted = F.when(F.col("tries") == 0, add(F.col("vec"), F.col("layout"), weight))
        q = written(asked.join(live, ["scene", "slot"]).withColumn("vec", F.coalesce(shifted, "vec")), f"calls/{n}")
        found = written(placed_rows(q), f"found/{n}")
        found.where("id is not null").select(*columns).write.mode("overwrite").parquet(f"{at}/objects/round={n}")
        hit, late = F.col("id").isNotNull(), clock() - began >= max_seconds
        one = hit.cast("int")
        mean = F.coalesce(F.zip_with("layout", "object", lambda a, b: (a * F.col("placed") + b) / (F.col("placed") + 1)), "object")
        now = found.join(sizes, "scene").select(
            "scene",
            (F.col("slot") + one).alias("slot"),
            F.when(hit, 0).otherwise(F.col("tries") + 1).alias("tries"),
            (F.col("placed") + one).alias("placed_"),
            (F.col("calls") + 1).alias("calls"),
            F.when(hit, mean).otherwise(F.col("layout")).alias("layout"),
            F.when(hit, F.array_append("taken", F.col("id"))).otherwise(F.col("taken")).alias("taken"),
            "n_queries",
        ).withColumnRenamed("placed_", "placed")
        shut_out = (F.col("tries") > 1) | ((F.col("tries") == 1) & F.lit(least is None))
        why = F.when(F.col("placed") == F.col("n_queries"), "done").when(shut_out, "no_candidate").when(F.col("placed") >= max_objects, "object_budget").when(F.col("calls") >= max_calls, "call_budget").when(F.lit(late), "time_budget")
        now = now.withColumn("terminated_by", why).select(*STATE.split(", "))
        state = written(state.where("terminated_by is not null").unionByName(now), f"state/{n}")
        for spent in (f"state/{n - 1}", f"calls/{n}", f"found/{n}"):
            remove(spark, f"{at}/{spent}")
    objects = spark.read.parquet(f"{at}/objects").drop("round")
    return objects, ended(state)
