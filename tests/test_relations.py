"""Joins, sets, splits, aggregates and windows against plain loops and planted faults."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from orbweave.operators import relations as R
from orbweave.operators import rules
from orbweave.operators import summaries as S


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def frame(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_admission_needs_every_table(spark):
    d = frame(spark, "k int", (1,), (2,), (2,), (None,))
    a, b = frame(spark, "x int", (1,), (2,), (2,)), frame(spark, "y int", (2,), (None,))
    assert rows(R.admitted(d, "k", (a, "x"))) == [(1,), (2,), (2,)] and rows(R.admitted(d, "k", (a, "x"), (b, "y"))) == [(2,), (2,)]
    assert rows(R.unmapped(d, "k", b, "y")) == [(1,), (None,)]


def test_edges_follow_the_index(spark):
    n = frame(spark, "house long, idx long, asset string", *((h, i, f"{h}{i}") for h in (1, 2) for i in range(3 * h - 2)))
    assert rows(R.next_edges(n, ["asset"])) == [(2, i, i + 1, f"2{i}", f"2{i + 1}") for i in range(3)]
    near = {(2, i, j) for i in range(4) for j in (i + 1, i + 2) if j < 4}
    assert set(rows(R.near_edges(n, 2))) == near and set(rows(R.symmetric_edges(R.near_edges(n, 2)))) == near | {(h, j, i) for h, i, j in near}
    e = frame(spark, "a string, b string", ("x", "y"), ("y", "x"), ("x", "x"))
    assert R.collapsed(e, "a", "b").first() == (3, 2, 0.333333)
    assert R.collapsed(e.limit(0), "a", "b").first() == (None, 0, None)


def test_the_last_head_before_a_row(spark):
    d = frame(spark, "g string, t int, h int", ("a", 1, 10), ("a", 2, None), ("a", 3, 30), ("a", 4, None), ("b", 5, None))
    assert rows(R.last_before(d, ["g"], ["t"], F.col("h"), "s"), "g", "t", "s") == [("a", 1, None), ("a", 2, 10), ("a", 3, 10), ("a", 4, 30), ("b", 5, None)]


def test_references_name_rows(spark):
    d, i = frame(spark, "u string", ("f#1",), ("f#2",)), frame(spark, "id long, v string", (1, "a"), (2, "b"))
    assert rows(R.dereferenced(d, "u", i, "id")) == [("f#1", "a"), ("f#2", "b")]
    for bad in ("f#7", "f", "f#x", None):
        with pytest.raises(Exception, match="reference to no row"):
            R.dereferenced(frame(spark, "u string", (bad,)), "u", i, "id").collect()


def test_splits_are_exact_and_repeat(spark):
    for n in (0, 1, 5, 8, 101):
        d = spark.range(n).withColumnRenamed("id", "k")
        want = sorted(range(n), key=lambda i: hashlib.sha256(f"9:{i}".encode()).hexdigest())[: round(n * 0.8)]
        for parts in (1, 5):
            s = R.seeded_split(d.union(d).repartition(parts), "k", 9)
            assert {r.id for r in s.where("split = 'train'").collect()} == set(want) and s.count() == n
    assert rows(R.protocols(s)) == [("A", 20, 20), ("B", 20, 101)]
    assert [R.half_even(n, 8) for n in range(12)] == [round(n * 0.8) for n in range(12)] and R.half_even(5, 5) == 2 and R.half_even(3, 5) == 2


def test_reasons_are_the_first(spark):
    d = frame(spark, "k int", (1,), (5,), (9,))
    assert rows(R.excluded(d, [(F.col("k") > 8, "large"), (F.col("k") > 4, "middling")])) == [(5, "middling"), (9, "large")]


def test_boxes_and_moments(spark):
    d = frame(spark, "g string, x double, y double, z double", ("a", 0.0, 0.0, 0.0), ("a", 2.0, 4.0, 6.0), (None, 1.0, 1.0, 1.0))
    assert rows(S.boxes(d, "g")) == [("a", 2.0, 4.0, 6.0, 48.0), (None, 0.0, 0.0, 0.0, 0.0)]
    assert rows(S.moments(d, "g")) == [("a", 1.0, 2.0, 3.0, round(math.sqrt(14), 6), 1.0, 4.0), (None, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)]


def test_cubes_tell_null_from_all(spark):
    d = frame(spark, "a string, b string, v int", ("x", "p", 1), ("x", None, 2))
    got = rows(S.cube(d, {"a": "u", "b": "w"}, n=F.count("*"), v=F.sum("v")))
    assert got == sorted([("x", "p", 1, 1), ("x", None, 1, 2), ("x", "all", 2, 3), ("all", "p", 1, 1), ("all", None, 1, 2), ("all", "all", 2, 3)], key=str)


def test_cells_without_evidence_say_so(spark):
    v, c = frame(spark, "variant string", ("x",), ("y",), ("x",)), frame(spark, "condition string", ("1",), ("2",))
    cells = frame(spark, "variant string, condition string, n long", ("x", "1", 30), ("y", "2", 29))
    assert rows(S.grid(v, c, cells, 30)) == [("x", "1", "30", "value"), ("x", "2", "NA", "NA"), ("y", "1", "NA", "NA"), ("y", "2", "29", "INSUFFICIENT_EVIDENCE")]


def test_means_are_over_complete_scenes(spark):
    d = frame(spark, "g int, complete boolean, score long", (1, True, 10), (1, False, 99), (1, True, 11), (2, False, 5), (3, None, 5))
    assert rows(S.completion(d, "g")) == [(1, 3, 2, 1, 0.666667, 10.5), (2, 1, 0, 1, 0.0, None), (3, 1, 0, 1, 0.0, None)]


def test_masks_have_their_share(spark):
    d = spark.range(4000).select("id", *[S.bernoulli(F.col("id"), n, 3, 0.7).alias(n) for n in "ab"])
    r = S.mask_rates(d, ["a", "b"]).first()
    assert abs(r.a - 0.3) < 0.03 and abs(r.b - 0.3) < 0.03 and abs(r.all_masked - 0.09) < 0.02


def test_series_and_downsampling(spark):
    d = frame(spark, "g string, t int, v long", *(("a", t, t * t) for t in range(45)), ("b", 0, 5), (None, 1, 1))
    got = {(r.g, r.t): (r.running, r.delta) for r in S.series(d, "g", ["t"], F.col("v")).collect()}
    assert got["a", 3] == (14, 5) and got["a", 0] == (0, None) and got["b", 0] == (5, None)
    kept = rows(S.downsampled(d, ["g"], ["t"], 20), "g", "t")
    assert kept == sorted([("a", t) for t in [*range(0, 45, 3), 44]] + [("b", 0), (None, 1)], key=str)
    assert S.top_k(d, "g", [F.desc("v")], 2).where("g = 'a'").select("t").collect() == [(44,), (43,)]


def test_tasks_and_runs(spark):
    d = frame(spark, "g string, s string, t int", ("a", "ok", 1), ("a", "bad", 2), ("b", "ok", 3), ("b", "wait", 1), ("c", "ok", 1))
    assert rows(S.readiness(d, "g", "s", "ok", "bad")) == [("a", False, True, True), ("b", True, True, False), ("c", True, True, True)]
    assert rows(S.unfinished(d, "g", "t", F.col("s") == "ok", 1)) == [] and rows(S.unfinished(d, "g", "t", F.col("s") == "bad", 1)) == [("b", 1, 0), ("c", 1, 0)]
    assert rows(S.ledger(frame(spark, "r string, c double", ("x", 0.1), ("x", 0.2), ("y", None)), "r", "c")) == [("x", 0.3, 2), ("y", None, 1)]


def test_first_last_and_greatest(spark):
    d = frame(spark, "g string, t long, v string", ("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "n"), ("b", 3, "m"))
    assert rows(rules.first_by(d, ["g"], ["t"])) == [("a", 1, "y"), ("b", None, "n")] and rows(rules.first_by(d, ["g"], ["t"], last=True)) == [("a", 2, "x"), ("b", 3, "m")]
    w = frame(spark, "g string, v long, k long", ("a", 5, 10**10 + 1), ("a", 5, 10**10), ("a", 4, 1), ("b", None, 3))
    assert rows(rules.greatest_with_witness(w, ["g"], "v", "k")) == [("a", 5, 10**10), ("b", None, 3)]
    ladder = {"good": F.col("k") < 5, "fair": F.col("k") < 10**10}
    assert rows(rules.worst(w, ["g"], ladder, "poor")) == [("a", "poor"), ("b", "good")]


def test_decisions_of_encoders(spark):
    d = frame(spark, "p string, a string, v string", ("frozen", "trainable", "mean"), ("trainable", "frozen", "random_single_view"), ("frozen", "frozen", "mean"))
    got = d.withColumns(rules.encoder_decisions(F.col("p"), F.col("a"), F.col("v")))
    assert rows(got.drop("p", "a", "v")) == sorted([(False, True, False, "none"), (True, False, True, "per_view"), (False, False, True, "aggregated")], key=str)
