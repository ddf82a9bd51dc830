"""Operators against plain loops, and checks against planted faults."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions.text import contract_id, unwrap
from orbweave.operators import aggregates, cameras, checks, clouds, graph, layout, models, report, sampling
from orbweave.plans import catalog, geometry, text


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


# --- layout encoder ---------------------------------------------------------------------------


def scene(seed, houses=5):
    """Nodes, edges (house, i, j, edge) of small random graphs; some relations are missing."""
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for h in range(houses):
        n = int(rng.integers(1, 6))
        for i in range(n):
            nodes.append((h, i, *map(float, rng.normal(size=3)), list(map(float, rng.normal(size=3)))))
        for i, j in itertools.permutations(range(n), 2):
            if rng.random() < 0.6:
                edges.append((h, i, j, None if rng.random() < 0.3 else list(map(float, rng.normal(size=2)))))
    return nodes, edges


def frames(spark, nodes, edges):
    a = spark.createDataFrame(nodes, "house long, idx long, x double, y double, z double, feature array<double>")
    return a.repartition(3), spark.createDataFrame(edges, "house long, i long, j long, edge array<double>").repartition(3)


def silu(u):
    return [v / (1 + math.exp(-v)) for v in u]


def linear(x, a, b):
    return [sum(x[k] * a[k][o] for k in range(len(x))) + b[o] for o in range(len(b))]


def net(n, x):
    return linear(silu(linear(x, n.a, n.b)), n.c, n.d)


def by_hand(nodes, edges, enc):
    """The encoder one node and one edge at a time."""
    out = {}
    for house in sorted({n[0] for n in nodes}):
        here = sorted(n for n in nodes if n[0] == house)
        x = [list(n[2:5]) for n in here]
        h = [linear((x[i] if enc.absolute else []) + n[5], *enc.into) for i, n in enumerate(here)]
        links = [(i, j, linear(e if e is not None else list(enc.missing), *enc.edge)) for g, i, j, e in edges if g == house]
        degree = [max(1, sum(i == k for i, _, _ in links)) for k in range(len(here))]
        for layer in enc.layers:
            new_h, move, seen = [list(v) for v in h], [[0.0] * 3 for _ in h], []
            for i, j, e in links:
                d = [a - b for a, b in zip(x[i], x[j])]
                d2 = sum(v * v for v in d)
                s = d2 if enc.squared else math.sqrt(d2 + 1e-12)
                if enc.unit:
                    d = [v / (math.sqrt(d2) + 1e-8) for v in d]
                seen.append((d, s))
                m = net(layer.message, h[i] + h[j] + [s] + e)
                add = net(layer.feature, m) if layer.feature else m
                new_h[i] = [a + b for a, b in zip(new_h[i], add)]
                if layer.feature:
                    move[i] = [a + b * net(layer.position, m)[0] for a, b in zip(move[i], d)]
            if not layer.feature:
                ends = new_h if enc.fresh else h
                for (i, j, e), (d, s) in zip(links, seen):
                    w = net(layer.position, ends[i] + ends[j] + [s] + e)[0]
                    move[i] = [a + b * w for a, b in zip(move[i], d)]
            h = new_h
            x = [[a + b / (degree[k] if enc.spread == "mean" else 1) for a, b in zip(x[k], move[k])] for k in range(len(x))]
        out[house] = ([linear(v, *enc.out) for v in h], x)
    return out


CHOICES = [{}, {"two_nets": True}, {"two_nets": True, "fresh": False, "squared": False}, {"spread": "mean", "unit": True}, {"absolute": True}]


@pytest.mark.parametrize("choices", CHOICES)
def test_nodes_and_layouts_against_plain_loops(spark, choices):
    nodes, edges = scene(3)
    enc = layout.demo_encoder(3, 2, hidden=4, width=5, **choices)
    want = by_hand(nodes, edges, enc)
    a, b = frames(spark, nodes, edges)
    got = layout.encode_nodes(a, b, enc).collect()
    assert len(got) == len(nodes)
    for r in got:
        h, x = want[r.house]
        assert np.allclose(r.h, h[r.idx]) and np.allclose([r.x, r.y, r.z], x[r.idx])
    for pooling, how in (("mean", np.mean), ("sum", np.sum), ("max", np.max)):
        enc.pooling = pooling
        for r in layout.encode_layouts(a, b, enc).collect():
            assert np.allclose(r.layout, how(want[r.house][0], axis=0))


def test_graphs_that_are_refused(spark):
    nodes, edges = scene(4)
    enc = layout.demo_encoder(3, 2)
    a, b = frames(spark, nodes, edges)
    assert layout.encode_layouts(a.limit(0), b.limit(0), enc).collect() == []
    for x, y, why in ((a, b.withColumn("j", F.lit(99).cast("long")), "no node"), (a.limit(0), b, "no node"), (a.withColumn("feature", F.array(F.lit(1.0))), b, "encoder takes 3"), (a, b.withColumn("edge", F.array(F.lit(1.0))), "encoder takes 2")):
        with pytest.raises(Exception, match=why):
            layout.encode_layouts(x, y, enc).collect()
    with pytest.raises(ValueError, match="unknown spread"):
        layout.demo_encoder(3, 2, pooling="median")


def test_invariance_holds_and_its_gate_can_fail(spark, sf_dir):
    got = {r.encoder: r for r in catalog.QUERIES["se3_invariance"](spark, sf_dir).collect()}
    ok, bad = got["invariant"], got["absolute"]
    assert ok.passes and max(ok.rotation, ok.translation, ok.both) < 1e-6
    assert not bad.passes and min(bad.rotation, bad.translation, bad.both) > 1e-3


def test_leave_one_out_has_no_trace_of_the_target(spark, sf_dir):
    got = {r.house: r.layout for r in catalog.QUERIES["loo_query"](spark, sf_dir).collect()}
    whole = {r.house for r in catalog.QUERIES["layout_embedding"](spark, sf_dir).collect()}
    assert set(got) == whole  # houses of node 1 alone don't occur: numbering starts at 0


def test_knn_against_a_plain_loop(spark, monkeypatch):
    nodes, _ = scene(8, houses=12)
    a, _ = frames(spark, nodes + [(99, i, 0.0, 0.0, 0.0, [0.0] * 3) for i in range(5)], [(0, 0, 0, None)])
    want = set()
    for house in {r[0] for r in nodes} | {99}:
        here = {n[1]: n[2:5] for n in nodes if n[0] == house} or {i: (0.0,) * 3 for i in range(5)}
        for i, x in here.items():
            near = sorted((sum((p - q) ** 2 for p, q in zip(x, y)), j) for j, y in here.items() if j != i)
            want |= {(house, min(i, j), max(i, j)) for _, j in near[:2]}
    assert set(rows(graph.knn(a, 2), "house", "i", "j")) == want
    with_up = a.withColumn("up", F.when(F.col("idx") % 2 == 1, F.col("idx") - 1).when(F.col("idx") == 2, F.lit(77)))
    up = {(h, i - 1, i) for h, i in ((r.house, r.idx) for r in a.collect()) if i % 2}
    for most in (graph.PAIRS, 9):
        monkeypatch.setattr(graph, "PAIRS", most)
        assert set(rows(graph.knn(a, 2), "house", "i", "j")) == want
        assert set(rows(graph.scene_edges(a if most > 9 else a.repartition(2), 2, None))) == {(*e, False) for e in want}
        assert set(rows(graph.scene_edges(with_up, 2, "up"))) == {(*e, False) for e in want - up} | {(*e, True) for e in up}
    e = graph.knn(a, 2)
    moved = lambda i: i - (i > 1)
    assert set(rows(graph.without(e, 1))) == {(h, moved(i), moved(j)) for h, i, j in want if 1 not in (i, j)}


# --- checks -----------------------------------------------------------------------------------


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_leakage_and_completeness_see_planted_faults(spark):
    assert checks.leakage(ids(spark, 1, 2), ids(spark, 3), "id").first().leaked == 0
    assert checks.leakage(ids(spark, 1, 2, 2), ids(spark, 2, 2, 3), "id").first().leaked == 1
    assert rows(checks.completeness(ids(spark, 1, 2), ids(spark, 1), ids(spark, 2), "id")) == [(0, 0, 0)]
    assert rows(checks.completeness(ids(spark, 1, 2, 3), ids(spark, 1, 9), ids(spark, 1, 1, 2), "id")) == [(1, 1, 2)]


def test_batches_see_planted_faults(spark, sf_dir):
    b = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (3, "d"), (3, "e")], "batch long, asset string")
    assert rows(checks.batch_faults(b, ["batch"], "asset", 2)) == [(1, 3, 1), (3, 3, 0)]
    done = catalog.QUERIES["unique_batches"](spark, sf_dir)
    assert checks.batch_faults(done, ["batch"], "asset", 32).count() == 0
    sizes = [r[0] for r in done.groupBy("batch").count().select("count").collect()]
    assert max(sizes) - min(sizes) <= 1 and done.select("house", "idx").distinct().count() == sum(sizes)
    assert len(sizes) == max(-(-sum(sizes) // 32), done.groupBy("asset").count().agg(F.max("count")).first()[0])
    hot = spark.range(100).selectExpr("id", "CASE WHEN id < 40 THEN NULL ELSE id END AS a")
    got = sampling.unlike_batches(hot, "a", ["id"], 32).collect()
    assert len({r.batch for r in got}) == 40 and len({r.batch for r in got if r.a is None}) == 40
    assert sampling.unlike_batches(hot.limit(0), "a", ["id"], 32).collect() == []


def test_coverage_sees_planted_faults(spark):
    t, s = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["a.w", "b.w", "c.w", "c.w"], ["a.w", "c.w", "d.w", "c.x"]))
    assert rows(checks.coverage(t, s, ["c."])) == [("b.w", "not saved"), ("c.w", "frozen but trained"), ("d.w", "saved but never trained")]
    assert rows(checks.coverage(t, t, [])) == []


def test_incomplete_gallery_rows_raise(spark):
    d = spark.createDataFrame([(1, 7), (2, 3), (3, None)], "id long, bits long")
    guard = checks.required(F.col("id"), F.col("bits") == 7, "complete rows only")
    assert rows(d.where("id = 1").select(guard.alias("id"))) == [(1,)]
    for bad in (2, 3):
        with pytest.raises(Exception, match="complete rows only"):
            d.where(F.col("id") == bad).select(guard).collect()


def test_serializer_differences_are_reported(spark, sf_dir):
    good = text.serialized(spark, sf_dir)
    again = good.withColumnRenamed("text", "again")
    assert text.differing(good, again).count() == 0
    bad = again.where("p_partkey <> 3").withColumn("again", F.when(F.col("p_partkey") == 2, F.regexp_replace("again", "[.]$", "!")).otherwise(F.col("again")))
    assert [k for k, in rows(text.differing(good, bad).select(F.coalesce("p_partkey", F.lit(-1))))] == [2, 3]


# --- models, text, trees, reports -------------------------------------------------------------


def test_encoder_is_loaded_once_and_checked(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "id long, text string").coalesce(1)
    log = tmp_path / "loads"

    def load():
        log.open("a").write("x")
        inner = models.hashed_words(8)()
        return lambda texts: inner(texts) if len(texts) <= 2 else [[0.0]] * len(texts)

    got = {r.id: r.embedding for r in models.encode(d, "text", load, 8, batch=2).collect()}
    assert log.read_text() == "x" and got[2] is None and got[3] == [0.0] * 8
    assert got[1] == got[4] and np.isclose(np.linalg.norm(got[1]), 1)
    for width, model in ((9, models.hashed_words(8)), (1, lambda: lambda t: [[float("nan")]] * len(t))):
        with pytest.raises(Exception, match="the model gave"):
            models.encode(d, "text", model, width).collect()


def test_inputs_of_a_record_come_whole_and_in_order(spark):
    d = spark.createDataFrame([(k, o, bytes([k, o])) for k in (1, 2, 3) for o in (2, 0, 1)], "k long, o int, v binary").repartition(5)
    got = {r.k: [bytes(x) for x in r.inputs] for r in models.gathered(d, "k", "o", "v", 3, 3).collect()}
    assert got == {k: [bytes([k, o]) for o in range(3)] for k in (1, 2, 3)}
    for bad, why in ((d.where("k <> 2 or o <> 1"), "k = 2 has 2 views"), (d.withColumn("o", F.expr("o % 2")), "3 views at 2 places"), (d.withColumn("v", F.expr("CASE WHEN o < 2 THEN v END")), "2 of them whole"), (d.union(d.withColumn("o", F.expr("o + 3"))), "6 views")):
        with pytest.raises(Exception, match=why):
            models.gathered(bad, "k", "o", "v", 3, 3).collect()
    assert models.gathered(d.limit(0), "k", "o", "v", 3).collect() == []


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    log = tmp_path / "calls"

    def load():
        def model(images, names):
            with log.open("a") as f:
                f.write(f"{len(images)} {sum(sum(map(len, x)) for x in images)} {len(names)}\n")
            return [[float(sum(map(len, x)))] for x in images]

        return model

    sizes = [100] * 30 + [5000, 10, 4000, 3000, 10]
    d = spark.createDataFrame([(i, [b"x" * (n // 2)] * 2, "n") for i, n in enumerate(sizes)] + [(99, None, "n"), (98, [b"a"], None)], "id long, x array<binary>, name string").coalesce(1)
    got = {r.id: r.embedding for r in models.encode(d, ["x", "name"], load, 1, batch=20, normalise=False, most_bytes=4500).collect()}
    assert got == {i: [float(n)] for i, n in enumerate(sizes)} | {99: None, 98: None}
    calls = [tuple(map(int, x.split())) for x in log.read_text().splitlines()]
    assert sum(c[0] for c in calls) == len(sizes) and all(n == m for n, _, m in calls)
    assert all(n <= 20 and (b <= 4500 or n == 1) for n, b, _ in calls) and (1, 5000, 1) in calls and len(calls) <= 7


def test_texts_are_asked_for_again_once(spark):
    asked = []

    def load():
        return lambda p: {"ok": "fine", "bad": "", "bad (empty)": "better", "worse": "", "worse (empty)": ""}[p]

    d = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "worse"), (4, "unknown"), (5, None)], "id long, p string")
    got = rows(models.write_checked(d, "id", "p", load, lambda t: None if t else "empty", lambda p, t, why: f"{p} ({why})"), "id", "attempts", "text")
    assert got == [(1, 1, "fine"), (2, 2, "better"), (3, 2, None), (4, 2, None), (5, 0, None)] and not asked
    why = dict(rows(models.write_checked(d, "id", "p", load, lambda t: None if t else "empty", lambda p, t, why: p), "id", "reason"))
    assert why[1] is None and why[3] == "empty" and why[4].startswith("KeyError") and why[5] == "no prompt"


def test_trees_inherit_rooms_and_refuse_nonsense(spark):
    deep = '{"id":"x","children":[' * 60 + "]}" * 60
    good = '{"objects":[{"id":"table","room":"r1","asset":7,"children":[{"id":"cup","room":"r9","children":[]},{"id":"plate"}]},{"id":"lamp","room":"r2"}]}'
    d = spark.createDataFrame([(1, good), (2, '{"objects":[' + deep.replace('{"id":"x"', '{"room":"a","id":"x"', 1) + "]}")], "house long, tree string")
    got = models.flatten_trees(d).collect()
    assert [(r.idx, r.id, r.asset, r.parent, r.depth, r.room) for r in got if r.house == 1] == [(0, "table", 7, None, 0, "r1"), (1, "cup", None, 0, 1, "r1"), (2, "plate", None, 0, 1, "r1"), (3, "lamp", None, None, 0, "r2")]
    assert max(r.depth for r in got if r.house == 2) == 59
    for bad in ("{", '{"objects":[]}', '{"objects":[{"room":"r"}]}', "[]", None):
        with pytest.raises(Exception, match="house 5"):
            models.flatten_trees(spark.createDataFrame([(5, bad)], "house long, tree string")).collect()


@pytest.mark.parametrize("raw,want", [
    ("With pleasure: The cup stands.", "The cup stands."),
    ("Result: 'x'", "x"),
    ("The cup: a small one", "The cup: a small one"),
    ("Where the TABLES are: near it", "near it"),
    ("Beside the table: a cup", "Beside the table: a cup"),
    ("A view of a ratio: two to one", "two to one"),
    ("It was at 10:30 there", "It was at 10:30 there"),
    ("```text\nSee below:\nok\nmore```", "ok"),
    ("Time matters. The cup has one use: tea", "Time matters. The cup has one use: tea"),
    ("no colon", "no colon"),
    ("", ""),
])
def test_headings_go_and_colons_of_sentences_stay(spark, raw, want):
    d = spark.createDataFrame([(raw, "a white Cup", "table, of oak", None)], "t string, a string, b string, c string")
    assert d.select(unwrap(F.col("t"), F.col("a"), F.col("b"), F.col("c")).alias("t")).first().t == want


def test_contract_changes_with_any_rule():
    a = contract_id("f", 1, {"x": [1, 2], "y": "é"})
    assert a == contract_id("f", 1, {"y": "é", "x": [1, 2]}) and a.startswith("f_v1@") and len(a) == 5 + 16
    assert len({a, contract_id("f", 1, {"x": [2, 1], "y": "é"}), contract_id("f", 2, {"x": [1, 2], "y": "é"})}) == 3


@pytest.mark.parametrize("v,want", [(0, "0"), (0.5, "0.5"), (0.00012, "1.2e-04"), (1234, "1,234"), (12.3456, "12.35"), (2_000_000.0, "2.0e+06"), (None, ""), (True, "True"), (4321.7, "4,322"), ("a|b", "a|b")])
def test_numbers_of_labels(v, want):
    assert report.short(v) == want


def test_reports_are_small(spark):
    d = spark.createDataFrame([("b|c", 2.0), ("a", 1.5)], "k string, v double")
    assert report.markdown(d, "T", ["k"]).splitlines() == ["## T", "", "| k | v |", "|---|---|", "| a | 1.5 |", "| b\\|c | 2 |"]
    with pytest.raises(ValueError, match="at most"):
        report.markdown(spark.range(501).toDF("k"), "T", ["k"])


# --- queries without SQL ----------------------------------------------------------------------


def test_cameras_look_at_the_middle(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2.0, 4.0, 6.0), (2, 5.0, 5.0, 5.0)], "g long, x double, y double, z double")
    frames = cameras.frames_of(points, "g")
    assert rows(frames.where("g = 1")) == [(1, 1.0, 2.0, 3.0, 6.0)]
    for how in (lambda k, n: cameras.orbit_directions(k, n, 20.0), cameras.sphere_directions, lambda k, n: cameras.orbit_directions(k, n, 90.0)):
        got = cameras.look_at(cameras.place_cameras(frames, 5, how, 2.0)).collect()
        assert len(got) == 10
        for r in got:
            if r.g == 2:
                assert (r.x, r.y, r.z) == (5, 5, 5) and r.back_x is None and r.right_x is None
                continue
            axes = np.array([[r[f"{a}_{c}"] for c in "xyz"] for a in ("right", "up", "back")])
            away = np.array([r.x - 1, r.y - 2, r.z - 3])
            assert np.allclose(axes @ axes.T, np.eye(3)) and np.isclose(np.linalg.det(axes), 1)
            assert np.isclose(np.linalg.norm(away), 12) and np.allclose(axes[2], away / 12)
            assert axes[1][2] >= 0 or abs(axes[2][2]) > 0.999  # up is up


def test_depth_fusion_takes_only_hits(spark, sf_dir):
    inf = float("inf")
    rows = [(a, v, p, 1, 0.1, -0.2, z) for a, n in ((1, 30), (2, 3), (None, 2)) for v in range(2) for p, z in enumerate([0.5 + 0.01 * p for p in range(n)] + [inf, -inf, float("nan"), 9.0])]
    rows += [(7, 0, 0, 1, 0.1, 0.1, inf), (7, 1, 0, 1, 0.1, 0.1, None)]
    f = spark.createDataFrame(rows, "asset long, view int, pixel long, again int, u double, v double, depth double").repartition(4)
    got = geometry.fused(f, 2.0, 20)
    hits = geometry._world(f.where("depth < 2 and depth > -1"), 20.0, F.col("view") * 30.0)
    assert got.join(hits, [got[c].eqNullSafe(hits[c]) for c in ("asset", "view", "x", "y", "z")], "left_anti").count() == 0
    each = {r.asset: (r.n, r.places, r.points) for r in got.groupBy("asset").agg(F.count("*").alias("n"), F.count_distinct("at").alias("places"), F.count_distinct("x", "y", "z").alias("points")).collect()}
    assert each == {1: (20, 20, 20), 2: (20, 20, 6), None: (20, 20, 4)}
    assert rows_of(geometry.unseen(f, 2.0)) == [(7,)] and geometry.fused(f.limit(0), 2.0, 20).collect() == []
    turns = [r.c for r in got.where("asset = 2").groupBy("x", "y", "z").agg(F.count("*").alias("c")).collect()]
    assert sorted(turns) == [3, 3, 3, 3, 4, 4]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [10, 200_000])
def test_least_rows_of_each_group(spark, monkeypatch, most):
    monkeypatch.setattr(sampling, "ROWS", most)
    d = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id % 70 ELSE 1 END AS g", "hash(id) * 4294967296L + id AS h", "id AS `x.y`").repartition(6)
    want = {}
    for r in d.collect():
        want.setdefault(r.g, []).append((r.h, r["x.y"]))
    got = {}
    for r in sampling.bottom_k(d, "g", "h", 25).collect():
        got.setdefault(r.g, []).append((r.h, r["x.y"]))
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:25] for g, v in want.items()}


@pytest.mark.parametrize("held", [16, 1 << 20])
def test_vector_aggregates_against_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(aggregates, "HELD", held)
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else f"k{g}", int(g) % 2, (rng.normal(size=6) * (400 if g == 2 else 1)).tolist()) for g in [0] * 900 + rng.integers(0, 40, 900).tolist()]
    rows += [("k1", 1, None), ("gone", 0, None), ("low", 0, [float("-inf")] * 6), ("low", 0, [float("-inf"), 1.0, 2.0, 3.0, 4.0, 5.0])]
    d = spark.createDataFrame(rows, "a string, b int, v array<double>").repartition(7)
    kinds = {"s": "sum", "m": "mean", "top": "max", "bottom": "min", "lse": "logsumexp"}
    got = {(r.a, r.b): r for r in aggregates.vector_aggregates(d, ["a", "b"], "v", kinds).collect()}
    groups = {}
    for a, b, v in rows:
        if v is not None:
            groups.setdefault((a, b), []).append(v)
    assert set(got) == set(groups)
    for k, x in groups.items():
        x, r = np.array(x), got[k]
        with np.errstate(invalid="ignore", divide="ignore"):
            assert r.n == len(x) and np.allclose(r.s, x.sum(0)) and np.allclose(r.m, x.mean(0)) and r.top == x.max(0).tolist() and r.bottom == x.min(0).tolist()
            assert np.allclose(r.lse, np.logaddexp.reduce(x, axis=0))
    one = aggregates.vector_aggregates(d.where("a <> 'low'"), [], "v", {"s": "sum"}).first()
    assert np.allclose(one.s, sum(np.sum(x, axis=0) for k, x in groups.items() if k[0] not in (None, "low")))
    assert aggregates.vector_aggregates(d.limit(0), ["a"], "v", kinds).collect() == []
    for bad in ([1.0], [1.0, None, 1.0, 1.0, 1.0, 1.0]):
        with pytest.raises(Exception, match="widths"):
            aggregates.vector_aggregates(d.union(spark.createDataFrame([("k1", 1, bad)], d.schema)), [], "v", {"s": "sum"}).collect()
    with pytest.raises(ValueError, match="median"):
        aggregates.vector_aggregates(d, [], "v", {"s": "median"})


def test_farthest_points_against_a_plain_loop(spark, sf_dir):
    from orbweave.sources.tables import nodes

    here = {}
    for r in nodes(spark, sf_dir).where("house <= 400").collect():
        here.setdefault(r.house, {})[r.idx] = np.array([r.x, r.y, r.z])
    got = rows(catalog.QUERIES["farthest_points"](spark, sf_dir).where("house <= 400"), "house", "rank", "idx")
    want = []
    for h, x in here.items():
        taken = [0]
        while len(taken) < min(3, len(x)):
            gap = {i: min(((v - x[t]) ** 2).sum() for t in taken) for i, v in x.items()}
            taken.append(min(gap, key=lambda i: (-gap[i], i)))
        want += [(h, n, i) for n, i in enumerate(taken)]
    assert got == sorted(want)


def test_fused_mlp_against_numpy(spark, sf_dir):
    for name in ("fuse_mlp", "fuse_masked_mlp"):
        for r in catalog.QUERIES[name](spark, sf_dir).join(geometry.slots(spark, sf_dir)[0], "vec_id").limit(20).collect():
            slots = [np.array(v) for v in (r.t, r.i, r.p)]
            on = [r.vec_id & 1, r.vec_id & 2, r.vec_id & 4]
            if name == "fuse_mlp":
                x = sum(s for s, m in zip(slots, on) if m) / max(1, sum(map(bool, on))) if any(on) else np.zeros(64)
            else:
                x = np.concatenate([s if m else 0.01 * np.arange(64) for s, m in zip(slots, on)])
            w = np.sin(np.arange(len(x) * 16).reshape(-1, 16) * 0.37) / np.sqrt(len(x))
            h = x @ w
            h = h * 0.5 * (1 + np.tanh(0.7978845608 * (h + 0.044715 * h**3)))
            assert np.allclose(r.fused, h @ w[:64].T)


def test_rooms_keep_what_they_should(spark, sf_dir):
    for r in catalog.QUERIES["rewrite_struct"](spark, sf_dir).collect():
        assert all(x.ceilings == [] for x in r.rooms) and [k.id for k in r.kept] == [min(x.id for x in r.rooms)]
        assert [x.id for x in r.rooms] == sorted(x.id for x in r.rooms)


def test_foreign_letters_and_settings(spark, sf_dir):
    assert text._foreign.func(__import__("pandas").Series(["naïve 日本 日 ½ × ж", None, "plain"])).tolist() == ["日本ж", "", ""]
    one = catalog.QUERIES["config_hash"](spark, sf_dir).first().config_hash
    import hashlib
    import json

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    want = json.dumps(dict(sorted((r.n_name, str(r.n_regionkey)) for r in n)), separators=(",", ":"))
    assert one == hashlib.sha256(want.encode()).hexdigest()


def test_pages_of_curves(spark, sf_dir, monkeypatch):
    nan, inf = float("nan"), float("inf")
    log = spark.createDataFrame([("a<b", i, float(i * i), None) for i in range(50)] + [("a<b", 50, nan, None), ("a<b", 51, -1.5, None), ("z", 1, 2.0, 7), ("z", 2, inf, 8)], "run string, step int, loss double, acc int")
    got = rows(report.curve_points(log, "run", "step", ["loss", "acc"], 10))
    assert [r[2] for r in got if r[:2] == ("a<b", "loss")] == [*range(0, 50, 6), 51] and got[-1] == ("z", "loss", 1, 2.0)
    page = report.curve_page(log, "T & U", "run", "step", {"Loss": ["loss"], "Both": ["loss", "acc"], "Gone": ["acc"]}, 10)
    assert page.count("<polyline") == 6 and page.count("no data") == 1 and "a&lt;b" in page and "T &amp; U" in page
    assert page.index("Loss") < page.index("Both") < page.index("Gone") and "last: loss -1.5</p>" in page and "http" not in page
    assert report.curve_page(log.limit(0), "E", "run", "step", {"Loss": ["loss"]}).endswith("<h1>E</h1></body></html>")
    monkeypatch.setattr(report, "MOST_LINES", 3)
    with pytest.raises(ValueError, match="at most 3 lines"):
        report.curve_page(log, "T", "run", "step", {"Loss": ["loss", "acc"]})
    monkeypatch.setattr(report, "MOST_LINES", 60)
    (one,) = catalog.QUERIES["curve_page"](spark, sf_dir).collect()
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().count()
    assert one.page.count("<h2>") == kinds and one.page.count("<polyline") == 2 * kinds - 1 and one.page.count("no data") == 1


def test_stages_checkpoints_and_iterations(spark):
    d = spark.createDataFrame([(1, None, 64, True), (2, "odd", 64, True), (3, "mean", 60, True), (4, "mean", 60, False), (5, "gated", 64, True)], "k int, f string, w int, l boolean")
    assert rows(d.select("k", checks.stage_fault(F.col("f"), F.col("w"), F.col("l"), 64).alias("x"))) == [(1, "fusion is required"), (2, "fusion = odd is unknown"), (3, "layout width 60 is not 64"), (4, None), (5, None)]
    a, b = (spark.createDataFrame(v, s) for v, s in (([(1,), (2,)], "id int"), ([(2, "x"), (9, "y")], "id int, h string")))
    assert rows(checks.checkpoints(a, b, "id", "h")) == [(1, None, "no checkpoint of 1: train it first"), (2, "x", None)]
    h = spark.createDataFrame([(1, None, True), (2, 3, False), (3, 1, True), (4, 5, True)], "house int, n long, branch boolean")
    assert rows(checks.layout_entries(h), "house", "n", "entry") == [(1, 0, "no layout"), (2, 3, "refused: no layout branch"), (3, 1, "context without edges"), (4, 5, "batch of one")]
    e = spark.createDataFrame([("u", t, s) for t, s in enumerate("xsxxsx")], "u string, t int, s string")
    assert rows(checks.iteration_counts(e, ["u"], ["t"], F.col("s") == "s"), "t", "iteration", "in_iteration", "in_run") == [(0, 0, 1, 1), (1, 1, 1, 2), (2, 1, 2, 3), (3, 1, 3, 4), (4, 2, 1, 5), (5, 2, 2, 6)]


def test_clouds_are_whole_or_refused(spark):
    d = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 0, 2.0, 0.0, 0.0), ("b", 0, 1.0, 1.0, 1.0), ("b", 1, 1.0, 1.0, 1.0)], "g string, i int, x double, y double, z double")
    n = clouds.normalised(d, "g")
    assert rows(n, "g", "i", "x", "degenerate") == [("a", 0, 1.0, False), ("a", 1, -1.0, False), ("b", 0, 0.0, True), ("b", 1, 0.0, True)]
    (one,) = clouds.shells(d.where("g = 'a'"), "g", "i", 9).collect()
    assert (one.g, one.n, one.cloud) == ("a", 2, [[1.0, 0.0, 0.0, 0.5, 0.5, 0.5], [-1.0, 0.0, 0.0, 0.5, 0.5, 0.5]])
    nan = d.where("g = 'a'").withColumn("z", F.when(F.col("i") == 0, float("nan")).otherwise(0.0))
    for bad, most, why in ((d, 9, "cloud b has one place only"), (d.where("g = 'a'"), 1, "cloud a has more than 1 points"), (nan, 9, "a point that isn't finite")):
        with pytest.raises(Exception, match=why):
            clouds.shells(bad, "g", "i", most).collect()
