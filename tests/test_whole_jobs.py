"""Queries give all rows of their job, and hold no more of it than they need."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.operators import aggregates, clouds, graph, layout, models, search
from orbweave.plans import catalog
from orbweave.sources.tables import load
from tests.duck import connect, differences
from tests.test_operators import frames, rows, scene


def test_shells_of_all_houses(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem")
    alone = n.groupBy("l_orderkey").count().where("count = 1").count()
    got = catalog.QUERIES["depth_shell"](spark, sf_dir)
    assert alone and got.count() == n.count()
    assert got.where("x = 0 and y = 0 and z = 0").count() >= alone
    d = spark.createDataFrame([("b", 0, 1.0, 1.0, 1.0), ("b", 1, 1.0, 1.0, 1.0)], "g string, i int, x double, y double, z double")
    assert rows(clouds.shells(d, "g", "i", 9, degenerate=True), "g", "n", "cloud") == [("b", 2, [[0.0, 0.0, 0.0, 0.5, 0.5, 0.5]] * 2)]


def test_all_pairs_of_queries(spark, sf_dir):
    n, q = (load(spark, sf_dir, "embeddings").where(c).count() for c in ("true", "vec_id % 20 = 0"))
    got = catalog.QUERIES["cosine_pairs"](spark, sf_dir)
    assert got.count() == q * (n - 1) == got.distinct().count()
    assert got.where(F.col("sim") < 0.2).count()


def test_blocks_of_a_search_are_held_in_strips(spark, monkeypatch):
    import tracemalloc



    taken = {}

    class Grouped:  # what meet() hands to Spark, called here with one pair of blocks
        def __init__(self, d):
            self.d = d

        def cogroup(self, other):
            return self

        def applyInArrow(self, f, schema):
            taken["f"] = f
            return spark.createDataFrame([], schema)

    d = spark.createDataFrame([], "id long, label int, vec array<double>")
    monkeypatch.setattr(type(d), "groupBy", lambda self, *c: Grouped(self))
    search.meet(d, d, lambda sim, q, g: {"n": pa.array((sim >= 0.5).sum(1)), "of": pa.array(np.full(len(sim), sim.shape[1]))}, "n long, of long")
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3000, 4)), rng.normal(size=(2000, 4))
    left, right = (pa.table({"vec": pa.array(list(v))}) for v in (x, y))
    tracemalloc.start()
    got = taken["f"](left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = [v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (x, y)]
    assert got["of"].to_pylist() == [2000] * 3000
    assert got["n"].to_pylist() == (np.floor(unit[0] @ unit[1].T * 1e9 + 0.5) / 1e9 >= 0.5).sum(1).tolist()
    assert peak < 3000 * 2000 * 8 / 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_graphs_are_made_once_and_not_dealt_again(spark, sf_dir):
    for name in ("layout_layer", "message_layer_two_mlp", "layout_embedding", "loo_query", "se3_invariance"):
        p = plan(catalog.QUERIES[name](spark, sf_dir))
        assert p.count("MapInArrow") == 1 and p.count("Window [") == 1, name
        if name != "se3_invariance":  # which deals its greatest changes besides
            assert p.count("Exchange hashpartitioning") == 1, name


def test_near_graphs_against_graphs_of_rows(spark):
    nodes, _ = scene(6, houses=30)
    n, _ = frames(spark, nodes, [(0, 0, 0, None)])
    n = n.union(n.where("house = 3").withColumn("house", F.lit(77).cast("long")))

    def relate(house, i, j):
        return np.stack([i + j, i * j], 1) / 4.0, (i + j + house) % 3 > 0

    edge = F.when((F.col("i") + F.col("j") + F.col("house")) % 3 > 0, F.array((F.col("i") + F.col("j")) / 4, F.col("i") * F.col("j") / 4))
    for target in (None, 0, 1):
        e, m = graph.both_ways(graph.knn(n, 2)), n
        if target is not None:
            e, m = graph.without(e, target), n.where(F.col("idx") != target).withColumn("idx", F.col("idx") - (F.col("idx") > target).cast("long"))
        e, near = e.withColumn("edge", edge), layout.Near(2, relate, target)
        for choices in ({}, {"two_nets": True, "spread": "mean", "unit": True, "squared": False}, {"absolute": True, "pooling": "max"}):
            enc = layout.demo_encoder(3, 2, **choices)
            for got, want in ((layout.near_nodes(n, near, enc), layout.encode_nodes(m, e, enc)), (layout.near_layouts(n, near, enc), layout.encode_layouts(m, e, enc))):
                got, want = (sorted(x.collect(), key=lambda r: (r.house, r[1] if "idx" in r else 0)) for x in (got, want))
                assert [(r.house, r[1]) for r in got if "idx" in r] == [(r.house, r[1]) for r in want if "idx" in r] and len(got) == len(want)
                for a, b in zip(got, want):
                    assert a.house == b.house and np.allclose(a[-1], b[-1], rtol=1e-9, atol=1e-12)
    with pytest.raises(Exception, match="without gaps"):
        layout.near_nodes(n.where("idx <> 0"), layout.Near(2, relate), layout.demo_encoder(3, 2)).collect()


def test_images_of_small_tables_spread_and_are_dealt_once(spark, sf_dir, monkeypatch):
    from orbweave.plans import answers

    monkeypatch.setattr(answers, "PARTS", 50)
    n = load(spark, sf_dir, "part").count()
    images = answers.images(spark, sf_dir)
    assert images.rdd.getNumPartitions() == -(-n // 50) and images.count() == 11 * n
    p = plan(models.gathered(images, "p_partkey", "view", "image", 11, 11))
    assert p.count("Exchange") == 1


def test_aggregates_join_what_they_hold_a_few_times(spark, monkeypatch):
    sizes = []
    add = aggregates.JOIN["sum"]
    monkeypatch.setitem(aggregates.JOIN, "sum", lambda x, start: sizes.append(len(x)) or add(x, start))
    taken = []
    d = spark.createDataFrame([(0, [1.0])], "g long, v array<double>")
    run = type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, f, schema: taken.append((f, self.schema)) or run(self, f, schema))
    aggregates.vector_aggregates(d, ["g"], "v", {"v": "sum"})
    f, schema = taken[0]
    batches = [pa.RecordBatch.from_arrays([pa.array([str(i)]), pa.array([i]), pa.array([1]), pa.array([[1.0 * i]])], names=schema.names) for i in range(500)]
    got = pa.Table.from_batches(list(f(iter(batches))))
    assert sorted(got["sum"].to_pylist()) == [[1.0 * i] for i in range(500)]
    assert sum(sizes) < 5000  # with a join for each batch, 125,250


def test_sizes_of_flat_values_and_their_batches():
    values = pa.array([b"abc", b"", b"x" * 50, b"yz"])
    assert models.sizes_of(values).tolist() == [3, 0, 50, 2] and models.sizes_of(values.slice(2)).tolist() == [50, 2]
    assert models.batches_of(np.array([3, 0, 50, 2]), 2, 10) == [(0, 2), (2, 3), (3, 4)]
    assert models.batches_of(np.array([9, 1, 1]), 5, 10) == [(0, 2), (2, 3)] and models.batches_of(np.array([], np.int64), 5, 10) == []


def test_neighbours_are_found_in_one_window(spark, sf_dir):
    from orbweave.plans.answers import neighbours

    n = neighbours(spark, sf_dir)
    p = plan(n)
    assert p.count("Join") == 1 and p.count("Scan parquet") == 2  # parts only: no house meets itself
    assert n.where("j <> i + 1 or a is null or b is null").count() == 0 < n.count()


def test_pairs_deal_each_side_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "PAIR_BLOCK", 16)
    n, q = (load(spark, sf_dir, "embeddings").where(c).count() for c in ("true", "vec_id % 20 = 0"))
    got, sc = catalog.QUERIES["cosine_pairs"](spark, sf_dir), spark.sparkContext
    sc.setJobGroup("pairs", "pairs of many blocks")
    found = got.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not differences(connect(sf_dir), catalog.ORACLES["cosine_pairs"], got.columns, found)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("pairs") for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages) == n + q
    assert "Broadcast" not in plan(got)


def test_pairs_leave_a_task_in_strips(spark, monkeypatch):
    taken = []
    d = spark.createDataFrame([], "query_id long, id long, label int, vec array<double>")
    monkeypatch.setattr(search, "CELLS", 100)
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, f, schema: taken.append(f) or spark.createDataFrame([], schema))
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(20, 4))
    y[7, 2] = np.nan

    def block(name, ids, vectors):
        t = pa.table({name: pa.array(ids), "label": pa.array(ids, pa.int32()), "vec": pa.array(list(vectors))})
        return pa.ListArray.from_arrays([0, len(t)], t.to_struct_array().combine_chunks())

    batch = pa.RecordBatch.from_arrays([block("query_id", range(30), x), block("id", range(20, 40), y)], ["left", "right"])
    unit = [v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (x, y)]
    sim = np.floor(unit[0] @ unit[1].T * 1e9 + 0.5) / 1e9
    for choices in ({}, {"decimals": 2}, {"least": 0.5}):
        search.scores(d, d, **choices)
        out = list(taken.pop()(iter([batch])))
        assert len(out) == 6 and max(b.num_rows for b in out) <= 100
        got = pa.Table.from_batches(out).to_pylist()
        shown = np.floor(sim * 100 + 0.5) / 100 if "decimals" in choices else sim
        want = [(i, j + 20, j + 20, repr(float(shown[i, j]))) for i in range(30) for j in range(20) if i != j + 20 and not sim[i, j] < choices.get("least", -2) and not ("least" in choices and np.isnan(sim[i, j]))]
        assert [(r["query_id"], r["id"], r["label"], repr(r["sim"])) for r in got] == want
