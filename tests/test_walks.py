"""Closures, cycles, layers and include walks against plain loops."""

import random

import pytest

from orbweave.operators import walks



def graph(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string").repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def reach(pairs):
    """{(a, b): least number of edges} by breadth-first search from each node."""
    out = {}
    for a in {x for x, _ in pairs}:
        near, depth = {a}, 0
        while near:
            depth += 1
            near = {y for x, y in pairs if x in near} - {b for c, b in out if c == a}
            out |= {(a, b): depth for b in near}
    return out


def test_diamond_has_three_descendants(spark):
    got = rows(walks.closure(graph(spark, [("0", "1"), ("0", "2"), ("1", "3"), ("2", "3"), ("2", "3"), (None, "9"), ("9", None)])))
    assert got == [("0", "1", 1), ("0", "2", 1), ("0", "3", 2), ("1", "3", 1), ("2", "3", 1)]


def test_a_ladder_of_25_layers_ends(spark):
    pairs = [(f"{n:02d}{a}", f"{n + 1:02d}{b}") for n in range(25) for a in "ab" for b in "ab"]
    got = walks.closure(graph(spark, pairs)).collect()
    assert len(got) == 4 * 25 * 26 // 2 and max(r.depth for r in got) == 25
    top = walks.layers(graph(spark, pairs).selectExpr("src AS id"), graph(spark, pairs)).collect()
    assert {r.id: r.layer for r in top} == {f"{n:02d}{a}": n for n in range(26) for a in "ab"}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    names = "abcdefghijkl"
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(9 + 4 * seed)]
    want = reach(pairs)
    assert {(r.a, r.b): r.depth for r in walks.closure(graph(spark, pairs)).collect()} == want
    groups = {min(b for b in names if b == a or (a, b) in want and (b, a) in want) for a in names if (a, a) in want}
    got = {}
    for r in walks.cycles(graph(spark, pairs)).collect():
        got.setdefault(r.cycle, []).append((r.step, r.node))
    assert set(got) == groups
    for a, ring in got.items():
        nodes = [n for _, n in sorted(ring)]
        assert nodes[0] == a and len(nodes) == want[a, a] and all(p in pairs for p in zip(nodes, nodes[1:] + nodes[:1]))


def test_layers_refuse_cycles_and_show_one(spark):
    with pytest.raises(ValueError, match="cycle: a -> b -> c -> a"):
        walks.layers(graph(spark, [("z", "a")]).selectExpr("src AS id"), graph(spark, [("z", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]))
    assert rows(walks.layers(graph(spark, [("z", "a")]).selectExpr("src AS id"), graph(spark, [("z", "a"), ("z", "b"), ("b", "a")]))) == [("a", 2), ("b", 1), ("z", 0)]
    assert rows(walks.layers(graph(spark, []).selectExpr("src AS id"), graph(spark, []))) == []


def plain_walk(files, includes, root):
    out, seen = [], set()

    def visit(f, parent, depth):
        state = "missing" if f not in files else "repeat" if f in seen else "read"
        out.append((f, parent, depth, state))
        if state == "read":
            seen.add(f)
            for _, t in sorted(includes.get(f, [])):
                visit(t, f, depth + 1)

    visit(root, None, 0)
    return [(root, n, *x) for n, x in enumerate(out)]


@pytest.mark.parametrize("seed", range(3))
def test_walks_read_like_a_plain_walk(spark, seed):
    rnd = random.Random(seed)
    files = {f"f{i:02d}" for i in range(12)}
    includes = {f"f{i:02d}": [(n, f"f{rnd.randint(i + 1, 14):02d}") for n in range(rnd.randint(0, 4))] for i in range(12)}
    f = spark.createDataFrame([(x,) for x in files], "file string")
    e = spark.createDataFrame([(a, n, t) for a, x in includes.items() for n, t in x], "file string, place int, target string").repartition(3)
    start = spark.createDataFrame([("f00",), ("f03",), ("gone",)], "root string")
    assert rows(walks.include_walk(f, e, start)) == sorted(plain_walk(files, includes, "f00") + plain_walk(files, includes, "f03"))


def test_walks_refuse_cycles_within_reach(spark):
    f = spark.createDataFrame([(x,) for x in "abcd"], "file string")
    e = spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "b"), ("d", 0, "d")], "file string, place int, target string")
    start = lambda r: spark.createDataFrame([(r,)], "root string")
    with pytest.raises(ValueError, match="includes form a cycle: b -> c -> b"):
        walks.include_walk(f, e, start("a"))
    safe = e.where("file <> 'c'")
    assert [tuple(r)[2:] for r in walks.include_walk(f, safe, start("a")).orderBy("at").collect()] == [("a", None, 0, "read"), ("b", "a", 1, "read"), ("c", "b", 2, "read")]
