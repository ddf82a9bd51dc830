"""Scene graphs: neighbours, messages along a chain, and pooling.

A house has as many nodes as a scene holds; whole houses meet in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.operators.search import best

#: Distances that one step of knn holds at once.
PAIRS = 4_000_000


def near_pairs(size: np.ndarray, idx: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """(house, i, j), i < j, of houses that lie one after another, `size` nodes each, by their
    place: each node with its k nearest, symmetrised. All houses of one size go at once, and
    a large house some rows of its distances at a time."""
    start = np.cumsum(size) - size
    out = [np.zeros((0, 3), np.int64)]
    for n in np.unique(size[size > 1]).tolist():
        those = np.flatnonzero(size == n)
        most = max(1, PAIRS // (n * n))
        for a in range(0, len(those), most):
            some = those[a : a + most]
            at = start[some][:, None] + np.arange(n)
            at = np.take_along_axis(at, np.argsort(idx[at], 1), 1)
            for r in range(0, n, max(1, PAIRS // n) if n * n > PAIRS else n):
                rows = np.arange(r, min(n, r + PAIRS // n) if n * n > PAIRS else n)
                d = x[at[:, rows]][:, :, None] - x[at][:, None]
                d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
                d2[:, np.arange(len(rows)), rows] = np.inf
                i, j = best(-d2.reshape(-1, n), np.arange(n), min(k, n - 1))
                h, i = i // len(rows), rows[i % len(rows)]
                i, j = idx[at[h, i]], idx[at[h, j]]
                out.append(np.stack([some[h], np.minimum(i, j), np.maximum(i, j)], 1))
    edges = np.concatenate(out)
    edges = edges[np.lexsort(edges.T[::-1])]
    return edges[np.concatenate([[True], (edges[1:] != edges[:-1]).any(1)])[: len(edges)]]


def scene_edges(nodes: DataFrame, k: int, parent: str | None = None) -> DataFrame:
    """(house, i, j, support), i < j: each node with its k nearest of the same house,
    symmetrised; and, with `parent` (a column: the idx of the node that holds this one, or
    null), an edge of support from each node to its parent, which is then no neighbour's.

    Ties go to the smaller index. A house becomes one row first, which needs no shuffle
    where `nodes` is already dealt by house; tasks then take all houses of one size at once,
    and a large house some rows of its distances at a time. A parent that is no node of the
    house, or the node itself, gives no edge.
    """
    columns = ["idx", "x", "y", "z", *([parent] if parent else [])]
    held = [F.collect_list(F.coalesce(F.col(c), F.lit(-1)) if c == parent else F.col(c)).alias(f"l{n}") for n, c in enumerate(columns)]
    whole = nodes.groupBy("house").agg(*held)

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [batch.column(c) for c in range(1, 1 + len(columns))]
            size = np.asarray(lists[0].value_lengths())
            idx, x = np.asarray(lists[0].flatten()), np.stack([np.asarray(v.flatten()) for v in lists[1:4]], 1)
            edges, held_by = near_pairs(size, idx, x, k), np.zeros((0, 3), np.int64)
            if parent:
                up, place = np.asarray(lists[4].flatten()), np.repeat(np.arange(len(size)), size)
                known = pairs_of(place, idx)
                ok = np.isin(pairs_of(place, up), known) & (up != idx)
                held_by = np.unique(np.stack([place, np.minimum(idx, up), np.maximum(idx, up)], 1)[ok], axis=0)
                code = lambda e: pairs_of(pairs_of(e[:, 0], e[:, 1]), e[:, 2])
                edges = edges[~np.isin(code(edges), code(held_by))]
            found = np.concatenate([edges, held_by])
            house = batch.column(0).take(pa.array(found[:, 0]))
            support = np.arange(len(found)) >= len(edges)
            yield pa.RecordBatch.from_arrays([house, pa.array(found[:, 1].copy()), pa.array(found[:, 2].copy()), pa.array(support)], names=["house", "i", "j", "support"])

    return whole.mapInArrow(near, f"house {nodes.schema['house'].dataType.simpleString()}, i long, j long, support boolean")


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One complex or structured value for each pair, that compares like the pair."""
    out = np.empty(len(a), [("a", a.dtype), ("b", b.dtype)])
    out["a"], out["b"] = a, b
    return out


def knn(nodes: DataFrame, k: int) -> DataFrame:
    """(house, i, j), i < j: each node with its k nearest of the same house, symmetrised."""
    return scene_edges(nodes, k).drop("support")


def both_ways(edges: DataFrame) -> DataFrame:
    """(house, i, j) of undirected edges, once from either end."""
    ends = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return edges.select("house", F.explode(ends).alias("e")).select("house", "e.i", "e.j")


def without(edges: DataFrame, target: int) -> DataFrame:
    """`edges` of the graph without one node: those at it go, later nodes move up by one."""
    moved = [(F.col(c) - (F.col(c) > target).cast("long")).alias(c) for c in ("i", "j")]
    return edges.where((F.col("i") != target) & (F.col("j") != target)).select("house", *moved)


def with_neighbours(nodes: DataFrame, h: str = "h") -> DataFrame:
    """`nodes` with near: their neighbours by index, as structs of j, hj, dx, dy, dz, d2.

    Windows by house deal nodes as their numbering did, so nothing shuffles again.
    """
    w = W.partitionBy("house").orderBy("idx")

    def end(step) -> Column:
        d = {c: F.col(c) - step(c).over(w) for c in "xyz"}
        parts = [step("idx").over(w).alias("j"), step(h).over(w).alias("hj"), *[v.alias(f"d{c}") for c, v in d.items()]]
        d2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
        return F.when(step("idx").over(w).isNotNull(), F.struct(*parts, d2.alias("d2")))

    return nodes.withColumn("near", F.array_compact(F.array(end(F.lag), end(F.lead))))


def summed(near: str | Column, value) -> Column:
    """The sum of value(neighbour); 0 of none."""
    return F.aggregate(near, F.lit(0.0), lambda a, m: a + value(m))


def message_layer(nodes: DataFrame, phi_e, phi_x, phi_h) -> DataFrame:
    """One equivariant layer along the chain with scalar features: m = phi_e(hi, hj, d2),
    x += sum (xi - xj) phi_x(m), h += sum phi_h(m). Nodes without neighbours stay as they are.
    """
    n = with_neighbours(nodes)

    def m(e: Column) -> Column:
        return phi_e(F.col("h"), e["hj"], e["d2"])

    new = [(F.col(c) + summed("near", lambda e, c=c: e[f"d{c}"] * phi_x(m(e)))).alias(c) for c in "xyz"]
    return n.select("house", "idx", "asset", *new, (F.col("h") + summed("near", lambda e: phi_h(m(e)))).alias("h"))
