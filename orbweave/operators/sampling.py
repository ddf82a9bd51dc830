"""Sampling that depends on order within a group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from orbweave.operators.places import counted, stretches

#: Rows that one task holds on average.
ROWS = 200_000


def farthest(nodes: DataFrame, n: int) -> DataFrame:
    """(house, rank, idx): farthest-point order of at most n nodes of each house.

    It starts at node 0 and takes the node farthest from all taken, the first of ties.
    Houses are bounded; tasks hold many of them and advance all by one node a step.
    """
    buckets = max(8, nodes.count() // ROWS)

    def pick(t):
        import pyarrow as pa

        house, idx = np.asarray(t["house"]), np.asarray(t["idx"])
        order = np.lexsort((idx, house))
        house, idx = house[order], idx[order]
        x = np.stack([np.asarray(t[c])[order] for c in "xyz"], 1)
        start = np.flatnonzero(np.concatenate([[True], house[1:] != house[:-1]]))
        size = np.diff(np.append(start, len(house)))
        near, now = np.full(len(house), np.inf), start
        out = []
        for rank in range(n):
            live = size > rank
            out.append((house[now[live]], np.full(live.sum(), rank), idx[now[live]]))
            gap = x - np.repeat(x[now], size, axis=0)
            near = np.minimum(near, (gap * gap).sum(1))
            now = np.lexsort((idx, -near, house))[start]
        h, r, i = (np.concatenate(c) for c in zip(*out))
        return pa.table({"house": pa.array(h, pa.int64()), "rank": pa.array(r, pa.int64()), "idx": pa.array(i, pa.int64())})

    keyed = nodes.select("house", "idx", "x", "y", "z", F.pmod(F.xxhash64("house"), F.lit(buckets)).alias("bucket"))
    return keyed.groupBy("bucket").applyInArrow(pick, "house long, rank long, idx long")


def bottom_k(rows: DataFrame, group: str, by: str, k: int) -> DataFrame:
    """The k rows of each group with the least `by` (a long, unlike within a group).

    Each task first keeps k rows of a group among those it meets; what is left is ranked by
    group. A null group is one; null `by` comes first.
    """
    names = [f"c{i}" for i in range(len(rows.columns))]
    g, h = (names[rows.columns.index(c)] for c in (group, by))
    plain = rows.toDF(*names)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)])

    def least(batches):
        import pyarrow as pa

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = np.asarray(t[h].combine_chunks().fill_null(-(2**63)))
            code = t[g].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((key, code))
            code = code[order]
            keep = np.sort(order[np.arange(len(code)) - np.searchsorted(code, code, "left") < k])
            held = t.take(pa.array(keep))
            if held.num_rows > ROWS:  # many groups: these are handed on as they are
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    rank = F.row_number().over(W.partitionBy(g).orderBy(h))
    first = plain.mapInArrow(least, schema).withColumn("rank_", rank).where(F.col("rank_") <= k).drop("rank_")
    return first.toDF(*rows.columns)


def draw_exactly(rows: DataFrame, group: str, by: str, n: int, out: str = "at") -> DataFrame:
    """Exactly n rows of each group, with their place `out`: those of the least `by`, in that
    order; a group that has fewer repeats its rows in turn."""
    few = bottom_k(rows, group, by, n)
    w = W.partitionBy(group)
    placed = few.withColumn(out, F.row_number().over(w.orderBy(by)) - 1).withColumn("have_", F.count("*").over(w))
    turns = F.sequence(F.col(out).cast("long"), F.lit(n - 1).cast("long"), F.col("have_"))
    return placed.withColumn(out, F.explode(turns)).drop("have_")


def unlike_batches(rows: DataFrame, positive: str, order: list[str], size: int, out: str = "batch") -> DataFrame:
    """`rows` with `out`, the number of a batch: at most `size` rows, no value of `positive`
    twice in a batch, and as few batches as that allows.

    Rows are numbered by `positive` and `order`; a row's batch is its number modulo the number
    of batches, which is no less than the rows of any value: the rows of a value follow each
    other, so they fall into different batches, and batches differ by a row at most. Null is
    a value.
    """
    s = stretches(rows, [], [positive, *order])
    key = f"c{rows.columns.index(positive)}"
    n = s.groupBy(key).agg(F.count("*").alias("m")).agg(F.sum("m").alias("n"), F.max("m").alias("m")).first()
    placed = counted(s, rows.columns, out)
    batches = max(1, -(-(n["n"] or 0) // size), n["m"] or 0)
    return placed.withColumn(out, F.pmod(out, F.lit(batches)))
