"""Exact similarity search in blocks of queries against blocks of the gallery."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows on one side of a block; two blocks of 64 doubles take 4 MB of a task. Where pairs
#: themselves are the result, a block of the gallery has PAIR_BLOCK: fewer ids are written in
#: fewer bits.
BLOCK, PAIR_BLOCK = 4096, 1024

#: Similarities that a task holds at once: some rows of a block of queries by a block of the
#: gallery. What is made of them takes a few times their 4 MB.
CELLS = 1 << 19


def blocked(rows: DataFrame, key: str, blocks: int, name: str) -> DataFrame:
    """`rows` with the number of their block, by hash."""
    return rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def unit_rows(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows of length 1 (zeros stay zeros)."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def strips(left, right):
    """(similarities, query rows) of a block of queries with a block of the gallery, for some of
    the queries at a time (CELLS)."""
    x, y = unit_rows(left["vec"]), unit_rows(right["vec"]).T
    step = max(1, CELLS // len(right))
    for a in range(0, len(left), step):
        sim = x[a : a + step] @ y
        for part, by in ((np.multiply, 1e9), (np.add, 0.5)):
            part(sim, by, out=sim)
        yield np.divide(np.floor(sim, out=sim), 1e9, out=sim), left.slice(a, step)


def meet(queries: DataFrame, gallery: DataFrame, f, schema: str) -> DataFrame:
    """f(similarities, query block, gallery block) of each pair of blocks, as `schema`; a block
    has about BLOCK rows.

    Both sides have a column vec; similarities are inner products of unit vectors, rounded to
    9 decimals. Each block of queries meets each block of the gallery in a task of its own, which
    gives f some of the queries at a time; nothing is broadcast or collected.
    """
    nq, ng = queries.count(), gallery.count()
    bq, bg = max(1, -(-nq // BLOCK)), max(1, -(-ng // BLOCK))
    # Names of their own: both sides may come from one table.
    queries, gallery = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (queries, gallery))
    q = blocked(queries, queries.columns[0], bq, "qb").withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(bg - 1))))
    g = blocked(gallery, gallery.columns[0], bg, "gb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))

    def pair(left, right):
        import pyarrow as pa

        if not len(left) or not len(right):
            return pa.table(f(np.zeros((len(left), len(right))), left, right))
        return pa.concat_tables([pa.table(f(sim, part, right)) for sim, part in strips(left, right)])

    return q.groupBy("qb", "gb").cogroup(g.groupBy("qb", "gb")).applyInArrow(pair, schema)


def packed(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Blocks of about `block` rows: a partition with one row (`name`: the block's) for each."""
    blocks = max(1, -(-rows.count() // block))
    dealt = blocked(rows, rows.columns[0], blocks, "block").repartitionById(blocks, "block")
    return dealt.groupBy("block").agg(F.collect_list(F.struct(*rows.columns)).alias(name)).select(name)


def meet_pairs(queries: DataFrame, gallery: DataFrame, f, schema: str) -> DataFrame:
    """As meet(), for an f that gives pairs: each side is dealt and written once, a task reads
    its two blocks from that, and what f gives of some queries is handed on before the next.
    """

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                left, right = (pa.Table.from_struct_array(batch[c].slice(i, 1).flatten()) for c in ("left", "right"))
                for sim, part in strips(left, right):
                    yield pa.record_batch(f(sim, part, right))

    # By this hint neither side is broadcast, and each pair of partitions is a task.
    both = packed(queries, BLOCK, "left").hint("shuffle_replicate_nl").crossJoin(packed(gallery, PAIR_BLOCK, "right"))
    return both.mapInArrow(pairs, schema)


def best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, ties by id; -inf never counts."""
    if not sim.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(k, sim.shape[1])
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    a, b = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
    order = np.lexsort((ids[b], -sim[a, b], a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, a, "left")
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep]


def scores(queries: DataFrame, gallery: DataFrame, k: int | None = None, least: float | None = None, decimals: int = 9) -> DataFrame:
    """(query_id, id, label, sim) of pairs of different rows: all whose similarity is `least` or
    more; or, with k, also rank, of the k best for each query (ties by id): each task keeps k
    and a window merges them. Without either all pairs are the result.

    `queries`: query_id, vec; `gallery`: id, label, vec. Without k the gallery may lack a label,
    as then the pairs do, and sim is rounded once more to `decimals`: a column or a later step
    costs something for each pair.
    """

    def f(sim, left, right):
        import pyarrow as pa

        own, ids = np.asarray(left["query_id"]), np.asarray(right["id"])
        sim[own[:, None] == ids[None]] = -np.inf
        if least is not None:
            sim[sim < least] = -np.inf
        a, b = best(sim, ids, k)
        return {"query_id": pa.array(own[a]), "id": pa.array(ids[b]), "label": pa.array(np.asarray(right["label"])[b].astype(np.int32)), "sim": pa.array(sim[a, b])}

    def pairs(sim, left, right):
        own, ids = np.asarray(left["query_id"]), np.asarray(right["id"])
        keep = own[:, None] != ids[None]
        if least is not None:
            keep &= sim >= least
        if decimals < 9:
            sim = np.floor(sim * 10.0**decimals + 0.5) / 10.0**decimals
        out = {"query_id": np.repeat(own, len(ids)), "id": np.tile(ids, len(own)), "sim": sim.ravel()}
        if labelled:
            out["label"] = np.tile(np.asarray(right["label"]).astype(np.int32), len(own))
        return {c: out[c] if keep.all() else out[c][keep.ravel()] for c in names}

    labelled = "label" in gallery.columns
    types = {"query_id": "long", "id": "long", "label": "int", "sim": "double"}
    names = [c for c in types if c != "label" or labelled]
    schema = ", ".join(f"{c} {types[c]}" for c in names)
    if k is None:
        return meet_pairs(queries.select("query_id", "vec"), gallery.select(*[c for c in names if c in gallery.columns], "vec"), pairs, schema)
    met = meet(queries.select("query_id", "vec"), gallery.select("id", "label", "vec"), f, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def target_ranks(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(query_id, target_rank): one more than the rows that beat the best of the query's own
    label, so ties don't hurt. Queries without such a row give none. Blocks give a maximum
    and then a count for each query, never their pairs.

    `queries`: query_id, query_label, vec; `gallery`: id, label, vec.
    """

    def top(sim, left, right):
        import pyarrow as pa

        own, ids = np.asarray(left["query_id"]), np.asarray(right["id"])
        sim[(own[:, None] == ids[None]) | (np.asarray(left["query_label"])[:, None] != np.asarray(right["label"])[None])] = -np.inf
        m = sim.max(1, initial=-np.inf)
        return {"query_id": pa.array(own[m > -np.inf]), "best": pa.array(m[m > -np.inf])}

    def beaten(sim, left, right):
        import pyarrow as pa

        own, ids = np.asarray(left["query_id"]), np.asarray(right["id"])
        sim[own[:, None] == ids[None]] = -np.inf
        return {"query_id": pa.array(own), "n": pa.array((sim > np.asarray(left["best"])[:, None]).sum(1))}

    g = gallery.select("id", "label", "vec")
    b = meet(queries.select("query_id", "query_label", "vec"), g, top, "query_id long, best double").groupBy("query_id").agg(F.max("best").alias("best"))
    n = meet(queries.join(b, "query_id").select("query_id", "best", "vec"), g.select("id", "vec"), beaten, "query_id long, n long")
    return n.groupBy("query_id").agg((F.sum("n") + 1).alias("target_rank"))


def self_found(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(query_id, found): whether the gallery's row of the query's id is among the query's best
    matches, ties included. Of an index whose ids were mixed up it is not; an absent id isn't
    found either.
    """

    def f(sim, left, right):
        import pyarrow as pa

        own = np.asarray(left["query_id"])
        mine = np.where(own[:, None] == np.asarray(right["id"])[None], sim, -np.inf)
        return {"query_id": pa.array(own), "most": pa.array(sim.max(1, initial=-np.inf)), "mine": pa.array(mine.max(1, initial=-np.inf))}

    met = meet(queries.select("query_id", "vec"), gallery.select("id", "vec"), f, "query_id long, most double, mine double")
    found = (F.max("mine") == F.max("most")) & (F.max("mine") > float("-inf"))
    return met.groupBy("query_id").agg(found.alias("found"))


def batch_losses(rows: DataFrame, tau: float) -> DataFrame:
    """(batch, n, forward, backward, right_ones) of contrastive batches: the mean loss of q
    against all g of its batch, of g against all q, and the rows whose own g is a best match.

    `rows`: batch, i, q, g; a batch is as large as a training step holds. tau is positive.
    Buckets of whole batches go to tasks; each batch is one matrix product.
    """
    if not tau > 0:
        raise ValueError(f"tau is {tau}; it must be positive")
    buckets = max(1, -(-rows.count() // (16 * BLOCK)))

    def run(t):
        import pyarrow as pa

        batch = np.asarray(t["batch"])
        order = np.argsort(batch, kind="stable")
        q, g, batch = unit_rows(t["q"])[order], unit_rows(t["g"])[order], batch[order]
        start = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))
        out = []
        for a, b in zip(start.tolist(), np.append(start[1:], len(batch)).tolist()):
            s = q[a:b] @ g[a:b].T
            own, loss = np.diag(s), []
            for axis in (1, 0):
                m = s.max(axis, keepdims=True)
                loss.append((np.log(np.exp((s - m) / tau).sum(axis)) + (m.ravel() - own) / tau).mean())
            out.append((int(batch[a]), b - a, *loss, int((own >= s.max(1) - 1e-12).sum())))
        return pa.table({c: pa.array([o[i] for o in out], k) for i, (c, k) in enumerate((("batch", pa.int64()), ("n", pa.int64()), ("forward", pa.float64()), ("backward", pa.float64()), ("right_ones", pa.int64())))})

    keyed = rows.select("batch", "q", "g", F.pmod(F.xxhash64("batch"), F.lit(buckets)).alias("bucket"))
    return keyed.groupBy("bucket").applyInArrow(run, "batch long, n long, forward double, backward double, right_ones long")
