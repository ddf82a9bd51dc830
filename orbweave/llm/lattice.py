"""Embedding near-duplicates by lattice hashing on E8 points, with cosine verification."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import U64, components, cut, mix, table

#: Tables, blocks of eight projected dimensions in each, lattice points that a block probes,
#: and the lattice's scale. They hold for any number and width of vectors, so recall depends
#: on neither; a table has some 300 ** BLOCKS cells that are in use.
TABLES, BLOCKS, PROBES, SCALE, SEED = 4, 3, 2, 2.0, 5
#: Vectors on one side of a block of comparisons.
BLOCK = 1024
#: Rows of blocks that one task group holds on average.
GROUP_ROWS = 4096


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors: two entries of +-1, or all +-1/2 with an even count of -."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if the sum is odd, round the
    worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) % 2)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def e8_decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the closer of the nearest in D8 and in D8 + 1/2."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


def lattice_keys(unit: np.ndarray, blocks: int, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """(vectors, tables * probes**blocks) keys: the lattice cell of each vector's projection
    in each table, and the neighbouring cells nearest to it.

    Projected coordinates of unit vectors have a deviation of 1, whatever the width.
    """
    rng, roots, n, d = np.random.default_rng(seed), e8_roots(), *unit.shape
    weight = rng.integers(1, 2**63, (tables, blocks, 8), dtype=np.int64) | 1
    out = []
    for t in range(tables):
        proj = rng.standard_normal((d, 8 * blocks))
        y, per_block = unit @ proj / scale, []
        for b in range(blocks):
            x = y[:, 8 * b : 8 * b + 8]
            c = e8_decode(x)
            best = np.argsort(-((x - c) @ roots.T), 1, kind="stable")[:, : probes - 1]
            cells = np.concatenate([c[:, None], c[:, None] + roots[best]], 1)
            per_block.append(((2 * cells).astype(np.int64) * weight[t, b]).sum(2).view(U64))
        for combo in itertools.product(range(probes), repeat=blocks):
            h = np.full(n, t + 1, U64)
            for b, p in enumerate(combo):
                h = mix(h + per_block[b][:, p])
            out.append(h)
    return np.stack(out, 1)


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def smaller_cells(lists, key: int, left: np.ndarray, right: np.ndarray):
    """For each cell below `key` that both sides are in, the places in `left` and in `right`."""
    flat, size = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
    row = np.repeat(np.arange(len(size)), size)
    row, flat = row[flat < key], flat[flat < key]
    sides = []
    for side in (left, right):
        place = np.full(len(size), -1)
        place[side] = np.arange(len(side))
        mine = place[row] >= 0
        k, at = flat[mine], place[row][mine]
        order = np.argsort(k, kind="stable")
        sides.append((k[order], at[order]))
    (k1, p1), (k2, p2) = sides
    for k in np.intersect1d(k1, k2):
        yield p1[np.searchsorted(k1, k) : np.searchsorted(k1, k, "right")], p2[np.searchsorted(k2, k) : np.searchsorted(k2, k, "right")]


def spanning(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what `hit` joins: each member of a component with the first one."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_ = hit.any(1)
    both = left[0] == right[0] if len(left) and len(right) else False  # one side with itself
    while open_.any():
        seed = int(open_.argmax())
        rows, cols = np.zeros(len(left), bool), np.zeros(len(right), bool)
        new_rows = np.zeros(len(left), bool)
        new_rows[seed] = True
        while new_rows.any():
            rows |= new_rows
            new_cols = hit[new_rows].any(0) & ~cols
            if both:
                new_cols |= new_rows & ~cols
            cols |= new_cols
            new_rows = hit[:, new_cols].any(1) & ~rows
            if both:
                new_rows |= new_cols & ~rows
        found = np.union1d(left[rows], right[cols])
        found = found[found != left[seed]]
        a.append(np.full(len(found), left[seed]))
        b.append(found)
        open_ &= ~rows
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of `vectors`.

    Rows link if their labels are equal and not null, their widths are equal, and their
    cosine in double precision is `threshold` or more; of such pairs those count that share
    a lattice cell in any table. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing. Equal vectors of a label are one class from
    the start, so copies are never compared; n_links counts them all. A cell's classes are
    compared in blocks of 1,024 by 1,024, each its own group, and a pair counts in the
    smallest cell that both have. Whole classes and cells are kept: nothing is capped.
    """
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.coalesce(ok, F.lit(False)))
    # The width is part of the key; adding 0.0 turns -0.0 into 0.0.
    flat = F.transform("vec", lambda x: x + 0.0)
    good = rows.where("ok").select("vec_id", "label", flat.alias("vec")).select("vec_id", F.struct("label", F.size("vec").alias("width"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.reverse("vec")).alias("h2")).alias("same"), "vec")
    classes = good.groupBy("same").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            width = np.array([len(v) for v in batch.column(1)])
            for w in np.unique(width):
                take = np.flatnonzero(width == w)
                part = batch.take(pa.array(take))
                x = _matrix(part.column(1))
                x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                k = lattice_keys(x, BLOCKS, tables, probes, SCALE, SEED).view(np.int64)
                kinds = pa.array([list(r) for r in k], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), kinds], names=["cls", "group", "keys"])

    group = F.xxhash64("same.label", "same.width")
    keyed = classes.select("cls", "vec", group.alias("group")).mapInArrow(keys, "cls long, group long, keys array<long>")
    keyed = cut(keyed.select("cls", F.array_sort(F.array_distinct(F.transform("keys", lambda k: F.xxhash64(k, F.col("group"))))).alias("keys")))
    cells = keyed.select("cls", F.explode("keys").alias("key"))
    shared = cut(cells.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")))
    member = cells.join(shared, "key").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    member = member.select("cls", "key", "mine", F.explode(pair).alias("ij")).select("cls", "key", "mine", "ij.i", "ij.j")
    full = classes.select("cls", "vec", "copies").join(keyed, "cls")
    # Only classes that share a cell travel with their vectors.
    member = member.join(full, "cls")

    def cell(x, norm, cls, copies, mine, lists, key: int, i: int, j: int):
        """(classes with links here, their numbers, classes that a tree joins) of one block."""
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        hit = (x[left] @ x[right].T) / norm[left][:, None] / norm[right][None] >= threshold
        if i == j:
            hit = np.triu(hit, 1)
        if not hit.any():
            return
        first = hit.copy()  # pairs that share no smaller cell, which count here
        for p, q in smaller_cells(lists, key, left, right):
            first[np.ix_(p, q)] = False
        links = np.zeros(len(cls), np.int64)
        links[left] += first @ copies[right]
        links[right] += copies[left] @ first
        ta, tb = spanning(hit, left, right)
        some = np.flatnonzero(links)
        yield cls[some], links[some], cls[ta], cls[tb]

    def compare(t):
        import pyarrow as pa

        t = t.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        key, i, j, cls, copies, mine = (np.asarray(t[c]) for c in ("key", "i", "j", "cls", "copies", "mine"))
        new = np.flatnonzero((np.diff(key, prepend=0) != 0) | (np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0) | (np.arange(len(key)) == 0))
        lists, vectors, found = t["keys"].combine_chunks(), t["vec"].combine_chunks(), []
        for a, b in zip(new.tolist(), np.append(new[1:], len(key)).tolist()):
            x = _matrix(vectors[a:b])
            x = x / np.abs(x).max(1, keepdims=True)
            norm = np.sqrt((x * x).sum(1))
            found += cell(x, norm, cls[a:b], copies[a:b], mine[a:b], lists[a:b], int(key[a]), int(i[a]), int(j[a]))
        some, links, ta, tb = (np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in range(4))
        end, none = pa.array(tb), pa.nulls(len(some), pa.int64())
        return pa.table({"a": np.concatenate([some, ta]), "b": pa.concat_arrays([none, end]), "n": pa.concat_arrays([pa.array(links), pa.nulls(len(ta), pa.int64())])})

    # A group holds whole blocks, small ones by the hundred.
    total = shared.agg(F.sum(F.col("m") * F.col("nb")).alias("t")).first()["t"] or 0
    group = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-total // GROUP_ROWS))))
    found = cut(member.groupBy(group.alias("cell")).applyInArrow(compare, "a long, b long, n long"))
    links = found.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    comp = components(found.where("b is not null").select("a", "b"))
    done = classes.select("cls", "same", "least", "copies").join(links, "cls", "left").join(comp, F.col("cls") == F.col("node"), "left")
    done = done.withColumn("component", F.coalesce("component", "cls"))
    least = done.groupBy("component").agg(F.min("least").alias("component_id"))
    done = done.join(least, "component").select("same", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked = good.join(done, "same").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)
