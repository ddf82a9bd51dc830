"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is by document frequency (in steps of a quarter octave), then
hash; it is written as one 64-bit key. Frequencies are counted exactly, over the classes of
equal sets. A pair arises where the rare heads (prefixes) of two sets meet. Pivots cut the
global order into fragments: each fragment counts the partial overlap of a pair by itself,
and the sum over a pair's fragments decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import LOWER, U64, components, cut, gram_hashes, hashed_words, mix, table, text_blocks

#: N-grams that one task of the frequency count holds on average.
FRAGMENT_GRAMS = 2_000_000
#: Up to so many sets that share a prefix n-gram are paired directly.
LIGHT = 64
#: Sets of one common n-gram that meet in one block on either side.
BLOCK = 1024
#: Rows of such blocks that one task holds on average.
MEETING_ROWS = 100_000
#: Sets that a task cuts into segments at once.
SEGMENT_SETS = 512
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 8
#: 64-bit words of a set's parity bitmap.
MAP = 8
MAPS = [f"b{i}" for i in range(MAP)]


def distinct_pairs(r: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), by row and then hash."""
    order = None
    if len(r) and int(r.max()) < 1 << 16:  # one sort of row and high bits; the rest only if these tie
        x = (r.astype(U64) << U64(48)) | (g >> U64(16))
        order = np.argsort(x)
        x, y = x[order], g[order]
        if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((g, r))
    r, g = r[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return r[new], g[new]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int):
    """(row, hash) of the distinct k-word shingles of each row, in order.

    Words are split at blanks and lower-cased A-Z. A row of fewer words has its whole
    sequence as one shingle; a row without words has none.
    """
    n = len(off) - 1
    _, _, row, h = hashed_words(data, off, fold=LOWER)
    g, ok = gram_hashes(h, row, k)
    r, g = row[: len(g)][ok], g[ok]
    words = np.bincount(row, minlength=n)
    begin = np.searchsorted(row, np.arange(n), "left")
    short = np.flatnonzero((words > 0) & (words < k))
    whole = []
    for i in short.tolist():
        s = int(words[i])
        for x in h[begin[i] : begin[i] + words[i]].tolist():
            s = (s * 0xD6E8FEB86659FD93 + x) % 2**64
        whole.append(s)
    return distinct_pairs(np.concatenate([r, short]), np.concatenate([g, mix(np.array(whole, U64))]))


def set_ids(r: np.ndarray, g: np.ndarray, n: int):
    """(number of shingles, 64-bit id of the set) of each row; equal sets share the id."""
    size = np.bincount(r, minlength=n)
    run = np.concatenate([np.zeros(1, U64), np.cumsum(mix(g ^ U64(0x5851F42D4C957F2D)))])
    end = np.cumsum(size)
    return size, mix((run[end] - run[end - size]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def profiles(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, cls): set size and set id of each row."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, cls long"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, off in text_blocks(batch.column(1)):
                size, cls = set_ids(*shingle_sets(data, off, k), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(cls.view(np.int64))], names=["doc_id", "n", "cls"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_")).mapInArrow(run, schema)


# --- frequencies and the global order ---------------------------------------------------------


def _unpack(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _low(g: np.ndarray) -> bytes:
    """The low six bytes of each hash."""
    return g.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_low(column) -> np.ndarray:
    out = np.zeros((sum(map(len, column.to_pylist())) // 6, 8), np.uint8)
    out[:, :6] = _unpack(column, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _rows(key: str, spans: list, parts: dict):
    """Packed rows: for each (value, slices) of `spans`, the value and each part's bytes."""
    import pyarrow as pa

    cols = [pa.array([v for v, _ in spans], pa.int64())]
    for i, (name, x) in enumerate(parts.items()):
        pack = _low if name == "grams" else np.ndarray.tobytes
        cols.append(pa.array([pack(x[at[i]]) for _, at in spans], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=[key, *parts])


def postings(docs: DataFrame, k: int, bits: int, text_col: str) -> DataFrame:
    """Sets cut into 2**bits hash ranges: for each block of texts and range, the n-grams (six
    bytes each, the range has the leading bits), and id and number of n-grams of each set."""
    width, low = min(56, 48 + bits), min(48, 56 - bits)

    def run(batches):
        for batch in batches:
            for i, j, data, off in text_blocks(batch.column(0)):
                r, g = shingle_sets(data, off, k)
                _, cls = set_ids(r, g, j - i)
                once = np.zeros(j - i, bool)
                once[np.unique(cls, return_index=True)[1]] = True
                r, g = r[once[r]], g[once[r]] >> U64(64 - width)
                frag = (g >> U64(low)).astype(np.int32)
                order = np.argsort(frag, kind="stable")
                r, g, frag = r[order], g[order] & U64((1 << low) - 1), frag[order]
                piece = np.flatnonzero((np.diff(frag, prepend=-1) != 0) | (np.diff(r, prepend=-1) != 0))
                sets, count = cls[r[piece]], np.diff(np.append(piece, len(g))).astype(np.uint32)
                edge = np.flatnonzero(np.diff(frag[piece], prepend=-1, append=-1))
                at = np.append(piece, len(g))
                spans = [(int(frag[piece[a]]), (slice(at[a], at[b]), slice(a, b), slice(a, b))) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield _rows("frag", spans, {"grams": g, "cls": sets, "count": count})

    return docs.select(F.col(text_col).alias("text_")).mapInArrow(run, "frag long, grams binary, cls binary, count binary")


def ordered_sets(parts: DataFrame, classes: DataFrame, num: int, den: int, bits: int) -> DataFrame:
    """(cls, n, own, rare, head, keys, b0..): the sets whose prefix others may share.

    `own` n-grams are in no other set and come first in the global order; `keys` are the
    others, as keys of that order; `head` of them belong to the prefix. A set of n may leave
    out n - ceil(t n) n-grams, so of any partner it shares one of its first
    n - ceil(t n) + 1. `rare` n-grams are in at most LIGHT sets. b0.. is a parity bitmap of
    `keys`.
    """
    low, common = min(48, 56 - bits), int(4 * np.log2(LIGHT))

    def shared(t):
        import pyarrow as pa

        frag, g, count = t["frag"][0].as_py(), _from_low(t["grams"]), _unpack(t["count"], np.uint32)
        cls, first, rank = np.unique(_unpack(t["cls"], U64), return_index=True, return_inverse=True)
        once = np.zeros(len(rank), bool)
        once[first] = True  # equal sets of other blocks count once
        keep = np.repeat(once, count)
        g, at = g[keep], np.repeat(rank[once].astype(np.int32), count[once])
        order = np.argsort(g)
        s = g[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
        df = np.diff(np.append(start, len(s)))
        many = np.repeat(df > 1, df)
        step = np.repeat(np.minimum(127, 4 * np.log2(np.maximum(df, 1))).astype(U64), df)[many]
        key = (step << U64(56)) | U64(frag << low) | s[many]
        at = at[order[many]]
        order = np.argsort(at, kind="stable")
        key, at = key[order], at[order]
        piece = np.flatnonzero(np.diff(at, prepend=-1))
        sets, count = cls[at[piece]], np.diff(np.append(piece, len(at))).astype(np.uint32)
        to = (sets >> U64(64 - bits)).astype(np.int64)
        edge, ends = np.flatnonzero(np.diff(to, prepend=-1, append=-1)), np.append(piece, len(at))
        spans = [(int(to[a]), (slice(ends[a], ends[b]), slice(a, b), slice(a, b))) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        return pa.Table.from_batches([_rows("part", spans, {"keys": key, "cls": sets, "count": count})])

    def heads(t, sizes):
        import pyarrow as pa

        key, cls = _unpack(t["keys"], U64), np.repeat(_unpack(t["cls"], U64), _unpack(t["count"], np.uint32))
        order = np.lexsort((key, cls))
        key, cls = key[order], cls[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(cls)), bool), cls[1:] != cls[:-1]]))
        count, sets = np.diff(np.append(start, len(cls))), cls[start]
        ids, n = sizes["cls"].to_numpy().view(U64), sizes["n"].to_numpy()
        order = np.argsort(ids)
        n = n[order[np.searchsorted(ids, sets, sorter=order)]] if len(ids) else np.zeros(0, np.int64)
        own = n - count
        head = np.minimum(count, n - (-(-num * n // den)) + 1 - own)
        live = head > 0
        key, cls = key[np.repeat(live, count)], None
        n, own, head, count, sets = n[live], own[live], head[live], count[live], sets[live]
        row = np.repeat(np.arange(len(n)), count)
        rare = own + np.bincount(row, weights=(key >> U64(56)) <= U64(common), minlength=len(n)).astype(np.int64)
        maps, at = np.zeros((len(n), MAP), np.int64), np.concatenate([[0], np.cumsum(count)])
        for a in range(0, len(n), 4096):
            b = min(len(n), a + 4096)
            bit = (row[at[a] : at[b]] - a) * (64 * MAP) + (key[at[a] : at[b]] & U64(64 * MAP - 1)).astype(np.int64)
            odd = np.bincount(bit, minlength=(b - a) * 64 * MAP).reshape(b - a, -1) & 1
            maps[a:b] = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(key.view(np.int64))).cast(pa.list_(pa.int64()))
        cols = {"cls": pa.array(sets.view(np.int64)), "n": pa.array(n), "own": pa.array(own), "rare": pa.array(rare), "head": pa.array(head), "keys": lists}
        return pa.table(cols | {c: pa.array(maps[:, i].copy()) for i, c in enumerate(MAPS)})

    by_set = parts.groupBy("frag").applyInArrow(shared, "part long, keys binary, cls binary, count binary")
    sizes = classes.select(F.shiftrightunsigned("cls", 64 - bits).alias("part"), "cls", "n")
    schema = "cls long, n long, own long, rare long, head long, keys array<long>, " + ", ".join(f"{c} long" for c in MAPS)
    return by_set.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(heads, schema)


# --- pairs and their overlaps -----------------------------------------------------------------


def overlaps(sets: DataFrame, pairs: DataFrame, pivots: list[int], num: int, den: int) -> DataFrame:
    """(a, b) of `pairs` that link: partial overlaps by fragment, summed for each pair.

    A set in many pairs should be their `a`: its segments join the bare pairs, and the rows
    then spread over the `b`.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    most = pairs.count()
    cuts = np.array(sorted(set(pivots)), np.int64)

    def segments(batches):
        import pyarrow as pa

        for batch in (b.slice(i, SEGMENT_SETS) for b in batches for i in range(0, b.num_rows, SEGMENT_SETS)):
            at, keys = batch.column(2).offsets.to_numpy().astype(np.int64), batch.column(2).values.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            keys = keys[at[0] : at[-1]]
            frag = np.searchsorted(cuts, keys, "right")
            edge = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(frag, prepend=-1) != 0))
            seg = pa.LargeListArray.from_arrays(pa.array(np.append(edge, len(keys))), pa.array(keys)).cast(pa.list_(pa.int64()))
            where = pa.array(row[edge])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(frag[edge]), seg], names=["cls", "n", "frag", "seg"])

    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    seg = cut(sets.select("cls", "n", "keys").join(ends, "cls", "left_semi").mapInArrow(segments, "cls long, n long, frag long, seg array<long>"))
    left = seg.select(F.col("cls").alias("a"), F.col("n").alias("na"), "frag", F.col("seg").alias("sa"))
    right = seg.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "frag", F.col("seg").alias("sb"))
    met = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("o"), (F.col("na") + F.col("nb")).alias("both"))
    total = met.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("both").alias("both"))
    return cut(total.where(den * F.col("o") >= num * (F.col("both") - F.col("o"))).select("a", "b"), most)


def meetings(at: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of `at`, the places of sets under common n-grams with their components, that may
    link two components: those outside the main component of an n-gram meet all others under
    it, in blocks."""
    kinds = at.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"))
    main = kinds.groupBy("gram").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("o"))
    main = cut(main.where("o > 0").select("gram", "main", F.ceil(F.col("m") / BLOCK).alias("rows"), F.ceil(F.col("o") / BLOCK).alias("cols"), "m", "o"))
    total = main.agg(F.sum(F.col("m") * F.col("cols") + F.col("o") * F.col("rows")).alias("t")).first()["t"] or 0
    groups = max(1, -(-total // MEETING_ROWS))
    what = ["gram", "cls", "n", "own", "pos", "component", *MAPS]
    placed = at.join(main, "gram").withColumn("inside", F.col("component") == F.col("main"))
    x = placed.where(~F.col("inside")).select(*what, "inside", F.lit(0).alias("side"), F.pmod(F.xxhash64("cls", F.lit(1)), "cols").alias("col"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"))
    y = placed.select(*what, "inside", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("col"), F.pmod(F.xxhash64("cls", F.lit(2)), "rows").alias("row"))

    def compare(t):
        import pyarrow as pa

        v = {c: t[c].to_numpy() for c in ("gram", "cls", "n", "own", "pos", "component", "side", "col", "row")}
        inside = t["inside"].to_numpy(zero_copy_only=False)
        maps = np.stack([t[c].to_numpy() for c in MAPS], axis=1)
        order = np.lexsort((v["side"], v["row"], v["col"], v["gram"]))
        v, inside, maps = {c: x[order] for c, x in v.items()}, inside[order], maps[order]
        new = np.flatnonzero((np.diff(v["gram"], prepend=0) != 0) | (np.diff(v["col"], prepend=0) != 0) | (np.diff(v["row"], prepend=0) != 0) | (np.arange(len(order)) == 0))
        out = [np.zeros((0, 2), np.int64)]
        for a, b in zip(new.tolist(), np.append(new[1:], len(order)).tolist()):
            c = a + int(np.searchsorted(v["side"][a:b], 1))
            for d in range(a, c, BLOCK):  # blocks are only about as large as BLOCK
                i, j = np.arange(d, min(c, d + BLOCK))[:, None], np.arange(c, b)[None, :]
                both = v["n"][i] + v["n"][j]
                ok = (v["component"][i] != v["component"][j]) & (inside[j] | (v["cls"][i] < v["cls"][j]))
                ok &= ((v["pos"][i] + v["pos"][j]) * (den + num) <= (den - num) * both) & (den * np.minimum(v["n"][i], v["n"][j]) >= num * np.maximum(v["n"][i], v["n"][j]))
                p, q = np.nonzero(ok)
                p, q = p + d, q + c
                for e in range(0, len(p), 1 << 18):
                    s, u = p[e : e + (1 << 18)], q[e : e + (1 << 18)]
                    apart = np.bitwise_count(maps[s] ^ maps[u]).sum(axis=1, dtype=np.int64) + v["own"][s] + v["own"][u]
                    hit = apart * (den + num) <= (den - num) * (v["n"][s] + v["n"][u])
                    one, two = v["cls"][s[hit]], v["cls"][u[hit]]
                    out.append(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(found[:, 0].copy()), "b": pa.array(found[:, 1].copy())})

    return x.unionByName(y).groupBy(F.pmod(F.xxhash64("gram", "col", "row"), F.lit(groups)).alias("group")).applyInArrow(compare, "a long, b long")


def class_components(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of the sets that link with others.

    Sets under a prefix n-gram of at most LIGHT sets are paired directly. Under a commoner
    one, each set is paired with the most central sets of like size, those with the fewest
    rare n-grams; then all that are still outside the n-gram's main component meet all others
    there. So every pair that could still join two components is compared, and no pair inside
    one component is. A pair counts as possible if sizes, the places of its first common
    n-gram, the n-grams that one of them has alone and the parity bitmaps leave room for enough
    overlap.
    """
    place = sets.select("cls", "n", "own", "rare", *MAPS, F.posexplode(F.slice("keys", F.lit(1), F.col("head").cast("int"))).alias("i", "gram"))
    place = place.withColumn("pos", F.col("own") + F.col("i")).drop("i")
    freq = place.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    place = cut(place.join(freq, "gram"))
    light, heavy = place.where(F.col("m") <= LIGHT), place.where(F.col("m") > LIGHT)

    def room(x: str, y: str):
        apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in MAPS), F.col(f"{x}.own") + F.col(f"{y}.own"))
        a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (den * F.least(a, b) >= num * F.greatest(a, b)) & (apart * (den + num) <= (den - num) * (a + b))

    first = (F.col("x.pos") + F.col("y.pos")) * (den + num) <= (den - num) * (F.col("x.n") + F.col("y.n"))
    pairs = light.alias("x").join(light.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cls") < F.col("y.cls")) & first & room("x", "y"))
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))) if num < den else F.col("n")
    sized = heavy.withColumn("size", size)
    lead = sized.groupBy("gram", "size").agg(F.min_by(F.struct("cls", "n", "own", *MAPS), F.struct(F.col("rare") / F.col("n"), "cls")).alias("l")).select("gram", "size", "l.*")
    around = sized.withColumn("size", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)))
    star = around.alias("x").join(lead.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.cls") != F.col("y.cls")) & room("x", "y"))
    pairs = pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).union(star.select("y.cls", "x.cls"))
    shares = [i / FRAGMENTS for i in range(1, FRAGMENTS)]
    pivots = sets.select(F.explode("keys").alias("key")).agg(F.percentile_approx("key", shares, 1000).alias("p")).first()["p"] or []
    comp = components(overlaps(sets, pairs, pivots, num, den))
    at = cut(heavy.join(comp, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls")).drop("node", "rare", "m"))
    more = overlaps(sets, meetings(at, num, den), pivots, num, den)
    ends = [more.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_")), c, "left").select("a", "b", F.coalesce(f"{c}_", c).alias(f"{c}_")) for c in ("a", "b")]
    joined = components(ends[0].join(ends[1], ["a", "b"]), "a_", "b_").select(F.col("node").alias("component"), F.col("component").alias("c"))
    nodes = comp.select("node", "component").union(joined.join(comp, "component", "left_anti").select("component", "component"))
    return nodes.join(joined, "component", "left").select("node", F.coalesce("c", "component").alias("component"))


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`, whatever links it.

    Two rows link when den * |A & B| >= num * |A | B| over their distinct k-word shingles
    (see shingle_sets). component_id is the smallest id that links reach; a row with a null
    id links like any other, but gives no id if others do. A null, empty or blank text has
    no shingles and links with nothing. Rows with equal sets form one class from the start;
    a repeated id gives repeated rows. An empty table gives no rows; other columns are not
    read. See class_components for the pairs that are compared.
    """
    prof = cut(profiles(docs, k, id_col, text_col))
    classes = cut(prof.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    grams = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, grams / FRAGMENT_GRAMS)))))
    sets = cut(ordered_sets(postings(docs, k, bits, text_col), classes, num, den, bits))
    comp = class_components(sets, num, den)
    done = classes.select("cls", "rep").join(comp, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    least = done.groupBy("component").agg(F.min("rep").alias("component_id"))
    done = done.join(least, "component").select("cls", "component_id")
    out = prof.where("n > 0").join(done, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(prof.where("n = 0").select("doc_id", "n", "doc_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) c ON c.x = d.doc_id
"""
