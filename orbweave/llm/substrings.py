"""Substring deduplication: words of passages that earlier documents hold are removed."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import U64, gram_hashes, hashed_words, mix, table, text_blocks

#: Words of the grams whose smallest hash names a window, and bytes sent of that hash besides
#: the bits that choose the fragment. A window's own 64-bit hash is sent whole: windows with
#: one anchor, of which a common line has many, are told apart by it alone.
ANCHOR_WORDS, ANCHOR_BYTES = 5, 5
#: Windows that one fragment holds on average.
FRAGMENT_WINDOWS = 2_000_000
#: Rows of the sample that shows hot anchors, and the share of windows that makes one hot, so
#: there are at most 1 / HOT_SHARE of them. They only decide where windows meet.
SAMPLE_ROWS, HOT_SHARE = 5_000, 1e-4
_WORD = re.compile(r"[^ \t-\r]+")


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones: high zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(cells: list[bytes], kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(width, -1).T).view(kind)[:, 0] for c in cells]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def window_runs(h: np.ndarray, row: np.ndarray, size: int):
    """Windows of `size` words as (row, first word, anchor, own hash), rows in order.

    The anchor is the smallest hash of the window's grams, so neighbouring windows mostly
    share it and equal windows always do.
    """
    own, ok = gram_hashes(h, row, size)
    grams, _ = gram_hashes(h, row, min(ANCHOR_WORDS, size))
    m = len(own)
    anchor = grams[:m].copy()
    for i in range(1, len(grams) - m + 1):
        np.minimum(anchor, grams[i : m + i], out=anchor)
    first = np.searchsorted(row, row[:m], "left")
    at = np.arange(m) - first
    return row[:m][ok], at[ok], anchor[ok], own[ok]


def hot_anchors(texts: DataFrame, rows: int, size: int) -> np.ndarray:
    """Anchors of many windows in a sample of about SAMPLE_ROWS rows, in order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, data, off in text_blocks(batch.column(0)):
                _, _, row, h = hashed_words(data, off)
                anchor, count = np.unique(window_runs(h, row, size)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(count)], names=["anchor", "n"])

    if rows > SAMPLE_ROWS:
        texts = texts.sample(SAMPLE_ROWS / rows, seed=1)
    seen = texts.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = seen.agg(F.sum("n").alias("t")).first()["t"] or 0
    hot = [r[0] for r in seen.where(F.col("n") > max(64, total * HOT_SHARE)).select("anchor").collect()]
    return np.sort(np.array(hot, np.int64).view(U64))


def packed_windows(docs: DataFrame, size: int, bits: int, hot: np.ndarray) -> DataFrame:
    """Runs of windows with one anchor, cut into 2**bits fragments by anchor and packed.

    Windows of a hot anchor are spread by their own hash. Of equal windows of one block of
    texts, only those of its smallest doc_id go to fragments; the others are known to repeat
    and are packed by row, under fragment numbers from 2**bits on.
    """
    row_bits = max(0, bits - 2)

    def run(batches):
        import pyarrow as pa

        names = ["frag", "anchor", "start", "length", "own", "key", "doc", "count"]
        for batch in batches:
            keys, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, _, data, off in text_blocks(batch.column(2)):
                _, _, row, h = hashed_words(data, off)
                r, at, anchor, own = window_runs(h, row, size)
                if not len(r):
                    continue
                out: list[list] = [[] for _ in names]
                order = np.argsort(own)
                doc, group = ids[i + r][order], np.diff(own[order], prepend=own[order[0]]) != 0
                least = np.minimum.reduceat(doc, np.flatnonzero(np.concatenate([[True], group[1:]])))
                known = np.zeros(len(r), bool)
                known[order] = doc > least[np.cumsum(group)]
                k, s, d = keys[i + r[known]], at[known].astype(np.uint32), ids[i + r[known]]
                to = bucket(k, d, row_bits)
                order = np.argsort(to, kind="stable")
                k, s, d, to = k[order], s[order], d[order], to[order]
                edge = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    first = np.flatnonzero(np.concatenate([[True], (k[x + 1 : y] != k[x : y - 1]) | (d[x + 1 : y] != d[x : y - 1])]))
                    cells = (b"", planes(s[x:y]), b"", b"", k[x:y][first].tobytes(), planes(d[x:y][first]), planes(np.diff(np.append(first, y - x)).astype(np.uint32)))
                    out[0].append((1 << bits) + int(to[x]))
                    for c, v in zip(out[1:], cells):
                        c.append(v)
                r, at, anchor, own = r[~known], at[~known], anchor[~known], own[~known]
                if len(hot):
                    spread = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    anchor = np.where(spread, mix(anchor ^ mix(own)), anchor)
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
                b = np.flatnonzero(new)
                length = np.diff(np.append(b, len(r)))
                name = mix(anchor[b])
                frag = (name >> U64(64 - bits)).astype(np.int64)
                order = np.argsort(frag, kind="stable")
                b, length, frag, name = b[order], length[order], frag[order], name[order]
                windows = np.repeat(b - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                own = own[windows]
                name = name.view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES]
                ends = np.cumsum(length)
                edge = np.flatnonzero(np.diff(frag, prepend=-1, append=-1))
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    rows, count = np.unique(r[b[x:y]], return_counts=True)
                    w0 = ends[x] - length[x]
                    cells = (name[x:y].tobytes(), planes(at[b[x:y]].astype(np.uint32)), planes(length[x:y].astype(np.uint32)), own[w0 : ends[y - 1]].tobytes(), keys[i + rows].tobytes(), planes(ids[i + rows]), planes(count.astype(np.uint32)))
                    out[0].append(int(frag[x]))
                    for c, v in zip(out[1:], cells):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64())] + [pa.array(c, pa.binary()) for c in out[1:]], names=names)

    return docs.mapInArrow(run, "frag long, anchor binary, start binary, length binary, own binary, key binary, doc binary, count binary")


def bucket(key: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    """Where the rows of (key, doc_id) meet."""
    return (mix(key.view(U64) ^ mix(doc.view(U64))) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def repeated_windows(parts: DataFrame, bits: int) -> DataFrame:
    """(key, doc_id, starts): first words of the windows that a smaller doc_id holds too, by row."""
    row_bits = max(0, bits - 2)

    def unpack(t, name, kind):
        return np.frombuffer(b"".join(t[name].to_pylist()), kind)

    def later(t):
        import pyarrow as pa

        start, count, ids = (from_planes(t[c].to_pylist(), k) for c, k in (("start", np.uint32), ("count", np.uint32), ("doc", np.int64)))
        keys = unpack(t, "key", np.int64)
        if t["frag"][0].as_py() >> bits:  # known to repeat
            k, d, s = np.repeat(keys, count), np.repeat(ids, count), start
        else:
            length, count = from_planes(t["length"].to_pylist(), np.uint32).astype(np.int64), count.astype(np.int64)
            own = unpack(t, "own", U64)
            anchor = np.zeros((len(length), 8), np.uint8)
            anchor[:, :ANCHOR_BYTES] = unpack(t, "anchor", np.uint8).reshape(-1, ANCHOR_BYTES)
            anchor = np.repeat(anchor.view(U64)[:, 0], length)
            step = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
            start = np.repeat(start, length) + step.astype(np.uint32)
            run = np.repeat(np.repeat(np.arange(len(count)), count), length)
            doc = ids[run]
            order = np.lexsort((doc, own, anchor))
            a, o, d = anchor[order], own[order], doc[order]
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
            least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
            hit = order[d > least]
            k, d, s = keys[run[hit]], doc[hit], start[hit]
        order = np.lexsort((s, d, k, bucket(k, d, row_bits)))
        k, d, s = k[order], d[order], s[order]
        # One packed row for each bucket of keys, however many rows of text it stands for.
        to = bucket(k, d, row_bits)
        edge = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
        spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        first = np.flatnonzero((np.diff(k, prepend=0) != 0) | (np.diff(d, prepend=0) != 0) | (np.diff(to, prepend=-1) != 0))
        count = np.diff(np.append(first, len(k))).astype(np.uint32)
        lo, hi = (np.searchsorted(first, [x[i] for x in spans]) for i in (0, 1))
        rows = list(zip(lo.tolist(), hi.tolist()))
        by_row = {"keys": k[first], "docs": d[first], "count": count}
        cells = {c: pa.array([planes(v[x:y]) for x, y in rows], pa.binary()) for c, v in by_row.items()}
        return pa.table({"part": pa.array(to[edge[:-1]], pa.int64())} | cells | {"starts": pa.array([s[x:y].tobytes() for x, y in spans], pa.binary())})

    def by_row(t):
        import pyarrow as pa

        k, d, count = (from_planes(t[c].to_pylist(), x) for c, x in (("keys", np.int64), ("docs", np.int64), ("count", np.uint32)))
        k, d, s = np.repeat(k, count), np.repeat(d, count), unpack(t, "starts", np.uint32)
        order = np.lexsort((s, d, k))
        k, d, s = k[order], d[order], s[order]
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]), [True]])) if len(k) else np.zeros(1, np.int64)
        spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        return pa.table({"key": pa.array(k[edge[:-1]], pa.int64()), "doc_id": pa.array(d[edge[:-1]], pa.int64()), "starts": pa.array([np.unique(s[x:y]).tobytes() for x, y in spans], pa.binary())})

    found = parts.groupBy("frag").applyInArrow(later, "part long, keys binary, docs binary, count binary, starts binary")
    return found.groupBy("part").applyInArrow(by_row, "key long, doc_id long, starts binary")


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): `kept` are the words that stay, one space between.

    Words split at blanks and are compared as they are. A window is `size` consecutive words
    of a row; a word goes if a window over it also starts in a row with a smaller id. All
    windows are judged on the input. Null or empty texts and texts shorter than a window
    lose nothing (null: no words). Rows with equal ids don't remove from each other; rows
    with a null id neither lose words nor make others lose them. Every row gives one row.
    Ids are whole numbers; others raise. An empty table gives no rows; columns besides id
    and text are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}, ids are whole numbers")
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("b"), F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids")).first()
    alone = docs.agg(F.count_distinct(F.col(id_col))).first()[0] == total["ids"]
    # Ids that don't repeat name their rows; else a hash of the row tells equal ids apart.
    key = F.lit(0).cast("long") if alone else row_key(id_col, text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_"), key.alias("key"))
    bits = max(3, int(np.ceil(np.log2(max(1, (total["b"] or 0) / 6 / FRAGMENT_WINDOWS)))))
    hot = hot_anchors(src.select("text_"), total["n"], size)
    parts = packed_windows(src.where("doc_id is not null and text_ is not null").select("key", "doc_id", "text_"), size, bits, hot)
    found = repeated_windows(parts, bits)
    met = src.join(found, ["key", "doc_id"], "left").select("doc_id", "text_", "starts")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words, removed, kept = [], [], []
            for i in range(batch.num_rows):
                w = _WORD.findall(batch.column(1)[i].as_py() or "")
                starts = batch.column(2)[i].as_py()
                words.append(len(w))
                if not starts:
                    removed.append(0)
                    kept.append(" ".join(w))
                    continue
                s = np.frombuffer(starts, np.uint32).astype(np.int64)
                change = np.zeros(len(w) + 1, np.int64)
                change[s] += 1
                np.subtract.at(change, s + size, 1)
                stay = np.cumsum(change[:-1]) == 0
                removed.append(int(len(w) - stay.sum()))
                kept.append(" ".join([w[j] for j in np.flatnonzero(stay).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents"), 13)
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS pos FROM d),
g AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS gram FROM s),
first AS (SELECT gram, min(doc_id) AS doc_id FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(pos, pos + 13)) AS pos FROM g JOIN first f ON f.gram = g.gram AND f.doc_id < g.doc_id),
lost AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
