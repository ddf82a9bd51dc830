"""Benchmark decontamination by pigeonhole pieces and Myers bit-parallel distance.

Texts are compared as sequences of words (runs of letters and digits, without case), and
an edit inserts, drops or replaces a word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import LOWER, few, gram_hashes, table, text_blocks, word_hashes, word_spans

#: Edits allowed for each word of an item, and the words of a piece that are looked up.
ERROR_RATE, GRAM = 0.2, 4
#: Code points of items that one table of pieces holds; more items go in blocks.
BLOCK_CHARS = 4_000_000

_INSIDE = np.zeros(256, bool)
for _r in (slice(48, 58), slice(65, 91), slice(97, 123), slice(128, 256)):
    _INSIDE[_r] = True


def folded_words(data: np.ndarray, off: np.ndarray):
    """(hash, row, first byte, end byte) of the words, A-Z and accented capitals folded."""
    low = LOWER[data]
    if len(data):
        accented = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[accented] += 32
    st, en, row = word_spans(_INSIDE[data], off)
    return word_hashes(low, st, en), row, st, en


def budget(m: int, rate: float) -> int:
    """Edits for an item of m words; pieces keep GRAM words at least."""
    return max(0, min(int(m * rate), m // GRAM - 1))


def pieces(m: int, k: int) -> list[int]:
    """Offsets of k + 1 pieces of near equal length; k edits leave one of them intact."""
    return [m * i // (k + 1) for i in range(k + 1)]


def myers(pattern: list, text: list, k: int) -> tuple[int, int] | None:
    """(distance, end) of the first best occurrence of the pattern in the text within k
    edits, by bit-parallel dynamic programming; the start in the text is free."""
    m = len(pattern)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Exact hits of all pieces, then verification along their diagonals."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import pyarrow as pa

        self.items: list[tuple[object, list[int], int]] = []
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, raw in items:
            for _, _, data, off in text_blocks(pa.array([raw or ""], pa.string())):
                h, row, _, _ = folded_words(data, off)
                k, g = budget(len(h), rate), min(GRAM, len(h))
                if not g:
                    continue
                grams, _ = gram_hashes(h, row, g)
                by_size.setdefault(g, []).extend((int(grams[p]), len(self.items), p) for p in pieces(len(h), k))
                self.items.append((item_id, h.tolist(), k))
        self.tables = []
        for g, found in by_size.items():
            found.sort()
            self.tables.append((g, np.array([f[0] for f in found], np.uint64), np.array([f[1:] for f in found], np.int64)))

    def find(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, object, int, int, int]]:
        """(row, item_id, distance, first byte, end byte), the best of each item and row."""
        h, row, st, en = folded_words(data, off)
        begin = np.searchsorted(row, np.arange(len(off)), "left")
        hits: dict[tuple[int, int], set[int]] = {}
        for g, keys, where in self.tables:
            grams, ok = gram_hashes(h, row, g)
            lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            for w in np.flatnonzero(ok & (hi > lo)):
                for i, p in where[lo[w] : hi[w]].tolist():
                    hits.setdefault((int(row[w]), i), set()).add(int(w) - p)
        out = []
        for (r, i), diagonals in hits.items():
            item_id, item, k = self.items[i]
            first, last = int(begin[r]), int(begin[r + 1])
            best, done = None, None
            for d in sorted(diagonals):
                if done is not None and d <= done:
                    continue  # the last window reached this diagonal
                lo, hi, done = max(first, d - k), min(last, d + len(item) + 2 * k), d + k
                hit = myers(item, h[lo:hi].tolist(), k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo + hit[1])
            if best:
                dist, end = best
                back = myers(item[::-1], h[max(first, end - len(item) - k) : end][::-1].tolist(), k)
                start = end - (back[1] if back else len(item))
                out.append((r, item_id, dist, int(st[start]), int(en[end - 1])))
        return out


def item_blocks(items: DataFrame, item_text: str):
    """The distinct texts of the items as lists of (md5, text), each of bounded size."""
    texts = items.where(F.col(item_text).isNotNull()).select(F.col(item_text).alias("text_")).distinct()
    total = texts.agg(F.sum(F.length("text_")).alias("n")).first()["n"] or 0
    n_blocks = total // BLOCK_CHARS + 1
    for b in range(n_blocks):
        yield [(r[0], r[1]) for r in texts.where(F.pmod(F.xxhash64("text_"), F.lit(n_blocks)) == b).select(F.md5("text_"), "text_").collect()]


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, whatever their id, in which find_contamination finds no item. No
    items leave all rows; other columns come back as they were."""
    at, schema = docs.columns.index(text_col), docs.schema
    for block in item_blocks(items, item_text):

        def run(batches, block=block):
            import pyarrow as pa

            matcher = Matcher(block, rate)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, off in text_blocks(batch.column(at)):
                    clean[[i + hit[0] for hit in matcher.find(data, off)]] = False
                left = batch.filter(pa.array(clean))
                yield pa.RecordBatch.from_arrays(left.columns, names=schema.names)

        # Plain names on the way in: mapInArrow does not take dots.
        docs = docs.toDF(*(f"c{i}" for i in range(len(schema)))).mapInArrow(run, schema)
    return docs


def find_contamination(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): benchmark items that occur in documents.

    An item of m words may have floor(rate * m) edits, at most m // 4 - 1 so that pieces
    have four words; items of under eight words must occur exactly. Its best occurrence in
    each document counts, the first of ties; the span is in code points of the raw text.
    Null and empty texts and items match nothing; equal items or documents are all
    reported. Items go to the tasks in blocks of bounded size, each against all documents.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_")).where("text_ is not null")
    out = None
    for block in item_blocks(items, item_text):

        def run(batches, block=block):
            import pyarrow as pa

            matcher = Matcher(block, rate)
            for batch in batches:
                rows: list[tuple] = []
                for i, _, data, off in text_blocks(batch.column(1)):
                    for r, item_id, dist, a, e in matcher.find(data, off):
                        zero = off[r]
                        start = int(((data[zero:a] & 0xC0) != 0x80).sum())
                        rows.append((i + r, item_id, dist, start, start + int(((data[a:e] & 0xC0) != 0x80).sum())))
                cols = list(zip(*rows)) or [()] * 5
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=schema.names)

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    # Equal items were matched once; each of them is reported.
    named = items.select(F.col(item_col).alias("item_id"), F.md5(item_text).alias("item"))
    return out.join(few(named, named.count()), "item").select("doc_id", "item_id", "distance", "start", "end")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
