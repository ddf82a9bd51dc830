"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import LOWER, U64, plain, table, text_blocks, word_hashes, word_spans
from orbweave.llm.labelled import fit_in_task, id_fold

#: Bounds of the labelled sample: documents, and code points of one document.
SAMPLE_DOCS, SAMPLE_CHARS = 8000, 20_000
#: A word is a feature if so many sampled documents hold it, and its count among toxic ones
#: is so many standard deviations from what the base rate gives.
MIN_DOCS, MIN_SURPLUS = 4, 4.5
PREFIXES = (5, 7)
#: Bytes of text whose words are held at a time while fitting.
FIT_BYTES = 1 << 18

_LETTER = np.zeros(256, bool)
for _r in (slice(65, 91), slice(97, 123), slice(128, 256)):
    _LETTER[_r] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True  # line feed ! . ?


def sentence_words(data: np.ndarray, off: np.ndarray):
    """(feature hash, its sentence, row of each sentence, its first and end byte).

    The features of a word are itself and its first bytes, which compounds share.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z
    low = LOWER[data]
    s_st, s_en, s_row = word_spans(~_END[data], off)
    st, en, _ = word_spans(_LETTER[data], off)
    sent, h = np.searchsorted(s_st, st, "right") - 1, [word_hashes(low, st, en)]
    for k in PREFIXES:
        h.append(word_hashes(low, st, np.minimum(en, st + k)) + U64(k))
    return np.concatenate(h), np.tile(sent, len(h)), s_row, s_st, s_en


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def sentences(self, data: np.ndarray, off: np.ndarray):
        """(log-odds of each sentence, row, first byte, end byte)."""
        h, sent, row, st, en = sentence_words(data, off)
        z = np.full(len(row), self.bias)
        if len(h) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            hit = np.flatnonzero(self.vocabulary[at] == h)
            pair = np.unique(sent[hit] * len(self.vocabulary) + at[hit])
            z += np.bincount(pair // len(self.vocabulary), self.weights[pair % len(self.vocabulary)], len(row))
        return z, row, st, en


def feature_words(texts, y: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words that tell the labels apart, counted block by block: only
    a word's two counts are held for all of the sample."""
    vocab, counts = np.zeros(0, np.uint64), np.zeros((0, 2))
    for i, _, data, off in text_blocks(texts, FIT_BYTES):
        h, sent, row, _, _ = sentence_words(data, off)
        doc = row[sent]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        both = np.stack([np.ones(int(new.sum())), y[i + doc[new]]], 1)
        vocab, inv = np.unique(np.concatenate([vocab, h[new]]), return_inverse=True)
        both = np.concatenate([counts, both])
        counts = np.stack([np.bincount(inv, both[:, c], len(vocab)) for c in (0, 1)], 1)
    rate = y.mean()
    surplus = (counts[:, 1] - counts[:, 0] * rate) / np.sqrt(np.maximum(counts[:, 0] * rate * (1 - rate), 1e-9))
    return vocab[(counts[:, 0] >= MIN_DOCS) & (np.abs(surplus) >= MIN_SURPLUS)]


def fit_toxicity(texts, labels: np.ndarray) -> ToxicityModel:
    """Maximise the likelihood of document labels under P(toxic) = 1 - prod(1 - p_s).

    Words hold a weight each, drawn to 0 by an L1 penalty; the gradient shares a toxic
    document's blame among its sentences by their scores.
    """
    import pyarrow as pa

    y = np.asarray(labels, float)
    arr = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -8.0)  # nothing to learn from: nothing is toxic
    vocab = feature_words(arr, y)
    v, base = len(vocab), 0
    ps, pw, rows = [], [], []
    for i, _, data, off in text_blocks(arr, FIT_BYTES):
        h, sent, r, _, _ = sentence_words(data, off)
        at = np.minimum(np.searchsorted(vocab, h), max(v - 1, 0))
        hit = np.flatnonzero(vocab[at] == h) if v else np.zeros(0, np.int64)
        pair = np.unique(sent[hit] * v + at[hit]) if v else np.zeros(0, np.int64)
        ps.append(pair // max(v, 1) + base), pw.append(pair % max(v, 1)), rows.append(r + i)
        base += len(r)
    ps, pw, row = np.concatenate(ps), np.concatenate(pw), np.concatenate(rows)
    n = len(texts)
    w, b = np.zeros(v), -6.0
    m1, m2 = np.zeros(v + 1), np.zeros(v + 1)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * 0.5 + 0.5 / n
    for i in range(1, 301):
        z = b + np.bincount(ps, w[pw], base)
        total = np.bincount(row, softplus(z), n)
        miss = np.exp(-total)
        dt = share * np.where(y > 0, -miss / np.maximum(1 - miss, 1e-9), 1.0)
        dz = dt[row] / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.append(np.bincount(pw, dz[ps], v), dz.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.08 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-7)
        w -= step[:-1]
        b -= step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - 0.004, 0)
    used = np.abs(w) > 1e-9
    return ToxicityModel(vocab[used], w[used], float(b))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", locate: float = 0.5, score_col: str = "toxicity", spans_col: str = "offending") -> DataFrame:
    """`docs` with score_col (0 to 1) and spans_col: spans of sentences that score `locate`
    or more, as array<struct<start, end, score>> in code points of the whole text.

    A null or text without sentences scores 0 and offends nowhere. Rows are scored one by
    one: repeats and ties score alike. Columns of these two names in `docs` are replaced.
    """
    docs = docs.drop(plain(score_col), plain(spans_col))
    columns = docs.columns
    kinds = T.DataType.fromDDL("score double, spans array<struct<start:long,end:long,score:double>>").fields
    names = [f"c{i}" for i in range(len(columns) + 2)]  # any names may be in docs
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields + kinds)])
    at = columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score, spans = np.empty(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for i, j, data, off in text_blocks(batch.column(at), FIT_BYTES):
                z, row, st, en = model.sentences(data, off)
                score[i:j] = -np.expm1(-np.bincount(row, softplus(z), j - i))
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                bad = np.flatnonzero(p >= locate)
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for k in bad:
                        zero = points[off[row[k]]]
                        spans[i + row[k]].append({"start": int(points[st[k]] - zero), "end": int(points[en[k]] - zero), "score": float(p[k])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, kind)], names=names)

    return docs.toDF(*names[:-2]).mapInArrow(run, schema).toDF(*columns, score_col, spans_col)


def train_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit_in_task(docs, labels, SAMPLE_DOCS, SAMPLE_CHARS, fit_toxicity, ToxicityModel)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "offending")
