"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import SPACE, U64, mix, table, text_blocks, word_hashes, word_spans
from orbweave.llm.labelled import fit_in_task, id_fold

#: Bounds of the labelled sample: documents, and code points of one document.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True  # upper case
_CLASS[1, 48:58] = True  # digits
_CLASS[2, [32, 9, 11, 12, 13]] = True  # blanks
_CLASS[3, [44, 46]] = True  # comma, full stop
_CLASS[4, 33:127] = True  # symbols: what is left of printable ASCII
for _r in (slice(48, 58), slice(65, 91), slice(97, 123)):
    _CLASS[4, _r] = False
_CLASS[4, [39, 44, 46]] = False
_CLASS[5, 97:123] = True  # lower case
OWN = 10


def line_features(data: np.ndarray, off: np.ndarray):
    """(features, line bytes, row) of each line that holds more than its line feed.

    A line's own features, then those of the lines before and after it in its document
    (zeros at the ends), then a constant.
    """
    st, en, row = word_spans(data != 10, off)
    n = len(st)
    x = np.zeros((n, 3 * OWN + 1))
    if not n:
        return x, np.zeros(0), row
    size = (en - st).astype(float)
    share = []
    for c in _CLASS:
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(c[data], out=run[1:])
        share.append((run[en] - run[st]) / size)
    upper, digit, blank, stop, symbol, lower = share
    h = word_hashes(data, st, en) ^ mix(row.astype(U64) + U64(1))
    _, inv, cnt = np.unique(h, return_inverse=True, return_counts=True)
    w_st, w_en, _ = word_spans(~SPACE[data], off)
    line = np.searchsorted(st, w_st, "right") - 1
    w = word_hashes(data, w_st, w_en)
    again = np.flatnonzero((w[1:] == w[:-1]) & (line[1:] == line[:-1])) + 1
    echo = np.bincount(line[again], minlength=n) / np.maximum(1, np.bincount(line, minlength=n))
    own = np.stack([2 * upper, 4 * digit, 3 * blank, 3 * stop, 4 * symbol, lower, np.log1p(size) / 5, (cnt[inv] > 1).astype(float), (symbol > 0.05).astype(float), 3 * echo], 1)
    x[:, :OWN] = own
    same = row[1:] == row[:-1]
    x[1:, OWN : 2 * OWN] = own[:-1] * same[:, None]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:] * same[:, None]
    x[:, -1] = 1
    return x, size, row


def _scan(m: np.ndarray) -> np.ndarray:
    """Prefix products of 2 x 2 matrices, each scaled to sum 1, by doubling."""
    p, step = m.reshape(-1, 4).T.copy(), 1
    while step < p.shape[1]:
        a, b, c, d = p[:, :-step]
        e, f, g, h = p[:, step:]
        q = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
        p[:, step:] = q / q.sum(0)
        step *= 2
    return p.T.reshape(-1, 2, 2)


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Forward-backward over all chains at once: P(good) of each line and the pair
    marginals with the line before. A chain's first matrix has equal rows, so it forgets
    the chain before it, and products over whole blocks keep chains apart."""
    u = np.stack([np.zeros_like(unary), unary], 1)
    u = np.exp(u - u.max(1, keepdims=True))
    t = np.exp(trans - trans.max())
    m = t[None] * u[:, None, :]
    m[first] = u[first][:, None, :]
    m /= m.sum((1, 2), keepdims=True)
    alpha = _scan(m)[:, 0, :]
    back = _scan(m[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1)  # products from a line to the end
    beta = np.ones_like(alpha)
    beta[:-1] = back[1:].sum(2)
    node = alpha * beta
    node /= node.sum(1, keepdims=True)
    pair = np.zeros_like(m)
    pair[1:] = alpha[:-1, :, None] * m[1:] * beta[1:, None, :]
    pair[first] = 0
    s = pair.sum((1, 2), keepdims=True)
    return node[:, 1], np.divide(pair, s, out=np.zeros_like(pair), where=s > 0)


@dataclass
class QualityModel:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float
    prior: float


def _first(row: np.ndarray) -> np.ndarray:
    f = np.ones(len(row), bool)
    f[1:] = row[1:] != row[:-1]
    return f


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return x


def document_means(p: np.ndarray, size: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the lines' P(good); NaN without lines."""
    w = np.bincount(row, size, n)
    return np.divide(np.bincount(row, size * p, n), w, out=np.full(n, np.nan), where=w > 0)


def fit_quality(texts, labels: np.ndarray) -> QualityModel:
    """Fit on document labels: lines start with their document's label; after a first fit,
    lines of bad documents that the field finds good are good, save each one's worst."""
    import pyarrow as pa

    y = np.asarray(labels, float)
    xs, sizes, rows = [], [], []
    for i, _, data, off in text_blocks(pa.array(texts, pa.string()) if isinstance(texts, list) else texts):
        x, s, r = line_features(data, off)
        xs.append(x), sizes.append(s), rows.append(r + i)
    if not len(y) or not sum(map(len, xs)) or y.min() == y.max():
        return QualityModel(np.zeros(3 * OWN + 1), np.zeros((2, 2)), 0.0, 0.0, float(y.mean()) if len(y) else 0.5)
    x, size, row = np.concatenate(xs), np.concatenate(sizes), np.concatenate(rows)
    first, n, d = _first(row), len(texts), x.shape[1]
    inner = ~first[1:]
    share = np.where(y[row] > 0, 0.5 / max(1, (y[row] > 0).sum()), 0.5 / max(1, (y[row] == 0).sum()))
    good = y[row]
    theta = np.zeros(d + 4)
    for _ in range(2):

        def grad(t, good=good):
            p, pair = marginals(x @ t[:d], t[d:].reshape(2, 2), first)
            g = x.T @ (share * (p - good))
            gi = good.astype(int)
            seen = np.bincount((2 * gi[:-1] + gi[1:])[inner], share[1:][inner], 4)
            return np.concatenate([g, ((share[:, None, None] * pair).sum(0).ravel() - seen)]) + 1e-4 * t

        theta = _adam(grad, theta, 100, 0.15)
        p, _ = marginals(x @ theta[:d], theta[d:].reshape(2, 2), first)
        worst = np.full(n, 2.0)
        np.minimum.at(worst, row, p)
        good = np.where((y[row] > 0) | ((p > 0.5) & (p > worst[row])), 1.0, 0.0)
    q = document_means(p, size, row, n)
    z = np.log((q + 1e-4) / (1 - q + 1e-4))
    ok = ~np.isnan(z)

    def logistic(t):
        e = 1 / (1 + np.exp(-np.clip(t[0] * z[ok] + t[1], -30, 30))) - y[ok]
        return np.array([(e * z[ok]).mean(), e.mean()])

    a, b = _adam(logistic, np.array([1.0, 0.0]), 500, 0.05)
    return QualityModel(theta[:d], theta[d:].reshape(2, 2), float(a), float(b), float(y.mean()))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and score: the probability of good quality, over whole texts.

    A text without lines (null, empty or line feeds only) scores the training share of
    good documents. Rows are scored one by one: repeats and ties score alike.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, j, data, off in text_blocks(batch.column("text_")):
                x, size, row = line_features(data, off)
                q = np.full(j - i, np.nan)
                if len(row):
                    p, _ = marginals(x @ model.weights, model.trans, _first(row))
                    q = document_means(p, size, row, j - i)
                z = np.log((q + 1e-4) / (1 - q + 1e-4))
                s = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30)))
                out[i:j] = np.where(np.isnan(q), model.prior, s)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(out)], names=[*keep, "score"])

    src = docs.select(*keep, F.col(text_col).alias("text_"))
    schema = docs.select(*keep).schema.add("score", "double")
    return src.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, fit_in_task(docs, labels, SAMPLE_DOCS, SAMPLE_CHARS, fit_quality, QualityModel))
    return scored.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
