"""Helpers shared by the operators: lineage cuts, word hashing, components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows up to which a key table may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where
    none is set and all tasks run on this machine, as in tests."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orbweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of one file of a checkpoint, where it is known to have few; and the files at most.
FILE_ROWS, FEW_FILES = 100_000, 8


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a checkpoint that survives lost executors.

    A checkpoint has a file for each partition, and each file costs its task a process that
    sets its mode. Where at most `rows` rows are known to come and they fit FEW_FILES, they
    are dealt to as few files as hold them, after the tasks that make them.
    """
    shared_folder(df.sparkSession)
    files = None if rows is None else max(1, -(-rows // FILE_ROWS))
    return (df.repartition(files) if files and files <= FEW_FILES else df).checkpoint()


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if its known row count is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def plain(name: str):
    """A column by its exact name, also if it holds dots."""
    return F.col(f"`{name}`")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """`names`, lengthened until `docs` has no column so named."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --- words of Arrow text columns, as 64-bit hashes -------------------------------------------

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Local(dict):
    """A cache that stays where it was filled: functions sent to tasks carry it empty."""

    def __reduce__(self):
        return Local, ()


_powers = Local()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16) * 5 // 4
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves about half of the output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_blocks(column, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of slices of an Arrow string column.

    A slice has about `limit` bytes, or one row that is longer. Null is empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n, bufs = len(arr), arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are inside a word; rows cut runs."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    head[edge] = inside[edge]
    tail[edge - 1] = inside[edge - 1]
    st, en = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return st, en, np.searchsorted(off, st, "right") - 1


def word_hashes(data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, whatever stands around it. Spans are in order;
    what they cover is hashed PIECE by PIECE, so long texts take no more than that."""
    if len(data) <= PIECE:
        return mix(_span_sums(data, st, en))
    out, i = np.zeros(len(st), U64), 0
    while i < len(st):
        j = max(i + 1, int(np.searchsorted(en, st[i] + PIECE, "right")))
        if en[i] - st[i] <= PIECE:
            out[i:j] = _span_sums(data[st[i] : en[j - 1]], st[i:j] - st[i], en[i:j] - st[i])
        else:  # one long span: its pieces' sums, each times the power of where it starts
            j = i + 1
            for n, at in enumerate(range(st[i], en[i], PIECE)):
                to = min(at + PIECE, en[i])
                part = _span_sums(data[at:to], np.zeros(1, np.int64), np.array([to - at]))
                out[i : i + 1] += part * U64(pow(BASE, n * PIECE, 2**64))
        i = j
    return mix(out)


def _span_sums(data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[: len(data)], out=c[1:])
    return (c[en] - c[st]) * down[st]


#: Bytes of text that are hashed at once; longer texts go piece by piece, cut between words.
PIECE = 1 << 20


def hashed_words(data: np.ndarray, off: np.ndarray, outside: np.ndarray = SPACE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of the words of each row; `outside` marks bytes between words.

    A text of any length takes some 60 bytes of memory for each of its words (and as much
    again for each byte of one piece), not for each of its bytes.
    """
    found, at, n = [], 0, len(data)
    while at < n or not found:
        to = min(n, at + PIECE)
        while to < n and not outside[data[to]]:
            gap = np.flatnonzero(outside[data[to : to + 4096]])
            to = to + int(gap[0]) if len(gap) else min(n, to + 4096)
        part = data[at:to]
        st, en, row = word_spans(~outside[part], np.clip(off - at, 0, to - at))
        found.append((st + at, en + at, row, word_hashes(part if fold is None else fold[part], st, en)))
        at = to
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))


def gram_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one row."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    s = np.zeros(m, U64)
    for i in range(k):
        s = s * U64(0xD6E8FEB86659FD93) + h[i : m + i]
    return mix(s), row[:m] == row[k - 1 :]


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for each node with a link.

    Labels spread along links and then jump to their label's label, so long chains
    take a logarithmic number of rounds. All state stays distributed; each round is a
    checkpoint. Null ends are ignored. No links give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), "v"))).alias("e"))
    e = cut(e.select("e.u", "e.v").distinct())  # both ways, and each node with itself
    most = e.count()
    lab = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    lab = cut(lab, most)
    while True:
        near = e.join(lab, e.v == lab.node).groupBy("u").agg(F.min("component").alias("c"), F.max(F.when(F.col("u") == F.col("v"), F.col("component"))).alias("old"))
        up = lab.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = cut(near.join(up, "c").select(F.col("u").alias("node"), "old", F.least("c", "cc").alias("component")), most)
        lab = new.select("node", "component")
        if not new.where("old <> component").limit(1).count():
            return lab
