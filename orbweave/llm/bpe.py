"""Byte-level BPE: pre-tokens are merged with a queue of ranks kept as a hierarchical bitmap."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice, pairwise

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.llm.common import table, text_blocks

#: Bytes of a vocabulary file that go to all tasks at most.
VOCABULARY_BYTES = 64 << 20
#: Pre-tokens whose ids a worker remembers (twice that many at most), and the longest of
#: them in code points.
REMEMBERED, SHORT = 400_000, 64
#: Bytes of texts that are encoded between two results.
BLOCK = 1 << 20
#: Code points from which a text's pre-tokens are read some at a time, and how many.
LONG, SOME = 1 << 20, 1 << 16


class RankQueue:
    """A set of (rank, position) that gives the least rank first, and of it the least position.

    A rank's bucket is a heap of positions. A bit of a word says that the rank's bucket holds
    any, and a bit of `top` that a word isn't zero: the least rank is found by the first set
    bit of two integers, however many positions wait. Words are as wide as there are words.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.shift = max(6, (ranks.bit_length() + 1) // 2)
        self.words, self.top = [0] * ((ranks >> self.shift) + 1), 0

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        word = rank >> self.shift
        self.words[word] |= 1 << (rank - (word << self.shift))
        self.top |= 1 << word

    def pop(self) -> tuple[int, int]:
        """The least (rank, position), or (-1, -1)."""
        top = self.top
        if not top:
            return -1, -1
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        lowest = bits & -bits
        rank = (word << self.shift) + lowest.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits ^ lowest
        if bits == lowest:
            self.top = top ^ 1 << word
        return rank, bucket[0]


class Encoder:
    """Ids of texts, by a vocabulary of ranks and a pattern of pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        if len(self.tokens) < len(self.ranks) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a vocabulary needs one rank a token, and each single byte")
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(self.tokens) + 1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: of all adjacent pairs that form a token, the one of the
        least rank merges first, the leftmost of equal ones, until none is left."""
        rank_of, n = self.ranks.get, len(piece)
        if (whole := rank_of(piece)) is not None:
            return [whole]
        push, pop = self.queue.push, self.queue.pop
        after = list(range(1, n + 2))  # a token's end is the next one's start
        before = list(range(-1, n))
        # The rank of the pair that starts at a position; entries of the queue that differ
        # from it are stale.
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        while True:
            rank, i = pop()
            if rank < 0:
                break
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            r = -1
            if end < n:
                before[end] = i
                r = rank_of(piece[i : after[end]], -1)
                if r >= 0:
                    push(r, i)
            pair[i] = r
            at = before[i]
            if at >= 0:
                r = rank_of(piece[at:end], -1)
                if r != pair[at]:
                    pair[at] = r
                    if r >= 0:
                        push(r, at)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return out

    def ids(self, piece: str) -> bytes:
        """The packed ids of a pre-token. Short ones are remembered: when there are too many,
        those that aren't asked for again before as many new ones came are forgotten."""
        found = self.older.get(piece)
        if found is None:
            found = packed(self.merge(piece.encode("utf-8")))
            if len(piece) > SHORT:
                return found
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[piece] = found
        return found

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, some at a time if the text is long."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while some := list(islice(found, SOME)):
            yield some

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for pieces in self.pretokens(text):
            known = self.known
            out.append(b"".join([known.get(p) or self.ids(p) for p in pieces]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id of no token raises KeyError."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def _encoder(vocabulary: bytes, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


def vocabulary_file(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary of lines "<base64 token> <rank>", read once and sent to all tasks."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode_bpe(docs: DataFrame, vocabulary: Broadcast, pattern: str, text_col: str = "text", ids_col: str = "bpe_ids") -> DataFrame:
    """`docs` with ids_col, each text's ids as little-endian unsigned 32-bit integers.

    Each match of the pattern is encoded by itself, without special tokens; what no match
    covers has no ids. A null or empty text has none (an empty value); bytes that are no
    UTF-8 count as U+FFFD. Texts are read whole: one of any length is worked through by its
    pre-tokens, of which the longest takes some 200 bytes for each of its bytes. A column of
    this name in `docs` is replaced; rows are encoded one by one, an empty table gives none.
    """
    docs = docs.drop(ids_col)
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns) + 1)]  # any names may be in docs
    schema = T.StructType([*[T.StructField(x, f.dataType) for x, f in zip(names, docs.schema.fields)], T.StructField(names[-1], T.BinaryType())])
    at = columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(vocabulary.value, pattern)
        for batch in batches:
            for i, j, data, off in text_blocks(batch.column(at), BLOCK):
                raw = data.tobytes()
                ids = [encoder.encode(raw[a:b].decode("utf-8", "replace")) for a, b in pairwise(off.tolist())]
                rest = [c.slice(i, j - i) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary())], names=names)

    return docs.toDF(*names[:-1]).mapInArrow(run, schema).toDF(*columns, ids_col)


def decode_bpe(docs: DataFrame, vocabulary: Broadcast, pattern: str, ids_col: str = "bpe_ids", bytes_col: str = "bpe_bytes") -> DataFrame:
    """`docs` with bytes_col, the bytes that the ids of encode_bpe() stand for. They are the
    text's UTF-8 if the pattern covers it. A null is an empty value; an id that the
    vocabulary lacks fails the job."""
    docs = docs.drop(bytes_col)
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns) + 1)]
    schema = T.StructType([*[T.StructField(x, f.dataType) for x, f in zip(names, docs.schema.fields)], T.StructField(names[-1], T.BinaryType())])
    at = columns.index(ids_col)

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(vocabulary.value, pattern)
        for batch in batches:
            out = [encoder.decode(x.as_buffer()) if x.is_valid else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)

    return docs.toDF(*names[:-1]).mapInArrow(run, schema).toDF(*columns, bytes_col)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sent = vocabulary_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_bpe(texts, sent, public_tokenizers.PATTERN).select("doc_id", F.col("bpe_ids").alias("ids"))
    d = decode_bpe(ids, sent, public_tokenizers.PATTERN, "ids", "bytes")
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
