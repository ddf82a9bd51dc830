"""Subword tokens of texts by a supplied merge table: byte-level pairs with word ends."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a merge table that go to all tasks at most; words a worker remembers.
TABLE_BYTES, REMEMBERED = 64 << 20, 200_000
# Fixed value: words, as the table's publisher splits them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """A letter for each byte: printable ones stand for themselves, the others, in order, for
    the letters from 256 on."""
    shown, out, more = {*range(33, 127), *range(161, 173), *range(174, 256)}, [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return out


class Subwords:
    """Ids of words by a table of merges in order; `end` marks a word's last letter."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str, words: str = WORDS) -> None:
        import regex

        self.ids, self.end, self.letters = vocabulary, end, byte_letters()
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): n for n, m in enumerate(merges)}
        self.words = regex.compile(words)
        self.known: dict[str, list[int]] = {}

    def parts(self, word: str) -> list[str]:
        """The word's symbols after all merges: the pair of the least rank first, the leftmost
        of equal ones; a heap holds the pairs, and those that have changed are skipped."""
        part: list[str | None] = [self.letters[b] for b in word.encode("utf-8", "replace")]
        part[-1] += self.end
        n, ranks = len(part), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := ranks.get((a, b))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((part[x], part[y]))) is not None:
                    heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p is not None]

    def encode(self, text: str) -> list[int]:
        """Ids of the text's words, composed (NFC) and in lower case; symbols that the
        vocabulary lacks have none."""
        return [i for w in self.split(text) for i in self.word(w)]

    def count(self, text: str) -> int:
        return sum(len(self.word(w)) for w in self.split(text))

    def split(self, text: str) -> Iterator[str]:
        return (m[0] for m in self.words.finditer(unicodedata.normalize("NFC", text).lower()))

    def word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = [self.ids[p] for p in self.parts(word) if p in self.ids]
            if len(word) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found


@lru_cache(maxsize=2)
def _subwords(table: bytes) -> Subwords:
    model = json.loads(table)["model"]
    return Subwords(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")


def merge_table(spark: SparkSession, path: str) -> Broadcast:
    """A JSON file of vocabulary and merges, read once and sent to all tasks."""
    with open(path, "rb") as f:
        data = f.read(TABLE_BYTES + 1)
    if len(data) > TABLE_BYTES:
        raise ValueError(f"{path} is larger than {TABLE_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def token_counts(rows: DataFrame, column: str, table: Broadcast, specials: int = 2, out: str = "tokens") -> DataFrame:
    """`rows` with `out`: the subwords of `column` and `specials` for its start and end. A null
    counts as empty. Texts are read whole, word by word; nothing is cut off."""
    return _with(rows, column, out, T.LongType(), lambda text: _subwords(table.value).count(text) + specials, specials)


def token_ids(rows: DataFrame, column: str, table: Broadcast, start: int, end: int, out: str = "ids") -> DataFrame:
    """`rows` with `out`: ids of the start, the subwords and the end, as array<int>."""
    return _with(rows, column, out, T.ArrayType(T.IntegerType()), lambda text: [start, *_subwords(table.value).encode(text), end], [start, end])


def _with(rows: DataFrame, column: str, out: str, kind, f, empty) -> DataFrame:
    at, names = rows.columns.index(column), [f"c{i}" for i in range(len(rows.columns) + 1)]
    schema = T.StructType([*[T.StructField(n, x.dataType) for n, x in zip(names, rows.schema.fields)], T.StructField(names[-1], kind)])

    def run(batches):
        import pyarrow as pa

        arrow = pa.int64() if isinstance(kind, T.LongType) else pa.list_(pa.int32())
        for b in batches:
            texts = b.column(at).cast(pa.large_binary())
            got = [f(t.as_py().decode("utf-8", "replace")) if t.is_valid else empty for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow)], names=names)

    return rows.toDF(*names[:-1]).mapInArrow(run, schema).toDF(*rows.columns, out)


def refuse_overlong(rows: DataFrame, tokens: str, most: int, name: str) -> DataFrame:
    """`rows`, or an error that names the first row met (by column `name`) with more than
    `most` tokens: a longer text would be cut by the encoder without a word."""
    told = F.concat(F.lit("text of "), F.coalesce(F.col(name).cast("string"), F.lit("null")), F.lit(" has "), F.col(tokens).cast("string"), F.lit(f" tokens, at most {most} fit"))
    return rows.withColumn(tokens, F.when(F.col(tokens) <= most, F.col(tokens)).otherwise(F.raise_error(told).cast("long")))
