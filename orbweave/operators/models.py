"""The boundary to models: any callable, loaded once for each task, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.sources.tables import kept


#: Bytes of inputs that a model gets at once at most, unless one input alone is larger.
BATCH_BYTES = 64 << 20


def gathered(views: DataFrame, key: str, order: str, value: str, most: int, least: int = 1, out: str = "inputs") -> DataFrame:
    """(key, out): the values of each record as an array in the order of `order`.

    A record has between `least` and `most` views, all of different `order` and none of them
    null; another number, a repeated place or a null value raises and names the record, so
    that a model never gets a set with a view missing. Only `most` values stand in a row: sizes
    are read before any row is made. Views that are dealt by `key` aren't dealt again.
    """
    sized = views.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(order).alias("places"), F.count(value).alias("whole"))
    bad = (F.col("n") > most) | (F.col("n") < least) | (F.col("places") < F.col("n")) | (F.col("whole") < F.col("n"))
    told = F.concat(F.lit(f"record {key} = "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" has "), F.col("n").cast("string"), F.lit(" views at "), F.col("places").cast("string"), F.lit(" places, "), F.col("whole").cast("string"), F.lit(f" of them whole; {least} to {most} are wanted"))
    kept(sized.select(F.when(bad, F.raise_error(told).cast("boolean")).alias("fit")).where("fit"))
    one = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return views.groupBy(key).agg(F.transform(one, lambda x: x["v"]).alias(out))


def batches_of(sizes: np.ndarray, batch: int, most_bytes: int) -> list[tuple[int, int]]:
    """(from, to) of runs of at most `batch` values and `most_bytes`, or of one larger value."""
    out, a, ends = [], 0, np.cumsum(sizes)
    while a < len(sizes):
        before = int(ends[a - 1]) if a else 0
        b = min(a + batch, max(a + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        out.append((a, b))
        a = b
    return out


def sizes_of(values) -> np.ndarray:
    """Bytes of each value of an Arrow column, nested ones with all that they hold."""
    import pyarrow as pa

    if pa.types.is_binary(values.type) or pa.types.is_string(values.type):
        size = np.diff(np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)) if len(values) else np.zeros(0)
        return size.astype(np.int64)
    return np.array([values.slice(i, 1).nbytes for i in range(len(values))], np.int64)


def encode(rows: DataFrame, column: str | list[str], load: Callable[[], Callable], width: int, batch: int = 256, out: str = "embedding", normalise: bool = True, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """`rows` with `out`, the vectors that a model gives for `column` (texts, images as
    binaries, arrays of images or of points; anything Arrow holds).

    `load` runs once in each task that has rows and gives a callable from a list of values to
    vectors; of several columns it gets a list of each. Values go in lists of at most `batch`
    and `most_bytes` bytes (a larger value alone); rows with a null among the columns get null
    vectors and never reach the model. Vectors of another width than `width` or another number
    of them raise, as do vectors that aren't finite; normalised ones have length 1, or 0 where
    the model gave zeros.
    """
    several = [column] if isinstance(column, str) else column
    at, names = [rows.columns.index(c) for c in several], [f"c{i}" for i in range(len(rows.columns) + 1)]
    kinds = [f.dataType for f in rows.schema.fields] + [T.ArrayType(T.DoubleType())]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches):
        import pyarrow as pa

        model = None
        for b in batches:
            whole = np.ones(b.num_rows, bool)
            for i in at:
                whole &= ~np.asarray(b.column(i).is_null())
            here = np.flatnonzero(whole)
            values = [b.column(i).take(pa.array(here)) for i in at]
            found = np.zeros((len(here), width))
            for a, e in batches_of(sum(map(sizes_of, values)), batch, most_bytes):
                part = [v.slice(a, e - a).to_pylist() for v in values]
                model = model or load()
                x = np.asarray(model(*part), np.float64)
                if x.shape != (e - a, width) or not np.isfinite(x).all():
                    raise ValueError(f"the model gave {x.shape} or numbers that aren't finite for {e - a} values of width {width}")
                found[a:e] = x
            if normalise:
                found /= np.maximum(np.sqrt((found * found).sum(1, keepdims=True)), 1e-12)
            size = np.zeros(b.num_rows, np.int64)
            size[here] = width
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=names)

    return rows.toDF(*names[:-1]).mapInArrow(run, schema).toDF(*rows.columns, out)


def write_checked(rows: DataFrame, key: str, prompt: str, load: Callable[[], Callable], check: Callable[[str], str | None], repair: Callable[[str, str, str], str], attempts: int = 2, inputs: str | None = None) -> DataFrame:
    """(key, attempts, text, reason): what a text model writes for each prompt, under a rule;
    with `inputs`, for each prompt and that column's value, such as an array of images.

    `check` says why a text is refused, or None. A refused one is asked for again with
    repair(prompt, text, reason), at most `attempts` times in all; then `text` is null and
    `reason` says why, so that exactly one of both is null. A model that raises is refused
    with its message, and only its own row suffers. Null prompts are refused unasked. The
    inputs of one row at a time become Python values.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.DataType.fromDDL("attempts int, text string, reason string").fields])

    def run(batches):
        import pyarrow as pa

        model = None
        for b in batches:
            done = []
            for row, first in enumerate(b.column(1).to_pylist()):
                more = [b.column(2)[row].as_py()] if inputs else []
                ask, text, why, n = first, None, "no prompt", 0
                while ask is not None and n < attempts:
                    model, n = model or load(), n + 1
                    try:
                        text = model(ask, *more)
                        why = check(text)
                    except Exception as e:  # noqa: BLE001 - a model's own failures
                        text, why = "", f"{type(e).__name__}: {e}"
                    if why is None:
                        break
                    ask = repair(first, text, why)
                done.append((n, None if why else text, why))
            cols = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return rows.select(F.col(key), F.col(prompt), *([F.col(inputs)] if inputs else [])).mapInArrow(run, schema)


def hashed_words(width: int) -> Callable[[], Callable]:
    """A stand-in text encoder: words by their CRC-32, signed by its lowest bit."""

    def load():
        import zlib

        def model(texts):
            out = np.zeros((len(texts), width))
            for i, t in enumerate(texts):
                for w in t.split():
                    h = zlib.crc32(w.encode())
                    out[i, (h >> 1) % width] += 1 - 2 * (h & 1)
            return out

        return model

    return load


def flatten_trees(trees: DataFrame) -> DataFrame:
    """(house, idx, id, asset, parent, depth, room): nested objects in depth-first order.

    trees: house, tree (JSON: {"objects": [{"id", "asset", "room", "children"}]}). `parent` is
    the parent's idx; a child is in its parent's room. A house that is no JSON, has no
    objects or an object without an id raises and is named. Trees of any depth work.
    """

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            out = []
            for house, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    todo = [(o, None, 0, o["room"]) for o in reversed(json.loads(text)["objects"])]
                    if not todo:
                        raise ValueError("no objects")
                    n = 0
                    while todo:
                        o, parent, depth, room = todo.pop()
                        out.append((house, n, str(o["id"]), o.get("asset"), parent, depth, room))
                        todo += [(c, n, depth + 1, room) for c in reversed(o.get("children") or [])]
                        n += 1
                except (KeyError, TypeError, ValueError) as e:
                    raise ValueError(f"house {house}: {type(e).__name__} {e}") from e
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["house", "idx", "id", "asset", "parent", "depth", "room"])

    return trees.select("house", "tree").mapInArrow(run, "house long, idx long, id string, asset long, parent long, depth long, room string")
