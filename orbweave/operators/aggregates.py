"""Aggregates of vectors, combined in Arrow before and after the shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of partial vectors that a task holds before it hands them on.
HELD = 1 << 20
def _log_sum_exp(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of each stretch of rows, from its greatest down; -inf of -inf alone."""
    most = np.maximum.reduceat(x, start)
    base = np.where(np.isfinite(most), most, 0)
    size = np.diff(np.append(start, len(x)))
    with np.errstate(divide="ignore"):
        return np.log(np.add.reduceat(np.exp(x - np.repeat(base, size, axis=0)), start)) + base


#: How the rows of each stretch join, whether vectors or partial results.
JOIN = {"sum": np.add.reduceat, "max": np.maximum.reduceat, "min": np.minimum.reduceat, "logsumexp": _log_sum_exp}


def vector_aggregates(rows: DataFrame, group: list[str], column: str, wanted: dict[str, str]) -> DataFrame:
    """(group..., n, one array<double> for each of `wanted`): element by element over the
    vectors of a group.

    `wanted` maps names to "sum", "mean", "max", "min" or "logsumexp". A task combines the
    vectors of a group that it meets, a batch as one matrix, and sends one row for a group
    (more if it meets too many groups to hold); what arrives is sorted by group and combined
    in the same way, so a group of any size takes the memory of one vector. Null vectors
    count nowhere, groups of nulls alone give no row, a null group is one. Vectors of
    different widths, or with null elements, raise.
    """
    bad = {k for k in wanted.values() if k != "mean" and k not in JOIN}
    if bad or not wanted:
        raise ValueError(f"unknown aggregates {sorted(bad)}")
    kinds = sorted({"sum" if k == "mean" else k for k in wanted.values()})
    keys = [f"g{i}" for i in range(len(group))]
    flat = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(column).cast("array<double>").alias("v")).where("v is not null")
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    flat = flat.select(key.alias("key"), *keys, F.lit(1).cast("long").alias("n"), *[F.col("v").alias(k) for k in kinds])
    fields = flat.schema.fields
    schema = T.StructType(fields)

    def run(ordered: bool):
        def combine(batches):
            import pyarrow as pa

            held, new, rows, size = None, [], 0, 0

            def joined(table):
                """One row for each key of the table, in the order of keys."""
                table = table.sort_by("key") if not ordered else table
                table = table.combine_chunks()
                code = table["key"].combine_chunks().dictionary_encode().indices.to_numpy() if table.num_rows else np.zeros(0, np.int64)
                start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))[: len(code)]
                first = table.take(pa.array(start))
                cols = [first[c] for c in ["key", *keys]]
                cols.append(pa.array(np.add.reduceat(np.asarray(table["n"]), start) if len(start) else np.zeros(0, np.int64)))
                for k in kinds:
                    lists = table[k].combine_chunks()
                    size = np.asarray(lists.value_lengths())
                    if len(size) and (size.min() != size.max() or lists.flatten().null_count):
                        raise ValueError(f"vectors have widths from {size.min()} to {size.max()} or null elements")
                    x = np.asarray(lists.flatten(), np.float64).reshape(len(size), -1)
                    x = JOIN[k](x, start) if x.size else x[start]
                    off = pa.array(np.arange(len(start) + 1) * x.shape[1], pa.int32())
                    cols.append(pa.ListArray.from_arrays(off, pa.array(x.ravel())))
                return pa.table(cols, names=schema.names)

            def whole(held, new):
                t = pa.Table.from_batches(new)
                return joined(t if held is None else pa.concat_tables([held, t.cast(held.schema)]))

            # What arrived is joined when it is as much as what is held, so that a row is sorted
            # and copied a few times only, however many batches there are.
            for b in batches:
                if not b.num_rows:
                    continue
                new.append(pa.RecordBatch.from_arrays(b.columns, names=schema.names))
                rows += b.num_rows
                size += sum(b.column(schema.names.index(k)).nbytes for k in kinds)
                if rows < (held.num_rows if held is not None else 1) and size < 8 * HELD:
                    continue
                held, new, rows, size = whole(held, new), [], 0, 0
                if sum(held[k].nbytes for k in kinds) > 8 * HELD:
                    done = held.num_rows - 1 if ordered else held.num_rows  # the last key may go on
                    yield from held.slice(0, done).to_batches()
                    held = held.slice(done) if ordered else None
            if new:
                held = whole(held, new)
            if held is not None:
                yield from held.to_batches()

        return combine

    partial = flat.mapInArrow(run(False), schema)
    whole = partial.repartition("key").sortWithinPartitions("key").mapInArrow(run(True), schema)
    mean = lambda c: F.transform(c, lambda x: x / F.col("n"))
    out = [(mean("sum") if k == "mean" else F.col(k)).alias(name) for name, k in wanted.items()]
    return whole.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], "n", *out)
