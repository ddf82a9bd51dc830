"""Positions within groups of any size, and digests that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from orbweave.sources.tables import kept

#: Nodes of a digest tree that are hashed together.
FAN = 1024


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str = "position") -> DataFrame:
    """`rows` with `out`: 0, 1, ... within each group by `order`, ascending, nulls first.

    Rows are sorted by range, so a group of any size spreads over tasks; each task counts
    within its stretch, and only what a group's earlier stretches hold is added, a row for
    each bound between tasks. Rows that are equal in `order` get places in any order. Null
    is a group of its own; without `group` all rows are one.
    """
    return counted(stretches(rows, group, order), rows.columns, out)


def stretches(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` by range of group and order, written: columns c0, c1, ..., the group as a text g,
    and the number of the part. What numbering needs besides can be counted from it."""
    names = [f"c{i}" for i in range(len(rows.columns))]
    at = dict(zip(rows.columns, names))
    key = F.to_json(F.struct(*[F.col(at[g]) for g in group]), {"ignoreNullFields": "false"}) if group else F.lit("")
    plain = rows.toDF(*names).withColumn("g", key).withColumn("tie", F.monotonically_increasing_id())
    by = ["g", *[at[o] for o in order], "tie"]
    return kept(plain.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).drop("tie"))


def counted(stretch: DataFrame, columns: list[str], out: str) -> DataFrame:
    """The rows of stretches(), with the columns' names and their place in the group."""
    names = [f"c{i}" for i in range(len(columns))]
    sizes = stretch.groupBy("g", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    later = sizes.select("g", "part", before.alias("before")).where("before is not null")
    schema = T.StructType([*stretch.schema.fields, T.StructField("run", T.LongType())])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(len(names)).dictionary_encode()
            code = g.indices.to_numpy()
            head = np.concatenate([[True], code[1:] != code[:-1]])
            start = np.flatnonzero(head)
            run = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
            if g.dictionary[int(code[0])].as_py() == last:
                run[: start[1] if len(start) > 1 else len(run)] += n
            last, n = g.dictionary[int(code[-1])].as_py(), int(run[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run, pa.int64())], names=schema.names)

    # `later` has a row for each partition at most: a group goes on where another one ended.
    placed = stretch.mapInArrow(count, schema).join(F.broadcast(later), ["g", "part"], "left")
    return placed.select(*[F.col(n).alias(c) for c, n in zip(columns, names)], (F.col("run") + F.coalesce("before", F.lit(0))).alias(out))


def ordered_digest(rows: DataFrame, group: list[str], order: list[str], leaf: Column, fan: int = FAN) -> DataFrame:
    """(group..., n, digest): one SHA-256 over the leaves of each group in their order.

    Leaves are hashed by `fan` under their level's number, their digests by `fan` again, and
    so on until a group has one. So a digest depends on each leaf and on the order, not on
    partitions, and no row holds more than `fan` digests. Leaves are short strings (digests
    themselves, where there is much to digest); a null leaf is an empty one. `order` must
    tell the rows of a group apart, or else ties are taken in the order of their leaves.
    """
    at = [f"g{i}" for i in range(len(group))]
    flat = rows.select(*[F.col(g).alias(a) for g, a in zip(group, at)], *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.coalesce(leaf, F.lit("")).alias("leaf"))
    placed = numbered(flat, at, [*[f"o{i}" for i in range(len(order))], "leaf"])
    level, nodes = 0, kept(placed.select(*at, "position", "leaf"))
    sizes = nodes.groupBy(*at).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n").alias("m")).first()["m"] or 0
    while level == 0 or most > 1:
        level += 1
        inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "leaf"))), lambda x: x["leaf"]), "\n")
        block = F.floor(F.col("position") / fan).alias("block")
        one = nodes.groupBy(*at, block).agg(F.sha2(F.concat(F.lit(f"{level}\n"), inner), 256).alias("hashed"), F.first("leaf").alias("leaf"), F.count("*").alias("m"))
        if level > 1:  # a group of one node is done
            alone = W.partitionBy(*at)
            one = one.withColumn("hashed", F.when((F.col("m") == 1) & (F.max("block").over(alone) == 0), F.col("leaf")).otherwise(F.col("hashed")))
        nodes = kept(one.select(*at, F.col("block").alias("position"), F.col("hashed").alias("leaf")))
        most = -(-most // fan)
    joined = nodes.select(*at, F.lit(None).cast("long").alias("n"), "leaf").union(sizes.select(*at, "n", F.lit(None).cast("string")))
    done = joined.groupBy(*at).agg(F.max("n").alias("n"), F.max("leaf").alias("digest"))
    return done.where("n > 0").select(*[F.col(a).alias(g) for g, a in zip(group, at)], "n", "digest")
