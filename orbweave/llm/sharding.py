"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

DataFrame functions only. The law is "rows": shard sizes differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.llm.common import cut, table

ROUNDS, WALKS = 4, 32
#: Hex digits of a row's key that name its block: 16**3 blocks, each numbered on its own.
BLOCK_DIGITS = 3


def text_crc32(c: Column) -> Column:
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary"))


def row_numbers(rows: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """`rows` with global_row (gapless from 0, in the order of the hex string `key`, then
    `ties`) and n_rows. Blocks of keys are numbered apart and then moved by the sizes of
    the blocks before them, so no task sees all rows; the block table has 4,096 rows."""
    rows = rows.withColumn("block", F.substring(key, 1, BLOCK_DIGITS))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size_"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("block", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("before"), F.sum("size_").over(W.partitionBy()).alias("n_rows"))
    place = F.row_number().over(W.partitionBy("block").orderBy(key, *ties))
    out = rows.withColumn("place", place).join(F.broadcast(sizes), "block")
    return out.withColumn("global_row", F.col("before") + F.col("place") - 1).drop("block", "before", "place")


def _round(half: Column, r: int, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{r}"), half.cast("string"))), 1, 13), 16, 10).cast("long")


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the permutation of 0..a*b-1: x is (left, right), left below a."""
    def turn(s: Column, r: int) -> Column:
        def left(s: Column) -> Column:
            return F.struct(F.pmod(s["l"] + _round(s["r"], r, seed), a).alias("l"), s["r"].alias("r"))

        def right(s: Column) -> Column:
            return F.struct(s["l"].alias("l"), F.pmod(s["r"] + _round(s["l"], r, seed), b).alias("r"))

        return F.transform(F.array(s), right if r % 2 else left)[0]

    state = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    for r in range(ROUNDS):
        state = turn(state, r)
    return F.transform(F.array(state), lambda s: s["l"] + s["r"] * a)[0]


def permuted(x: Column, n: Column, seed: int) -> Column:
    """The place of row x of n: walk the cycle until it is back below n.

    a * b exceeds n by less than a, about the square root of n, so a walk leaves the
    rows with probability 1/sqrt(n) a step. Up to 1,024 rows the walk's bound is proven;
    beyond it 32 steps fail with probability under 2**-160, and then the query raises.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), feistel(x, a, b, seed), lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)))


def assign_shards(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, global_row, shard and slot for each row.

    The permuted place p gives shard p mod `shards` and slot p div `shards`: counts differ
    by one at most and slots are gapless from 0. Rows order by md5 of the id ("" for null),
    then id, crc32 and size; rows equal in all of these are interchangeable. A null or
    empty text has size 16. No rows give no rows. Other columns are not carried.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(F.coalesce(text_col, F.lit(""))) + 16).cast("long").alias("size"),
        text_crc32(F.col(text_col)).alias("text_crc32"),
    )
    # A null id may be hot: such rows spread by their text.
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_crc32").cast("string"))))
    rows = cut(rows.withColumn("key", key))
    rows = row_numbers(rows, "key", ["doc_id", "text_crc32", "size"])
    p = permuted(F.col("global_row"), F.col("n_rows"), seed)
    rows = rows.withColumn("p", F.when(p < F.col("n_rows"), p).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    return rows.select("doc_id", "size", "text_crc32", "global_row", F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("p") / shards).cast("long").alias("slot"))


SHARDS, SEED = 40, 7


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = assign_shards(table(spark, sf_dir, "documents"), SHARDS, SEED)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql_round(half: str, r: int) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:{r}:' || {half}), 1, 13) AS BIGINT)"


OP8_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, length(h) // 2 + 16 AS size, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc FROM h, crc),
g AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, crc, size) - 1 AS g, count(*) OVER () AS n FROM d),
s AS (SELECT *, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a FROM g), ab AS (SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM s),
p AS (SELECT g, n, a, b, g AS x, 0 AS k FROM ab UNION ALL
  SELECT g, n, a, b, l + r * a, k + 1 FROM (SELECT g, n, a, b, k, l, (r + {_sql_round("l", 3)}) % b AS r FROM (SELECT g, n, a, b, k, (l + {_sql_round("r", 2)}) % a AS l, r FROM (SELECT g, n, a, b, k, l, (r + {_sql_round("l", 1)}) % b AS r FROM
    (SELECT g, n, a, b, k, (l + {_sql_round("r", 0)}) % a AS l, r FROM (SELECT *, x % a AS l, x // a AS r FROM p WHERE k = 0 OR x >= n) t0) t1) t2) t3) t4)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INT) AS shard, CAST(x // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM ab JOIN p USING (g) WHERE k > 0 AND x < p.n
"""
