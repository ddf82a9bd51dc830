"""Positions, line numbers and digest trees against plain loops."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators.places import numbered, ordered_digest
from orbweave.sources import tables as S


def test_positions_of_large_groups(spark):
    rnd = random.Random(3)
    rows = [(None if k == 5 else k, rnd.randrange(10**6), "x" * (i % 7)) for i in range(6000) for k in [0 if i % 3 else rnd.randrange(9)]]
    d = spark.createDataFrame(rows, "g long, o long, `a.b` string").repartition(9)
    d = d.withColumnRenamed("a.b", "part")
    got = {}
    for r in numbered(d, ["g"], ["o", "part"]).collect():
        got.setdefault(r.g, []).append((r.position, r.o, r.part))
    for g, found in got.items():
        assert [x[0] for x in sorted(found)] == list(range(len(found)))
        assert [x[1:] for x in sorted(found)] == sorted(r[1:] for r in rows if r[0] == g)
    assert sum(map(len, got.values())) == len(rows)
    assert sorted(r.position for r in numbered(d, [], ["o"]).collect()) == list(range(len(rows)))
    same = d.withColumn("o", F.lit(1))
    assert sorted(r.position for r in numbered(same, [], ["o"]).collect()) == list(range(len(rows)))
    assert numbered(d.limit(0), ["g"], ["o"]).collect() == []


def tree(leaves, fan):
    level = 0
    while level == 0 or len(leaves) > 1:
        level += 1
        leaves = [hashlib.sha256(f"{level}\n{chr(10).join(leaves[i : i + fan])}".encode()).hexdigest() for i in range(0, len(leaves), fan)]
    return leaves[0]


@pytest.mark.parametrize("fan", [2, 16, 1024])
def test_digests_depend_on_order_and_not_on_partitions(spark, fan):
    rows = [(m, i, f"{m}{i * i % 77}") for m, n in (("a", 1), ("b", 2), ("c", 17), ("d", 300)) for i in range(n)]
    d = spark.createDataFrame(rows, "m string, i long, leaf string")
    want = {m: (n, tree([r[2] for r in rows if r[0] == m], fan)) for m, n in (("a", 1), ("b", 2), ("c", 17), ("d", 300))}
    for parts in (1, 7):
        got = ordered_digest(d.repartition(parts), ["m"], ["i"], F.col("leaf"), fan)
        assert {r.m: (r.n, r.digest) for r in got.collect()} == want
    back = {r.m: r.digest for r in ordered_digest(d.withColumn("i", -F.col("i")), ["m"], ["i"], F.col("leaf"), fan).collect()}
    assert back["a"] == want["a"][1] and all(back[m] != want[m][1] for m in "bcd")
    assert ordered_digest(d.where("m = 'c'"), [], ["i"], F.col("leaf"), fan).first().digest == want["c"][1]
    assert ordered_digest(d.limit(0), ["m"], ["i"], F.col("leaf"), fan).collect() == []


def test_no_row_holds_more_than_a_branch(spark):
    """A module of 300,000 tensors; nothing is gathered but 1,024 digests at a time."""
    d = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    leaves = {i * 7919 % 300_000: hashlib.sha256(str(i).encode()).hexdigest() for i in range(300_000)}
    assert ordered_digest(d, [], ["i"], F.col("leaf")).first().digest == tree([leaves[i] for i in range(300_000)], 1024)


@pytest.mark.parametrize("split", ["100", "1m"])
def test_line_numbers_over_several_splits(spark, tmp_path, split):
    rnd, want = random.Random(6), {}
    for name in ("train", "val", "empty", "odd name%41"):
        lines = ["" if rnd.random() < 0.2 else json.dumps({"n": i, "pad": "é" * rnd.randrange(40)}, ensure_ascii=False) for i in range(0 if name == "empty" else 150)]
        lines += ['{"n": ', "[]"] if name == "val" else []
        (tmp_path / f"{name}.jsonl").write_text("".join(x + "\n" for x in lines))
        want |= {f"{name}_{i:05d}": json.loads(x)["n"] for i, x in enumerate(lines) if x and x[-1] == "}"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, bad = S.keyed_json_lines(spark, str(tmp_path), "n long", ["n"])
        assert {r.key: r.n for r in good.collect()} == want
        assert sorted((r.key, r.reason) for r in bad.collect()) == [("val_00150", "not JSON"), ("val_00151", "not an object")]
        if split == "100":
            assert S.line_numbers(spark, str(tmp_path)).rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
