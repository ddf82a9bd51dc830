"""Streams merged into tables: batches that are repeated, killed or compacted count once."""

import pytest
from pyspark.errors import StreamingQueryException

from orbweave.streaming.merge import MergedTable, merge_stream

SCHEMA = "k string, n long"


@pytest.fixture
def world(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(source))

    def run(**more):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        merge_stream(stream, MergedTable(spark, out, SCHEMA, ["k"]), str(tmp_path / "state"), **more)

    read = lambda: {r.k: r.n for r in MergedTable(spark, out, SCHEMA, ["k"]).read().collect()}
    return put, run, read, tmp_path / "out"


def die(number):
    raise RuntimeError(f"killed in {number}")


def test_a_batch_killed_before_its_commit_counts_once(world):
    put, run, read, out = world
    put(("a", 1), ("b", 2), ("a", 10))
    run()
    put(("a", 100), (None, 5))
    for _ in range(2):
        with pytest.raises(StreamingQueryException, match="killed in 1"):
            run(after=die)
        assert read() == {"a": 111, "b": 2, None: 5}  # it was written
    run()
    assert read() == {"a": 111, "b": 2, None: 5}
    run()  # nothing new
    put(("b", 1000))
    run()
    assert read() == {"a": 111, "b": 1002, None: 5}
    assert sorted(p.name for p in out.iterdir()) == ["batch=0", "batch=1", "batch=2"]


def test_compaction_can_be_killed_anywhere(world, spark, monkeypatch):
    put, run, read, out = world
    for i in range(4):
        put(("a", 10**i), (f"k{i}", 1))
        run()
    want = {"a": 1111} | {f"k{i}": 1 for i in range(4)}
    t = MergedTable(spark, str(out), SCHEMA, ["k"])
    monkeypatch.setattr(t, "clean", lambda: None)
    t.compact()  # killed before it removed anything
    assert read() == want and len(list(out.iterdir())) == 5
    t.apply(spark.createDataFrame([("a", 7777)], SCHEMA), 3)  # a repeat of what the base holds
    assert read() == want
    (out / "upto=9").mkdir()  # a base without its marker
    (out / "batch=8").mkdir()
    assert read() == want
    t = MergedTable(spark, str(out), SCHEMA, ["k"])
    t.clean()
    assert read() == want and {p.name for p in out.iterdir()} == {"upto=3", "upto=9", "batch=8"}
    put(("a", 10_000))
    run(compact_every=5)
    assert read() == want | {"a": 11_111} and "upto=4" in {p.name for p in out.iterdir()} and not (out / "upto=3").exists()


def test_the_highest_version_stays(spark, tmp_path):
    t = MergedTable(spark, str(tmp_path), "k string, v long, x string", ["k"], "v")
    rows = lambda *r: spark.createDataFrame(list(r), t.schema)
    assert t.read().collect() == []
    t.apply(rows(("a", 2, "new"), ("b", 1, "b")), 0)
    t.apply(rows(("a", 1, "late"), ("b", 1, "c"), ("a", 2, "new")), 1)
    for _ in range(2):
        assert {(r.k, r.v, r.x) for r in t.read().collect()} == {("a", 2, "new"), ("b", 1, "c")}
        t.compact()
