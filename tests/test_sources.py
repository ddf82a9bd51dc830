"""Scans that quarantine what they skip, merge rules and sinks, against their contracts."""

import json

import numpy as np
import pytest

from orbweave.sources import tables as S
from orbweave.streaming import metrics

RECORD = "uid string, n long"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_torn_lines_are_quarantined(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"uid": "a", "n": 1}\n\n{"uid": "b", "n": 2}\n{"uid": "c", "n')
    (tmp_path / "b.jsonl").write_text('[1, 2]\n{"n": 3}\n{"uid": "d", "n": 4, "more": true}\n')
    good, bad = S.json_lines(spark, str(tmp_path), RECORD, ["uid"])
    assert values(good, "uid", "n") == [("a", 1), ("b", 2), ("d", 4)]
    assert values(bad, "reason") == [("missing uid",), ("not JSON",), ("not an object",)]


def test_folder_of_records(spark, tmp_path):
    for name, text in (("a.json", '{"uid": "a",\n "n": 1}'), ("empty.json", ""), ("c.json", "null"), ("d.txt", "{}"), ("e.json", "{} {")):
        (tmp_path / name).write_text(text)
    (tmp_path / "b.json").write_bytes(b'{"uid": "\xff"}')
    good, bad = S.record_folder(spark, str(tmp_path), RECORD)
    assert values(good, "uid", "n") == [("a", 1)]
    assert [f.rsplit("/", 1)[1] for f, in values(bad, "file")] == ["b.json", "c.json", "e.json"]


def test_manifest_maps_ids_to_paths(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"u2": "b.glb", "u1": "a.glb"}))
    (tmp_path / "n.json").write_text(json.dumps({"u1": "z.glb"}))
    assert values(S.manifest(spark, str(tmp_path)), "uid", "path") == [("u1", "a.glb"), ("u2", "b.glb")]
    (tmp_path / "o.json").write_text("{")
    with pytest.raises(Exception, match="no manifest"):
        S.manifest(spark, str(tmp_path)).collect()


def test_file_inventory_has_a_floor(spark, tmp_path):
    (tmp_path / "a.glb").write_bytes(b"x" * 2000)
    (tmp_path / "b.glb").write_bytes(b"x" * 1024)
    (tmp_path / "c.txt").write_bytes(b"x" * 2000)
    assert [p.rsplit("/", 1)[1] for p, in values(S.file_inventory(spark, str(tmp_path), "*.glb", 1024), "path")] == ["a.glb"]


@pytest.fixture(scope="module")
def rows(spark):
    return lambda *r: spark.createDataFrame(list(r), "id long, v string, version long")


def test_upsert_keeps_the_highest_version(rows):
    old, new = rows((1, "a", 1), (2, "b", 5), (3, "c", 1)), rows((1, "a2", 2), (2, "late", 4), (4, "d", None))
    assert values(S.upsert(old, new, ["id"], "version"), "id", "v") == [(1, "a2"), (2, "b"), (3, "c"), (4, "d")]
    again = S.upsert(S.upsert(old, new, ["id"], "version"), new, ["id"], "version")
    assert values(again, "id", "v") == [(1, "a2"), (2, "b"), (3, "c"), (4, "d")]


def test_write_once_refuses_a_change(rows):
    old = rows((1, "a", 1), (None, "n", None))
    assert values(S.write_once(old, rows((1, "a", 1), (2, "b", 1), (2, "b", 1), (None, "n", None)), ["id"]), "id") == [(2,)]
    for changed in (rows((1, "CHANGED", 1)), rows((1, None, 1)), rows((2, "b", 1), (2, "c", 1)), rows((None, "other", None))):
        with pytest.raises(ValueError, match="would change"):
            S.write_once(old, changed, ["id"])
    assert values(S.conflicts(old, rows((1, "x", 1)), ["id"]), "id", "rows") == [(1, 2)]


def test_sinks_append_once_and_never_clobber(spark, rows, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    for _ in range(2):
        S.append_new(spark, rows((1, "a", 1), (2, "b", 1), (2, "b", 1)), log, ["id"])
    S.append_new(spark, rows((2, "other", 1), (3, "c", 1)), log, ["id"])
    assert values(spark.read.parquet(log), "id", "v") == [(1, "a"), (2, "b"), (3, "c")]
    S.no_clobber(spark, rows((1, "a", 1)), store, ["id"])
    S.no_clobber(spark, rows((1, "a", 1), (2, "b", 1)), store, ["id"])
    with pytest.raises(ValueError, match="would change"):
        S.no_clobber(spark, rows((1, "b", 1), (3, "c", 1)), store, ["id"])
    assert values(spark.read.parquet(store), "id", "v") == [(1, "a"), (2, "b")]


def test_ledgers_and_sets(spark):
    ledger = spark.createDataFrame([("gpu", 1.5), ("gpu", 2.0), ("api", None)], "resource string, cost double")
    assert values(S.numeric_add(ledger, ["resource"], "cost"), "resource", "cost") == [("api", None), ("gpu", 3.5)]
    a = spark.createDataFrame([(1,), (2,)], "id long")
    assert values(S.set_union(a, a), "id") == [(1,), (2,)]


def test_vector_sink_describes_what_it_wrote(spark, tmp_path):
    v = spark.createDataFrame([(i, np.float32([i, 1]).tolist()) for i in range(20)], "vec_id long, embedding array<double>")
    one = S.write_vectors(v, str(tmp_path / "a")).first()
    two = S.write_vectors(v.repartition(5).orderBy("embedding"), str(tmp_path / "b")).first()
    assert (one["count"], one.dim, one.digest) == (20, 2, two.digest)
    other = S.write_vectors(v.where("vec_id < 19"), str(tmp_path / "c")).first()
    assert other.digest != one.digest
    for bad in (v.union(v), spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], v.schema)):
        with pytest.raises(ValueError, match="an index of"):
            S.write_vectors(bad, str(tmp_path / "d"))
    assert not (tmp_path / "d").exists()


def test_a_followed_log_goes_on_where_it_stopped(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "event_type string, value double"
    for part in ([("a", 1.0), ("b", 2.0)], [("a", 5.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        metrics.follow(spark, log, schema, "*.parquet", out)
    metrics.follow(spark, log, schema, "*.parquet", out)  # nothing new
    done = spark.read.parquet(out)
    assert values(done.where("batch = 1"), "event_type", "n", "most") == [("a", 2, 5.0), ("b", 1, 2.0)]
    assert values(done.select("batch").distinct(), "batch") == [(0,), (1,)]
