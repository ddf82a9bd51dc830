"""Settled answers: how often a model is called, and what a torn store does."""

import json

import pytest
from pyspark.sql import functions as F

from orbweave.operators import settled


@pytest.fixture
def calls(tmp_path):
    log = tmp_path / "calls"
    log.write_text("")

    def load():
        def model(prompt):
            with log.open("a") as f:
                f.write(prompt + "\n")
            if prompt.startswith("bad"):
                return ""
            return f"{prompt} answered"

        return model

    return load, lambda: sorted(log.read_text().splitlines())


def ask(rows, load, path, **more):
    return settled.settle_texts(rows, "prompt", load, lambda t: None if t else "empty", lambda p, t, why: f"{p} again", path, **more)


def table(spark, pairs):
    d = spark.createDataFrame(pairs, "id long, a string, b string")
    a, b = settled.symmetric(F.col("a"), F.col("b"))
    return d.select("id", settled.content_key([a, b], ["v1"]).alias("key"), F.concat_ws("-", a, b).alias("prompt")).repartition(4)


@pytest.mark.parametrize("waves", [1, 3])
def test_a_pair_is_asked_once_in_all_runs(spark, tmp_path, calls, waves):
    load, said = calls
    path = str(tmp_path / "store")
    pairs = [(i, *p) for i, p in enumerate([("x", "y"), ("y", "x"), ("x", "x"), ("bad", "z")] * 30)]
    got = ask(table(spark, pairs), load, path, waves=waves).collect()
    assert len(got) == 120 and said() == ["bad-z", "bad-z again", "x-x", "x-y"]
    assert {(r.prompt, r.text, r.attempts, r.degraded, r.reason) for r in got} == {("x-y", "x-y answered", 1, False, None), ("x-x", "x-x answered", 1, False, None), ("bad-z", None, 2, True, "empty")}
    again = ask(table(spark, pairs), load, path).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and len(said()) == 4  # degraded is settled
    ask(table(spark, [*pairs, (999, "x", "w")]), load, path).collect()
    assert said()[2:] == ["w-x", "x-x", "x-y"]


def test_a_torn_line_is_asked_again(spark, tmp_path, calls):
    load, said = calls
    path = tmp_path / "store"
    rows = table(spark, [(1, "x", "y"), (2, "p", "q")])
    ask(rows, load, str(path)).collect()
    for f in path.glob("part-*"):
        text = f.read_text()
        if "x-y" in text:
            at = text.index("\n", text.index("x-y"))
            f.write_text(text[: at - 9] + text[at:] if text.count("\n") > 1 else text[:-9])
            (path / f".{f.name}.crc").unlink(missing_ok=True)
    got = {r.prompt: r.text for r in ask(rows, load, str(path)).collect()}
    assert got == {"x-y": "x-y answered", "p-q": "p-q answered"}
    assert said() == ["p-q", "x-y", "x-y"]


def test_an_answer_stands_before_a_failure(spark, tmp_path, calls):
    load, said = calls
    rows = table(spark, [(1, "x", "y")])
    key = rows.first().key
    (tmp_path / "store").mkdir()
    line = {"key": key, "attempts": 2, "text": None, "reason": "empty", "degraded": True}
    good = line | {"attempts": 1, "text": "kept", "reason": None, "degraded": False}
    (tmp_path / "store" / "a.json").write_text("\n".join(json.dumps(x) for x in (good, line, good | {"attempts": 2}, {"key": key})) + "\n")
    r = ask(rows, load, str(tmp_path / "store")).first()
    assert (r.text, r.attempts, said()) == ("kept", 1, [])


def test_null_keys_and_empty_tables(spark, tmp_path, calls):
    load, said = calls
    d = spark.createDataFrame([(None, "p"), ("k", "q")], "key string, prompt string")
    assert {(r.key, r.text) for r in ask(d, load, str(tmp_path / "s")).collect()} == {(None, None), ("k", "q answered")} and said() == ["q"]
    assert ask(d.limit(0), load, str(tmp_path / "none")).collect() == []


def test_keys_tell_values_apart(spark):
    d = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("c", "ab"), (None, "c"), ("", "c"), ('a","b', "c")], "a string, b string")
    keys = [r.k for r in d.select(settled.content_key([F.col("a"), F.col("b")], ["v"]).alias("k")).collect()]
    assert len(set(keys)) == 6
    both = [r.k for r in d.select(settled.content_key(settled.symmetric(F.col("a"), F.col("b")), ["v"]).alias("k")).collect()]
    assert both[0] == both[2] and len(set(both)) == 5
    assert d.select(settled.content_key([F.col("a"), F.col("b")], ["w"]).alias("k")).first().k != keys[0]


def test_values_are_encoded_once(spark, tmp_path):
    log = tmp_path / "calls"

    def load():
        def model(texts):
            with log.open("a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    d = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "b", None] * 20)], "id long, text string").repartition(5)
    for _ in range(2):
        got = settled.settle_vectors(d, "text", ["m1"], load, 2, str(tmp_path / "v")).collect()
        assert len(got) == 60 and {r.text: r.embedding is None for r in got} == {"aa": False, "b": False, None: True}
        assert sorted(log.read_text().split()) == ["aa", "b"]
    settled.settle_vectors(d, "text", ["m2"], load, 2, str(tmp_path / "v")).collect()
    assert sorted(log.read_text().split()) == ["aa", "aa", "b", "b"]  # another model, other keys
