"""Places where an operator once did less than the whole job."""

import numpy as np
import pytest

import corpus_pipeline
from orbweave.llm import substrings


def test_windows_with_one_anchor_are_told_apart_by_all_bits(spark, monkeypatch):
    runs = substrings.window_runs

    def high_bits(h, row, size):
        r, at, anchor, own = runs(h, row, size)
        return r, at, anchor, own & np.uint64(0xFFFFFF0000000000)

    line = "a line of nine words that all rows hold"
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(10)), line, *(f"b{i}x{j}" for j in range(10))])) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, rows[7][1])], "doc_id long, text string")
    monkeypatch.setattr(substrings, "window_runs", high_bits)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert got == {i: 0 for i in range(40)} | {99: 29}


@pytest.mark.parametrize("written", [True, False])
def test_stages_decide_by_row(spark, tmp_path, written):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    leak = "what is the name of the tallest hill in this land"
    rows = [(None, a), (None, a), (None, f"{a} more"), (3, b), (3, b), (3, f"{b} more"), (3, "a clean row of its own with an id that copies have"), (None, leak), (7, leak), (7, "a clean row beside a leaked one"), (None, None), (None, None), (9, f"{b} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    if written:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    order = lambda found: sorted(map(str, found))
    clean = [tuple(r) for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()]
    assert order(clean) == order(r for r in rows if r[1] != leak)
    left = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    whole = lambda found: order(r for r in found if not (r[1] or "").startswith(("a0", "b0")))
    assert whole(left) == whole(r for r in rows if r != (None, leak))
    assert [r[0] for r in left if (r[1] or "").startswith("a0")] == [None]
    assert [r[0] for r in left if (r[1] or "").startswith("b0")] == [3]
