"""Fill-in-middle against one row at a time."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm import fim
from orbweave.llm.queries import ORACLES, QUERIES
from tests.duck import connect, differences
from tests.llm.test_contracts import sha


def by_hand(doc_id, text, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text, re.S)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_op11_rows(spark, sf_dir):
    got = QUERIES["op11_fill_in_middle"](spark, sf_dir)
    assert not differences(connect(sf_dir), ORACLES["op11_fill_in_middle"], got.columns, got.collect())
    docs = {r.doc_id: r.text for r in pd.read_parquet(f"{sf_dir}/documents.parquet").itertuples()}
    kinds = set()
    for r in got.collect():
        n, form, p, m, out = by_hand(r.doc_id, docs.pop(r.doc_id) or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, sha(out))
        kinds.add(form)
    assert not docs and {"psm", "spm"} <= kinds


TEXTS = [None, "", "\n", "a", "a\n", "\n\na", "é中\n𝄞x\n", "no <S> here", "< P><", "<P", "x\r\ny", " \t", "line\n" * 3000, "one long line " * 20_000, "é" * 70_000]
UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r".", "word": r"[ \t\n\v\f\r]+(?=[^ \t\n\v\f\r])|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|[ \t\n\v\f\r]+"}


@pytest.mark.parametrize("unit", UNITS)
def test_units_of_any_text(spark, unit):
    rows = [(i, t, "x", 1) for k in range(3) for i, t in enumerate(TEXTS, 20 * k)] + [(None, "a\nb\nc", None, 2), (3, "a\nb", "x", 3), (3, "a\nb", "x", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, fim_form int").withColumn("draw", F.lit(5))
    out = fim.fill_in_middle(d.coalesce(2), unit)
    assert out.columns == ["doc_id", "text", "a.b", "draw", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    got = out.withColumn("again", fim.restored(F.col("fim_text"), F.col("fim_form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = by_hand(r.doc_id, r.text, UNITS[unit])
        assert (r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == want, (r.doc_id, want[:4])
        assert r.again == (r.text or "")
    assert fim.fill_in_middle(d.limit(0), unit).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("a \né<P>S", max_size=12), max_size=8), st.data())
def test_cuts_of_all_rows_together(texts, data):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    units = {u: [re.findall(p, t, re.S) for t in texts] for u, p in UNITS.items()}
    for u, found in units.items():
        n = np.array([len(f) for f in found], np.int64)
        k = np.array([data.draw(st.integers(0, int(x))) for x in n], np.int64)
        got = fim.cut_units(np.frombuffer(b"".join(raw), np.uint8), off, u, lambda seen: (k, seen))
        assert got[0].tolist() == n.tolist()
        assert (got[1] - off[:-1]).tolist() == [len("".join(f[:i]).encode()) for f, i in zip(found, k)]
        assert got[2].tolist() == off[1:].tolist() and got[3].tolist() == [len("".join(f[:i])) for f, i in zip(found, k)]


def test_rates_marks_and_torn_characters(spark):
    d = spark.range(400).selectExpr("id AS doc_id", "concat('a\nb\nc\n', id) AS text")
    kinds = lambda **k: {r.fim_form: r["count"] for r in fim.fill_in_middle(d, **k).groupBy("fim_form").count().collect()}
    assert kinds(rate=0) == {"plain": 400} and kinds(spm_rate=0) == {"psm": 400} and kinds(spm_rate=100) == {"spm": 400}
    half = kinds(rate=50)
    assert 150 < half["plain"] < 250 and kinds(seed=8) != kinds()
    marks = ("[pre]", "[suf]", "[mid]")
    own = fim.fill_in_middle(d, marks=marks)
    assert own.where(fim.restored(F.col("fim_text"), F.col("fim_form"), marks) != F.col("text")).count() == 0
    for bad in (("a", "b"), ("a", "", "b"), ("ab", "ba", "c"), ("aa", "b", "c"), ("abc", "b", "d"), ("x", "x", "y")):
        with pytest.raises(ValueError, match="marks"):
            fim.fill_in_middle(d, marks=bad)
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(d, "page")
    torn = spark.sql("SELECT 1L AS doc_id, cast(X'61FF0A62' AS string) AS text")
    assert fim.fill_in_middle(torn).first().fim_units == 2
