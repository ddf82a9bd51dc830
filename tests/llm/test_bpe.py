"""Byte-level BPE against the tiktoken library, and its queue against a plain sort."""

import base64
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.llm import bpe
from orbweave.llm.queries import QUERIES
from tests.llm.test_contracts import sha

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_op12_is_what_the_library_gives(spark, sf_dir, library):
    got = QUERIES["op12_byte_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    assert sorted(got.index) == sorted(docs.doc_id)
    for d in docs.itertuples():
        want = library.encode_ordinary(d.text or "")
        packed = np.array(want, "<u4").tobytes()
        assert tuple(got.loc[d.doc_id]) == (len(want), __import__("hashlib").sha256(packed).hexdigest(), sha(d.text or ""))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab cé中'\n\t.", max_size=200))
def test_any_text(encoder, library, text):
    got = encoder.encode(text)
    assert ids(got) == library.encode_ordinary(text) and encoder.decode(got) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "abcab" * 6_000, "=-" * 9_000, " " * 5_000, "é中" * 3_000, "".join(random.Random(3).choices("etaoinshrdlu", k=40_000))])
def test_very_long_pre_tokens(encoder, library, text):
    assert ids(encoder.encode(text)) == library.encode_ordinary(text)
    assert not encoder.queue.buckets and not any(encoder.queue.words) and not encoder.queue.top


def plain(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=25), st.text("abc", max_size=40), st.randoms())
def test_vocabularies_of_any_order(tokens, text, rnd):
    """Pairs may make a token of a lower rank than the one just merged."""
    order = [bytes([b]) for b in range(256)] + [t.encode() for t in tokens]
    rnd.shuffle(order)
    e = bpe.Encoder(b"\n".join(base64.b64encode(t) + b" %d" % (3 * i) for i, t in enumerate(order)), r"(?s).+")
    assert ids(e.encode(text)) == (plain(e.ranks, text.encode()) if text.encode() not in e.ranks else [e.ranks[text.encode()]])


@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(0, 50)), max_size=80))
def test_queue_gives_the_least_first(pairs):
    q, out = bpe.RankQueue(70_001), []
    for p in pairs:
        q.push(*p)
    while (x := q.pop())[0] >= 0:
        out.append(x)
    assert out == sorted(pairs)


def test_memory_of_pre_tokens_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "SOME", 7)
    e = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choices("abcdé", k=rnd.choice([2, 3, 100]))) for _ in range(800))
    assert ids(e.encode(text)) == library.encode_ordinary(text)
    assert max(len(e.known), len(e.older)) <= 40 and max(map(len, e.known)) <= bpe.SHORT


def test_rows_of_any_kind(spark, tmp_path, vocabulary):
    sent = bpe.vocabulary_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = [(1, None, "x"), (2, "", "x"), (2, "a b", None), (2, "a b", None), (None, "né " * 400_000, "y"), (3, "<|endoftext|>", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").selectExpr("*", "doc_id AS bpe_ids", "CASE WHEN doc_id = 1 THEN cast(X'61FF62' AS string) ELSE text END AS raw")
    e = bpe.encode_bpe(d, sent, public_tokenizers.PATTERN)
    assert e.columns == ["doc_id", "text", "a.b", "raw", "bpe_ids"] and e.limit(0).collect() == []
    got = bpe.decode_bpe(e, sent, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bpe_bytes) for r in got) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode_bpe(d.limit(0), sent, public_tokenizers.PATTERN).collect() == []
    torn = bpe.decode_bpe(bpe.encode_bpe(d.where("doc_id = 1"), sent, public_tokenizers.PATTERN, "raw"), sent, public_tokenizers.PATTERN).first()
    assert bytes(torn.bpe_bytes).decode() == "a�b"
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode_bpe(d.selectExpr("X'FFFFFF7F' AS bpe_ids"), sent, public_tokenizers.PATTERN).collect()
    for bad in (b"YQ== 0\nYQ== 1\n", b"YQ== 0\nYg== 0\n"):
        with pytest.raises(ValueError, match="vocabulary"):
            bpe.Encoder(bad, ".")


def test_vocabularies_have_a_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError, match="larger than 10"):
        bpe.vocabulary_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert regex.compile(public_tokenizers.PATTERN)
