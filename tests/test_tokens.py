"""Subwords against a plain loop and the library that published the table."""

import json
import random
import unicodedata

import pandas as pd
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.operators import tokens
from orbweave.plans import catalog

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as f:
        return tokens._subwords(f.read())


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain(s, text):
    out = []
    for word in regex.findall(tokens.WORDS, unicodedata.normalize("NFC", text).lower()):
        parts = [s.letters[b] for b in word.encode()]
        parts[-1] += s.end
        while pairs := [(s.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in s.ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [s.ids[p] for p in parts]
    return out


def test_documents_have_as_many_as_a_plain_loop_finds(spark, sf_dir, ours, library):
    got = {r.doc_id: (r.tokens, r.over) for r in catalog.QUERIES["subword_budget"](spark, sf_dir).collect()}
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == len(docs)
    memo = {}
    for d in docs.itertuples():
        n = 2
        for w in (d.text or "").split():
            if w not in memo:
                memo[w] = plain(ours, w)
                assert memo[w] == library.encode(w, add_special_tokens=False).ids
            n += len(memo[w])
        assert got[d.doc_id] == (n, n > 77)
    assert {o for _, o in got.values()} == {True, False}


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeé中'1! \n", max_size=60))
def test_any_text(ours, library, text):
    assert ours.encode(text) == plain(ours, text) == library.encode(text, add_special_tokens=False).ids


def test_long_words_and_bounded_memory(ours, library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    ours.known.clear()
    word = "".join(random.Random(1).choices("etaoinshr", k=20_000))
    for text in (word, "a" * 30_000, " ".join(word[i : i + 6] for i in range(300))):
        assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(ours.known) <= 5


def test_letters_of_bytes():
    assert len(set(tokens.byte_letters())) == 256 and tokens.byte_letters()[ord("a")] == "a" and tokens.byte_letters()[0] == "Ā"


def test_ids_budget_and_nulls(spark, ours, monkeypatch):
    sent = tokens.merge_table(spark, PATH)
    d = spark.createDataFrame([(1, "Two words"), (2, None), (3, ""), (None, "x " * 80)], "id long, t string")
    got = {r.id: r.ids for r in tokens.token_ids(d, "t", sent, 49406, 49407).collect()}
    assert got[1] == [49406, *ours.encode("two words"), 49407] and got[2] == got[3] == [49406, 49407]
    n = tokens.token_counts(d, "t", sent)
    assert sorted(r.tokens for r in n.collect()) == [2, 2, 4, 82]
    assert len(tokens.refuse_overlong(n.where("id is not null"), "tokens", 77, "id").collect()) == 3
    with pytest.raises(Exception, match="text of null has 82 tokens, at most 77 fit"):
        tokens.refuse_overlong(n, "tokens", 77, "id").collect()
    monkeypatch.setattr(tokens, "TABLE_BYTES", 9)
    with pytest.raises(ValueError, match="larger"):
        tokens.merge_table(spark, PATH)
    assert json.loads(sent.value)["model"]["end_of_word_suffix"] == "</w>"
