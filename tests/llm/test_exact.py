"""Operators against brute force where their rare paths are taken: common n-grams, hot
anchors, several fragments, second rounds, names that clash."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm import common, decontam, jaccard, lattice, mixing, pii, quality, substrings, toxicity
from tests.llm.test_contracts import WORD, classes


def corpus(seed, groups=6, copies=14, words=60, edits=3):
    """Texts in groups of near copies round a base, with a passage that all share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(16)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)] + passage
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    out += [" ".join(passage), "", "one two", "One TWO"]
    rng.shuffle(out)
    return out


def links_of(sets, num, den):
    ids = sorted(sets)
    return [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]


def shingles(text, k):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("light,fragment", [(2, 150), (1, 2_000_000)])
def test_jaccard_under_common_ngrams(spark, monkeypatch, light, fragment):
    texts = corpus(light)
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "FRAGMENT_GRAMS", fragment)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "MEETING_ROWS", 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, 4, 85, 100).collect()}
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    kind = classes(sets, links_of(sets, 85, 100))
    assert len(set(kind.values())) > 10
    assert got == {i: (len(s), kind[i]) for i, s in sets.items()}


def test_words_of_long_texts_go_piece_by_piece(monkeypatch):
    data = np.frombuffer(("Ab  cd " * 50 + "x" * 300 + " end").encode(), np.uint8)
    off = np.array([0, 0, 100, 100, len(data)])
    whole = common.hashed_words(data, off, fold=common.LOWER)
    monkeypatch.setattr(common, "PIECE", 16)
    for a, b in zip(whole, common.hashed_words(data, off, fold=common.LOWER)):
        assert (a == b).all()


def test_row_and_hash_pairs_that_tie_in_high_bits():
    r = np.array([1, 1, 1, 0, 1, 1])
    g = np.array([7, 5, 7, 9, 1 << 40, 5], np.uint64)
    got = jaccard.distinct_pairs(r, g)
    assert [x.tolist() for x in got] == [[0, 1, 1, 1], [9, 5, 7, 1 << 40]]


def kept_words(texts, size):
    words, owner = [WORD.findall(t or "") for t in texts], {}
    for i, w in enumerate(words):
        for a in range(len(w) - size + 1):
            owner.setdefault(tuple(w[a : a + size]), i)
    out = {}
    for i, w in enumerate(words):
        stay = [True] * len(w)
        for a in range(len(w) - size + 1):
            if owner[tuple(w[a : a + size])] < i:
                stay[a : a + size] = [False] * size
        out[i] = " ".join(x for x, s in zip(w, stay) if s)
    return out


def test_substrings_of_a_passage_in_every_document(spark, monkeypatch):
    texts = corpus(5, copies=8)
    monkeypatch.setattr(substrings, "FRAGMENT_WINDOWS", 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "hot_anchors", lambda *_: np.sort(substrings.window_runs(*_hashes(texts), 13)[2]))
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(docs, 13).collect()}
    assert got == kept_words(texts, 13)


def _hashes(texts):
    import pyarrow as pa

    (_, _, data, off), = common.text_blocks(pa.array(texts))
    _, _, row, h = common.hashed_words(data, off)
    return h, row


def test_hot_anchors_are_found(spark):
    line = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(f"{' '.join(f'{i}x{j}' for j in range(20))} {line}",) for i in range(200)], "text string")
    hot = substrings.hot_anchors(docs, 200, 13)
    shared = substrings.window_runs(*_hashes([line]), 13)[2]
    assert 0 < len(hot) < 200 and set(shared.tolist()) <= set(hot.tolist())


@pytest.mark.parametrize("width", [16, 64, 256, 768])
def test_lattice_recall_at_the_threshold(width):
    rng, n, c = np.random.default_rng(width), 800, 0.98
    x, e = rng.standard_normal((2, n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e -= (e * x).sum(1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    keys = [lattice.lattice_keys(v, lattice.BLOCKS, lattice.TABLES, lattice.PROBES, lattice.SCALE, lattice.SEED) for v in (x, c * x + (1 - c * c) ** 0.5 * e)]
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*keys)]) >= 0.98
    assert np.unique(keys[0], return_counts=True)[1].max() <= 0.02 * n


def test_lattice_counts_each_link_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3, 16))
    x = np.concatenate([b + 0.1 * rng.standard_normal((40, 16)) for b in base]).astype(np.float32)
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rows = [(i, v.tolist(), 1, "x", "y") for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls string, key string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(docs).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = u @ u.T >= 0.98
    np.fill_diagonal(hit, False)
    assert hit.sum() > 200
    assert sum(n for n, _ in got.values()) >= 0.98 * hit.sum() and all(got[i][0] <= hit[i].sum() for i in got)


def test_contexts_of_the_second_generation(spark):
    """A first context, found by base matches, discovers values; these make a second context
    trusted, which finds a value that nothing else does."""
    found = [f"{1000 + i}x55501{100 + i}" for i in range(8)]
    texts = [f"please call me: +1 555 010 {1000 + i} today" for i in range(100)]
    texts += [f"please call me: {v} today" for v in found] + [f"my new line {v} is open" for v in found]
    texts += ["then my new line 0049x999777 is open", "one other word 0049x888666 is not"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in pii.find_pii(docs).collect()}
    n = len(texts)
    assert got[n - 2] == ["0049x999777"] and got[n - 1] == [] and got[100] == [found[0]]


@pytest.mark.parametrize("text,start,want", [("a b c", 4, "a b"), ("a b xc", 5, "a b"), ("b c", 2, ""), ("", 0, ""), (" ".join(["Long" * 100, "B9\xa0x", "v"]), 406, "long" * 100 + " b0\xa0x"), ("é" * 200 + " q 1", 203, "é" * 200 + " q")])
def test_context_is_the_two_words_before(text, start, want):
    assert pii.left_context(text, start) == want


def test_context_totals_count_bigrams_before_a_word(spark):
    texts = ["Call me 5", "call ME", "call me call me x", None, "a call me\nb"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    import pyarrow as pa

    key = int(pii.context_keys(pa.array(["call me"]))[0])
    contexts = spark.createDataFrame([(key,), (12345,)], "context long")
    assert [(r.context, r.total) for r in pii.context_totals(docs, contexts).collect()] == [(key, 4)]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        u, t = rng.normal(size=n), rng.normal(size=(2, 2))
        p = np.zeros(n)
        total = 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(a * b for a, b in zip(u, y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += w
            p += w * np.array(y)
        both = np.concatenate([u, u])  # two chains in one block
        first = np.arange(2 * n) % n == 0
        got, _ = quality.marginals(both, t, first)
        assert np.allclose(got, np.concatenate([p, p]) / total)


def test_noisy_or_against_a_plain_loop(spark):
    model = toxicity.fit_toxicity(["you vile fool. fine day"] * 50 + ["a fine day. good"] * 50, [1] * 50 + [0] * 50)
    texts = ["you vile fool. a day! vile", "good day", "fool\nfool\nfool", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    import pyarrow as pa

    for r in toxicity.score_toxicity(docs, model).collect():
        (_, _, data, off), = common.text_blocks(pa.array([r.text])) if r.text else [(0, 1, np.zeros(0, np.uint8), np.zeros(2, np.int64))]
        miss = 1.0
        for z in model.sentences(data, off)[0]:
            miss *= 1 - 1 / (1 + np.exp(-z))
        assert r.toxicity == pytest.approx(1 - miss)


def test_names_that_clash_come_back_as_they_were(spark, sf_dir):
    d = spark.createDataFrame([(1, "a b c", "s", "u")] * 3, "doc_id long, text string, source string, mix_source_ string")
    for c in ("mix_upto_", "mix_whole_", "mix_size", "mix_copies", "copy_", "copy", "c0", "row", "toxic_score", "toxic_score_", "row_"):
        d = d.withColumn(c, F.lit("u"))
    mixed = mixing.mix_sources(d, mixing.cycle_weights)
    assert mixed.select("mix_source_", "mix_upto_", "mix_whole_").distinct().collect() == [("u", "u", "u")]
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.mix):
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns
        assert {tuple(r)[3:] for r in out.collect()} == {("u",) * (len(d.columns) - 3)}


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """The deciding stages, each on its own input with null and repeated ids."""
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    texts = corpus(9, groups=3, copies=5, words=90, edits=2)
    leak = f"before {items.text[0]} after"
    rows = [(i if i % 7 else None, t, "s") for i, t in enumerate(texts)] + [(None, leak, "s"), (3, leak, None), (3, "plain words of one more text here", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sets = {n: shingles(t, 5) for n, (_, t, _) in enumerate(rows)}
    kind = classes(sets, links_of(sets, 80, 100))
    got = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).toPandas()
    assert len(got) == len(set(kind.values()))
    group = {t: kind[n] for n, (_, t, _) in enumerate(rows)}
    assert sorted(group[t] for t in got.text) == sorted(set(kind.values()))
    least = {}
    for n, (i, _, _) in enumerate(rows):
        least.setdefault(kind[n], []).append((i is None, i or 0))
    for i, t in zip(got.doc_id, got.text):
        assert (bool(np.isnan(i)), 0 if np.isnan(i) else i) == min(least[group[t]])
    clean = corpus_pipeline.drop_leaks(spark, docs, sf_dir).toPandas()
    assert sorted(clean.text) == sorted(t for _, t, _ in rows if t != leak)


def test_equal_items_are_matched_once_and_reported_each(spark):
    items = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight y")], "doc_id long, text string")
    got = decontam.find_contamination(docs, items).collect()
    assert sorted(r.item_id for r in got) == list(range(40))


def test_chat_of_null_order_null_ids_and_clashing_names(spark, tmp_path):
    """Null turns come first; rows without a conv_id are one conversation; a long text whole."""
    import hashlib

    long = "<|x [y] \\z\n" * 20_000
    rows = [(1, 2, "assistant", "b"), (1, None, "user", "a"), (1, 2, "assistant", "b"), (None, 1, "user", "q"), (None, 0, "assistant", None), (2, 0, "assistant", long)]
    d = spark.createDataFrame([(*r, *["u"] * 6) for r in rows], "conv_id long, turn long, role string, text string, head string, body string, seq string, kind string, position string, e string")
    d.write.parquet(str(tmp_path / "conversations.parquet"))
    from orbweave.llm.chat import op1_chat_formatting

    got = {r.conv_id: r for r in op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None, -7}
    want = "user\na\nassistant\nb\nassistant\nb\n"
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest() and got[None].n_turns == 2
    assert got[None].turns_sha256 == hashlib.sha256(b"assistant\n\nuser\nq\n").hexdigest()
    assert got[2].loss_chars == len(long) and got[2].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_scores_and_leaks_of_a_text_longer_than_a_block(spark, sf_dir):
    """A text of 3 MB goes whole through each operator that reads words."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    long = "".join(f"Line {i} has its own words {i * 7} here.\n" for i in range(80_000)) + item.text + "\nYou vile fool!"
    assert len(long) > 3_000_000
    d = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    hits = decontam.find_contamination(d, spark.createDataFrame([(item.item_id, item.text)], "item_id long, text string")).collect()
    assert [(r.distance, long[r.start : r.end] in item.text) for r in hits] == [(0, True)] * 2
    model = toxicity.fit_toxicity(["you vile fool. fine day"] * 50 + ["a fine day. good"] * 50, [1] * 50 + [0] * 50)
    row = toxicity.score_toxicity(d, model).first()
    assert row.toxicity > 0.5 and [long[s.start : s.end].strip() for s in row.offending] == ["You vile fool"]
    fit = quality.fit_quality(["A plain line of words.\nAnd one more."] * 10 + ["@@## 11 $$$\n%%%% 22"] * 10, [1] * 10 + [0] * 10)
    assert len({r.score for r in quality.score_quality(d, fit).collect()}) == 1
    assert [(r.component_id, r.n_shingles > 400_000) for r in jaccard.jaccard_classes(d).collect()] == [(1, True)] * 2
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(d).collect()}
    assert got[1][1] == 0 and got[2][0] == got[2][1] == len(WORD.findall(long))
