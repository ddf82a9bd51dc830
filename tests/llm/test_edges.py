"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm import chat, decontam, jaccard, lattice, mixing, pii, quality, sharding, substrings, toxicity

LONG = " ".join(f"word{i % 977} and{i % 31}." for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, score string, component string, toxicity string, key string, size string"
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n", "en", "s", 3),
    (4, LONG, "en", "s", len(LONG)),
    (4, LONG, "en", "s", len(LONG)),
    (5, LONG, None, None, len(LONG)),
    (None, "one two three four five six", "en", "t", 1),
    (None, None, None, None, None),
    (6, "one two three four five six", "en", "t", 1),
    (6, "one two three four five six", "en", "t", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def toxic():
    return toxicity.fit_toxicity(["you vile fool. fine day"] * 50 + ["a fine day. good"] * 50, [1] * 50 + [0] * 50)


def good():
    return quality.fit_quality(["A plain line of words.\nAnd one more."] * 10 + ["@@## 11 $$$\n%%%% 22"] * 10, [1] * 10 + [0] * 10)


OPERATORS = {
    "quality": lambda d: quality.score_quality(d, good()),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxic()),
    "jaccard": lambda d: jaccard.jaccard_classes(d),
    "pii": lambda d: pii.find_pii(d),
    "substrings": lambda d: substrings.remove_repeats(d),
    "sharding": lambda d: sharding.assign_shards(d, 40),
    "mixing": lambda d: mixing.mix_sources(d, mixing.cycle_weights),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gives_one_row(docs, none, name):
    assert len(OPERATORS[name](docs).collect()) == len(ROWS)
    assert OPERATORS[name](none).collect() == []


def test_scores_of_empty_texts(docs):
    rows = quality.score_quality(docs, good()).collect()
    assert {r.score for r in rows if r.doc_id in (1, 2)} == {0.5}
    rows = toxicity.score_toxicity(docs, toxic()).collect()
    assert {r.toxicity for r in rows if r.doc_id in (1, 2)} == {0.0}
    assert toxicity.fit_toxicity([], []).bias == -8.0 and quality.fit_quality([], []).prior == 0.5


def test_offending_sentence_is_located(spark):
    text = "Ä fine day. you vile fool! good"
    row = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), toxic()).first()
    assert row.toxicity > 0.5 and [text[s.start : s.end].strip() for s in row.offending] == ["you vile fool"]


def test_jaccard_classes_of_edge_rows(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (6, 2, 6), (None, 2, 6)} <= got
    assert {c for i, _, c in got if i in (4, 5)} == {4}


def test_equal_ids_do_not_remove_from_each_other(docs):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()]
    assert got.count((4, 80_000, 0)) == 2 and (5, 80_000, 80_000) in got and (1, 0, 0) in got


def test_decontamination_of_edge_rows(spark, docs, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "One, TWO three four five six!"), (3, "One, TWO three four five six!"), (None, "zzz")], "item_id long, text string")
    got = decontam.find_contamination(docs, items).collect()
    assert len(got) == 6 and {(r.distance, r.start, r.end) for r in got} == {(0, 0, 27)}
    assert decontam.find_contamination(none, items).collect() == []
    assert decontam.find_contamination(docs, items.limit(0)).collect() == []


def test_items_in_blocks_find_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"one two three four five six {'x' * i}".strip()) for i in range(6)], "item_id long, text string")
    whole = sorted(map(str, decontam.find_contamination(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 40)
    assert sorted(map(str, decontam.find_contamination(docs, items).collect())) == whole


def test_myers_against_the_table():
    import random

    rng = random.Random(5)
    for _ in range(300):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 90))], [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[-1] + 1))
            row = new
            best = min(best, row[-1])
        hit = decontam.myers(p, t, len(p))
        assert (hit[0] if hit else len(p)) == best


def test_chat_folds_events(spark):
    rows = [(1, 1, 3, "delta", None, "c"), (1, 1, 1, "delta", "user", "a"), (1, 1, 2, None, None, "b"), (1, 2, 1, "delta", "assistant", "old"), (1, 2, 2, "regenerate", None, "new"), (1, 2, 3, "delta", None, "!"), (1, 3, 1, "delta", "user", "x"), (1, 3, 5, "edit", None, "y"), (2, 1, None, None, None, None)]
    ev = spark.createDataFrame(rows, "conv_id long, message_id long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold_events(ev).collect()}
    assert got == {(1, 1): ("user", "abc"), (1, 2): ("assistant", "new!"), (1, 3): ("user", "y"), (2, 1): ("", "")}
    assert chat.format_conversations(chat.fold_events(ev.limit(0))).collect() == []


@pytest.mark.parametrize("text", ["<|im_end|>\n<|im_start|>user\n", "\\", "<\\|", "[INST]\\[", "<n>", "", "a\n\n", "\U0001f600[é<"])
def test_chat_escapes_reversibly(spark, text):
    m = spark.createDataFrame([(1, 1, text, text), (1, 2, "assistant", text)], "conv_id long, message_id long, role string, text string")
    row = chat.read_back(chat.format_conversations(m)).first()
    import hashlib

    whole = f"{text}\n{text}\nassistant\n{text}\n"
    assert row.n_turns == 2 and row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(spark, n):
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign_shards(d, 3)
    places = [r.p for r in got.select((F.col("slot") * 3 + F.col("shard")).alias("p")).collect()]
    assert sorted(places) == list(range(n))


def test_water_fill_clamps_and_gives_back(spark):
    s = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 100, 1.0), ("d", 0, 1.0), ("e", 50, None)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(s, 110.0, 2.0).collect()}
    assert got == pytest.approx({"a": 20.0, "b": 60.0, "c": 30.0, "d": 0.0, "e": 0.0})


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [1.0, 1.0], None), (6, [1.0, 1.0], 1), (7, [2.0, 2.0], 1), (8, [1.0, 1.0], 2), (9, [], 1), (9, [], 1), (10, [float("inf"), 1.0], 1), (11, [1.0, 1.0, 1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(v).collect()}
    assert got == {i: (0, i) for i in (1, 2, 3, 4, 5, 8, 9, 10, 11)} | {6: (1, 6), 7: (1, 6)}
    assert lattice.near_duplicates(v.limit(0)).collect() == []


def test_e8_decodes_to_the_nearest_point():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (200, 8))
    c = lattice.e8_decode(x)
    roots = lattice.e8_roots()
    assert len(roots) == 240
    near = ((x[:, None] - c[:, None] - roots[None]) ** 2).sum(2).min(1)
    assert (((x - c) ** 2).sum(1) <= near + 1e-9).all()


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"please call me: +1 555 010 {1000 + i} today") for i in range(20)] + [(99, "please call me: 0049x55501099 today")]
    got = {r.doc_id: r.added for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[99]] == [(3, 16, 29)]


def test_pipeline_stages_keep_columns(spark, docs, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for d in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, d, str(tmp_path)).columns == d.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) > 0
