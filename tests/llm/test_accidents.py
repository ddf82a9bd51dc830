"""Results that once depended on accidents: other documents, repeated ids, names, lengths."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm import common, decontam, mixing, pii, quality, substrings, toxicity


def spans(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: [(s.start, s.end, s.kind) for s in r.added] for r in pii.find_pii(d).collect()}


def chain(prefix, links, seeds=6, more=6):
    """Texts in which a context of mails shares its codes with the next context, and so on."""
    rnd, out = random.Random(prefix), []
    codes = [[f"{prefix}{n}x{rnd.randrange(10**6):06d}" for _ in range(more)] for n in range(links + 1)]
    for n in range(links):
        x = chr(97 + n)  # digits of contexts are folded
        for i in range(seeds if n == 0 else 0):
            out += [f"note {prefix}{x} to{x} {prefix}{i}@mail.example end"] * 4
        for c in (codes[n] if n else []) + codes[n + 1][: 1 + (n > 0) * more]:
            out.append(f"note {prefix}{x} to{x} {c} end")
    return out


def test_spans_do_not_depend_on_other_documents(spark):
    """Ten documents hold "reach at" before a code; five of the codes follow a trusted context."""
    own = [f"please reach at zz{i}{i}{i}{i}{i} soon" for i in range(10)]
    own += [f"write to box pp{i}@mail.example soon" for i in range(30)] + [f"write to box zz{i}{i}{i}{i}{i} soon" for i in range(5)]
    other = chain("k", 5) + chain("m", 9) + [f"{w} text number {i}" for i, w in enumerate(["some", "more"] * 60)]
    alone, together = spans(spark, own), spans(spark, own + other)
    assert alone == {i: together[i] for i in alone}
    reverse = spans(spark, other + own)
    assert alone == {i: reverse[i + len(other)] for i in alone}
    assert any(alone[i] for i in range(30, 45)) and any(together[i] for i in range(len(own), len(together)))


def test_contexts_do_not_support_themselves(spark):
    """Seven of ten words after the context are mails: under the bound, whatever it finds itself."""
    rows = [f"go via w{i}@mail.example now" for i in range(7)] + [f"go via qq{i}{i}{i}{i}{i}{i} now" for i in range(3)]
    assert not any(spans(spark, rows).values())


def test_chains_of_contexts_are_followed_to_the_end(spark):
    texts, n = [], 12
    for k in range(n):
        x = chr(97 + k)
        for i in range(600):
            texts.append(f"say {x} to{x} c{k}x{i % 6}000{i % 6}1 end" if k else f"say a toa u{i}@mail.example end")
        texts += [f"say {x} to{x} c{k + 1}x{i}000{i}1 end" for i in range(6)]
    got = spans(spark, texts)
    assert all(got[i] for i, t in enumerate(texts) if "@" not in t)


def test_rows_of_one_id_are_taken_one_by_one(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(100)]
    for rows in ([(1, t, "s") for t in texts], [(1, texts[0], "s")] * 100, [(None, texts[0], "s")] * 100):
        d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        m = mixing.mix_sources(d, mixing.cycle_weights)
        taken = m.agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("t"), F.count("*").alias("n")).first()
        assert taken.n == 100 and abs(taken.t - 1500) <= 5
        assert m.columns == ["doc_id", "text", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies"]


@pytest.mark.parametrize("kind", ["string", "double", "decimal(9,1)"])
def test_ids_that_are_no_whole_numbers_raise(spark, kind):
    with pytest.raises(TypeError, match="whole numbers"):
        substrings.remove_repeats(spark.range(3).selectExpr(f"CAST(id AS {kind}) AS doc_id", "'a b' AS text"))


def test_a_column_named_like_metadata_stays(spark, tmp_path):
    text = " ".join(f"a{i}" for i in range(60))
    d = spark.createDataFrame([(1, text, "x"), (2, text, "y"), (3, "an own text", "z")], "doc_id long, text string, _metadata string")
    d.write.parquet(str(tmp_path / "d"))
    for docs in (d, spark.read.parquet(str(tmp_path / "d"))):
        got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
        assert got.columns == d.columns and sorted((r.doc_id, r[2]) for r in got.collect()) == [(1, "x"), (3, "z")]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    rnd = np.random.default_rng(4)
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    ends = np.unique(rnd.integers(0, 5001, 90))
    st, en = ends[:-1], np.maximum(ends[:-1] + 1, ends[1:] - rnd.integers(0, 3, len(ends) - 1))
    want = common.word_hashes(data, st, en)
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(common, "PIECE", piece)
        assert (common.word_hashes(data, st, en) == want).all()


@pytest.mark.parametrize("read", [quality.line_features, toxicity.sentence_words, decontam.folded_words])
@pytest.mark.parametrize("line", ["some words of a line, and then more of them 12 45.\n", "x"])
def test_a_text_of_50_mb_takes_30_bytes_a_byte(read, line):
    data = np.frombuffer((line * (50_000_000 // len(line))).encode(), np.uint8)
    tracemalloc.start()
    read(data, np.array([0, len(data)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(data)
