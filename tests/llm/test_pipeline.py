"""The whole pipeline against plain loops, row by row."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as p
from orbweave.llm import decontam, toxicity
from orbweave.llm.common import table, text_blocks
from tests.llm.test_contracts import WORD, classes, edits, fill, folded

CLEAN = "river stone table window garden morning letter people water paper music winter summer evening bridge market forest road house light".split()
VILE = "scum vermin filth".split()


def tables(spark, at, seed):
    rnd = random.Random(seed)
    say = lambda k: " ".join(rnd.choices(CLEAN, k=k))
    sentence = lambda k: " ".join(f"{rnd.choice(CLEAN)}{rnd.randrange(60)}" for _ in range(k))
    items = [sentence(rnd.randint(8, 14)) for _ in range(4)] + ["a short one"]
    docs, labels = [], []
    for i in range(240):  # labelled, told apart by vile words
        bad = i % 3 == 0
        docs.append((i, f"{say(6)}. {say(3)} {rnd.choice(VILE) if bad else say(1)} {say(3)}. {sentence(12)}", f"s{i % 5}"))
        labels.append((i, i % 2, int(bad)))
    base = [sentence(40) for _ in range(6)]
    for i in range(240, 330):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(CLEAN)
        docs.append((i, " ".join(w), rnd.choice(["s0", "s1", None])))
    for i in range(330, 360):
        w = rnd.choice(items).split()
        if rnd.random() < 0.5:
            w[rnd.randrange(len(w))] = "other"
        docs.append((i, f"{sentence(9)} {' '.join(w)} {sentence(7)}", "leaks"))
    docs += [(360, None, "s0"), (361, "", "s1"), (362, " \n", None), (363, "one", "s2")]
    rnd.shuffle(docs)
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs, items


def is_toxic(model, text):
    ((_, _, data, off),) = text_blocks(pa.array([text or ""]))
    z, *_ = model.sentences(data, off)
    return 1 - math.prod(1 - 1 / (1 + math.exp(-v)) for v in z) >= p.TOXIC


def first_of_copies(docs):
    sets = {}
    for i, t, _ in docs:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kind = classes(sorted(sets), links)
    return [d for d in docs if kind[d[0]] == d[0]]


def leaks(text, items):
    w = folded(text or "")
    for it in items:
        x = folded(it)
        if edits(x, w) <= decontam.budget(len(x), decontam.ERROR_RATE):
            return True
    return False


def mixed(docs):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    of = {}
    for i, _, s in docs:
        of.setdefault(s, []).append(i)
    sizes = {s: sum(size[i] for i in ids) for s, ids in of.items()}
    target, copies = fill(sizes), {}
    for s, ids in of.items():
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        quota, run = target[s] - whole * sizes[s], 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"11:{i}".encode()).hexdigest()):
            run += size[i]
            copies[i] = whole + (run - size[i] / 2 <= quota)
    return [d for d in docs for _ in range(copies[d[0]])]


def place(x, n, seed=7):
    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)
    turn = lambda half, r: int(hashlib.md5(f"{seed}:{r}:{half}".encode()).hexdigest()[:13], 16)
    while True:
        left, right = x % a, x // a
        for r in range(4):
            left, right = (left, (right + turn(left, r)) % b) if r % 2 else ((left + turn(right, r)) % a, right)
        x = left + right * a
        if x < n:
            return x


def sharded(docs):
    rows = []
    for i, t, _ in docs:
        raw = (t or "").encode()
        rows.append((hashlib.md5(str(i).encode()).hexdigest(), i, zlib.crc32(raw), len(raw) + 16))
    out = []
    for g, (_, i, crc, size) in enumerate(sorted(rows)):
        x = place(g, len(rows))
        out.append((i, size, crc, x % p.SHARDS, x // p.SHARDS))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_stages_together(spark, tmp_path, seed):
    at = str(tmp_path)
    docs, items = tables(spark, at, seed)
    d, labels = table(spark, at, "documents"), table(spark, at, "labels").selectExpr("doc_id", "toxic AS label")
    model = toxicity.train_toxicity(d, labels)
    clean = [x for x in docs if not is_toxic(model, x[1])]
    assert len(docs) - len(clean) >= 60 and sum(any(v in (t or "") for v in VILE) for _, t, _ in clean) <= 8
    once = first_of_copies(clean)
    assert len(clean) - len(once) >= 30
    unseen = [x for x in once if not leaks(x[1], items)]
    assert 10 <= len(once) - len(unseen) <= 40
    want = sharded(mixed(unseen))
    got = sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in p.run(spark, at).collect())
    assert len(np.unique([w[0] for w in want])) > 100 and got == want
