"""Each registered query against a brute-force version of its contract."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from orbweave.llm import decontam
from orbweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def result(name, spark, sf_dir):
    return QUERIES[name](spark, sf_dir).toPandas()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def classes(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1_turns_and_loss_survive_the_round_trip(spark, sf_dir):
    got = result("op1_chat_formatting", spark, sf_dir).set_index("conv_id")
    conv = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    probe = "</s>[INST] ok [/INST]"
    conv = pd.concat([conv, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [probe, probe]})])
    assert len(got) == conv.conv_id.nunique()
    for cid, part in conv.groupby("conv_id"):
        part = part.sort_values(["turn", "role", "text"]).fillna({"text": ""})
        loss = "".join(part[part.role == "assistant"].text)
        row = got.loc[cid]
        assert row.n_turns == len(part)
        assert row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in zip(part.role, part.text)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))


def auc(score, label):
    order = score.rank()
    pos = label == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return (order[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("name,column,folds,out,least", [("op2_quality", "quality", 5, 0, 0.9), ("op3_toxicity", "toxic", 4, 2, 0.85)])
def test_classifiers_on_held_out_documents(spark, name, column, folds, out, least):
    sf = "/root/testdata/sf0.1"
    got = result(name, spark, sf)
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % folds == out)
    assert (held == got.held_out).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    m = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert auc(m.score, m[column]) >= least


def edits(pattern, text):
    """Least edits of the pattern to any stretch of the text."""
    prev = np.zeros(len(text) + 1, int)
    t = np.array(text)
    for i, c in enumerate(pattern, 1):
        cur = np.minimum(prev[1:] + 1, prev[:-1] + (t != c)).tolist()
        row = [i]
        for x in cur:
            row.append(min(x, row[-1] + 1))
        prev = np.array(row)
    return int(prev.min())


def folded(text):
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub("[À-ÖØ-Þ]", lambda m: m[0].lower(), text).encode().lower())]


def test_op4_every_item_within_its_budget(spark, sf_dir, docs):
    got = result("op4_decontamination", spark, sf_dir)
    found = {(r.doc_id, r.item_id): r.distance for r in got.itertuples()}
    assert len(found) == len(got)
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    texts = {d.doc_id: folded(d.text or "") for d in docs.itertuples()}
    shown = 0
    for it in items.itertuples():
        w = folded(it.text)
        k = decontam.budget(len(w), decontam.ERROR_RATE)
        for i, t in texts.items():
            if len(t) + k < len(w) or len(set(w) & set(t)) < (len(set(w)) - k) * 0.5:
                assert (i, it.item_id) not in found
                continue
            e = edits(w, t)
            assert (e <= k) == ((i, it.item_id) in found), (i, it.item_id, e, k)
            if e <= k:
                shown += 1
                assert found[i, it.item_id] == e
    assert shown == len(found) > 0


def test_op5_components(spark, sf_dir, docs):
    got = result("op5_ngram_jaccard", spark, sf_dir).set_index("doc_id")
    sets = {}
    for d in docs.itertuples():
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(d.text or "")]
        sets[d.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                links.append((a, b))
    assert links
    kind = classes(ids, links)
    for i in ids:
        assert got.loc[i].n_shingles == len(sets[i]) and got.loc[i].component_id == kind[i]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                d = [int(c) for c in reversed(digits)]
                total = sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])
                if not 12 <= len(d) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_op6_base_spans(spark, sf_dir, docs):
    got = result("op6_pii", spark, sf_dir).set_index("doc_id")
    assert len(got) == len(docs)
    for d in docs.itertuples():
        want = base(d.text or "")
        row = got.loc[d.doc_id]
        assert row.base_sha256 == sha(",".join(want))
        assert set(want) <= set(row.spans.split(",")) or not want
        for k in PATTERNS:
            assert row[f"n_{k}"] == sum(w.startswith(k + ":") for w in want)


def test_op7_words_that_stay(spark, sf_dir, docs):
    got = result("op7_substring_dedup", spark, sf_dir).set_index("doc_id")
    words = {d.doc_id: WORD.findall(d.text or "") for d in docs.itertuples()}
    least = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][s : s + 13]), i)
    removed = 0
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 12):
            if least[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        removed += gone.sum()
        assert tuple(got.loc[i][["n_words", "n_removed", "kept_sha256"]]) == (len(w), gone.sum(), sha(kept))
    assert removed


def test_op8_shards(spark, sf_dir, docs):
    got = result("op8_sharding", spark, sf_dir)
    assert sorted(got.doc_id) == sorted(docs.doc_id) and set(got.law) == {"rows"}
    m = got.merge(docs, on="doc_id")
    assert (m["size"] == m.text.map(lambda t: len((t or "").encode()) + 16)).all()
    assert (m.text_crc32 == m.text.map(lambda t: zlib.crc32((t or "").encode()))).all()
    counts = got.shard.value_counts().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert result("op8_sharding", spark, sf_dir).sort_values("doc_id").reset_index(drop=True).equals(got.sort_values("doc_id").reset_index(drop=True))


def fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: left * weight[s] / total for s in order if s not in capped} if total else {}
        over = [s for s in target if target[s] > 2 * sizes[s]]
        if not over:
            return target | {s: 2.0 * sizes[s] for s in capped}
        for s in over:
            capped.add(s)
            left -= 2 * sizes[s]


def test_op9_targets_and_takes(spark, sf_dir, docs):
    got = result("op9_mixing", spark, sf_dir).merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert len(got) == len(docs)
    assert (got["size"] == got.text.map(lambda t: len(WORD.findall(t or "")))).all()
    sizes = got.groupby("source")["size"].sum().to_dict()
    target = fill(sizes)
    for s, part in got.groupby("source"):
        assert (part.source_size == sizes[s]).all() and np.allclose(part.target, target[s])
        assert abs(part.taken.sum() - target[s]) <= part["size"].max()
    assert (got.taken <= 2 * got["size"]).all()


def test_op10_links(spark, sf_dir, tmp_path):
    v = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    x, rng = np.stack(v.embedding).astype(np.float32), np.random.default_rng(3)
    noise = rng.standard_normal((3, *x.shape)) * np.array([0.01, 0.02, 0.026])[:, None, None]
    x = np.concatenate([x, x[:100], *(x + noise).astype(np.float32)])
    v = pd.DataFrame({"vec_id": rng.permutation(len(x)), "embedding": list(x), "label": np.concatenate([v.label, v.label[:100], *[v.label] * 3])})
    v.to_parquet(tmp_path / "embeddings.parquet")
    got = result("op10_embedding_near_dedup", spark, str(tmp_path)).set_index("vec_id")
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    sim = (x @ x.T >= 0.98) & (v.label.to_numpy()[:, None] == v.label.to_numpy())
    np.fill_diagonal(sim, False)
    assert sim.sum() > 1000 and got.n_links.sum() >= 0.95 * sim.sum()
    ids = v.vec_id.tolist()
    kind = classes(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(sim)) if a < b])
    assert sum(got.loc[i].component_id == kind[i] for i in ids) >= 0.95 * len(ids)
    assert all(got.loc[i].n_links <= n for i, n in zip(ids, sim.sum(1)))
    assert (got.kept == (got.index == got.component_id)).all()


def test_pipeline_keeps_and_drops(spark, sf_dir, docs):
    import corpus_pipeline as p
    from orbweave.llm.common import table

    at = table(spark, sf_dir, "documents")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, at, sf_dir)
        assert out.columns == at.columns, name
    got = p.run(spark, sf_dir).toPandas()
    assert set(got.doc_id) <= set(docs.doc_id) and got.shard.between(0, 39).all()
    counts = got.shard.value_counts().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1
