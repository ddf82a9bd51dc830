"""Spans that contexts add, against plain loops over whole texts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from orbweave.llm import pii
from tests.llm.test_contracts import base

KINDS = ["email", "ip", "card", "phone"]
TOKEN = re.compile(r"[^ \t-\r]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def context(text, start):
    """The two words before the one that holds `start`."""
    words = [m for m in TOKEN.finditer(text) if m.end() <= start]
    return " ".join(m[0] for m in words[-2:]).translate(FOLD) if len(words) >= 2 else ""


def candidates(text):
    found = []
    for s in base(text):
        kind, a, b = s.split(":")
        found.append((int(a), int(b), KINDS.index(kind)))
    covered = [(a, b) for a, b, _ in found]
    for m in TOKEN.finditer(text):
        digits = sum(c in "0123456789" for c in m[0])
        if (len(m[0]) >= 6 and digits >= 4 or "@" in m[0][1:-1]) and not any(a < m.end() and b > m.start() for a, b in covered):
            word = m[0].rstrip(".,;:!?)\"'")
            found.append((m.start(), m.start() + len(word), None))
    return found


def added(texts):
    edges, totals, per = defaultdict(lambda: [0, None]), Counter(), []
    for t in texts:
        words = [w.translate(FOLD) for w in TOKEN.findall(t)]
        totals.update(" ".join(w) for w in zip(words, words[1:], words[2:]) for w in [w[:2]])
        here = [(a, b, k, context(t, a), t[a:b]) for a, b, k in candidates(t)]
        per.append(here)
        for _, _, k, c, v in here:
            if c:
                e = edges[c, v]
                e[0] += 1
                e[1] = k if e[1] is None else e[1] if k is None else max(e[1], k)
    by_context = defaultdict(dict)
    for (c, v), (n, k) in edges.items():
        by_context[c][v] = (n, k)
    trusted = {}
    while True:
        best = {}
        for c, (p, k) in trusted.items():
            for v in by_context[c]:
                best[v] = max(best.get(v, (0.0, -1)), (p, k))
        new = {}
        for c, values in by_context.items():
            if c in trusted or len(values) < pii.MIN_SEEDS:
                continue
            scored = [(n, 1.0, k) if k is not None else (n, *best[v]) for v, (n, k) in values.items() if k is not None or v in best]
            p = min(1.0, sum(n * s for n, s, _ in scored) / totals[c])
            if len(scored) >= pii.MIN_SEEDS and p >= pii.MIN_CONFIDENCE:
                kinds = Counter(k for _, _, k in scored)
                new[c] = (p, min(k for k in kinds if kinds[k] == max(kinds.values())))
        if not new:
            break
        trusted |= new
    return [sorted((a, trusted[c][1], b) for a, b, k, c, _ in here if k is None and c in trusted) for here in per], trusted


@pytest.mark.parametrize("seed", range(4))
def test_added_spans(spark, seed):
    rnd = random.Random(seed)
    heads = [f"{a} {b}" for a in ("mail to", "call me", "Box NO", "id 12") for b in ("", "now")]
    codes = [f"{rnd.choice('abc')}{rnd.randrange(10**5, 10**6)}" for _ in range(30)]

    def value():
        return rnd.choice([f"u{rnd.randrange(60)}@mail.example", f"+49 {rnd.randrange(10**8, 10**9)}", f"10.0.0.{rnd.randrange(256)}", rnd.choice(codes), rnd.choice(codes) + "."])

    texts = []
    for _ in range(260):
        h = rnd.choice(heads)
        pick = value() if h.startswith(("call", "id")) else rnd.choice([f"u{rnd.randrange(60)}@mail.example"] * 40 + codes[:6])
        texts.append(f"{rnd.choice(['Some words', 'é 中', ''])} {h} {pick} {rnd.choice(['and', 'x@', '12345'])} {rnd.choice(['see also', 'or else', 'mail to'])} {rnd.choice([pick] * 9 + ['nothing'] * (seed % 2))}")
    texts += ["", " ", "1 2", "a b 123456"]
    want, trusted = added(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.added) for r in pii.find_pii(d).collect()}
    assert got == dict(enumerate(want)) and trusted and any(want)
