"""Conversation repair against a search that carries whole audit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm import repair
from orbweave.llm.queries import QUERIES
from tests.llm.test_contracts import sha

WORD = re.compile(r"[^\x20\x09-\x0D]")


def first_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) by Dijkstra over (row, state); a state is the last role initial
    ("": none). Strings are compared whole."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        to = [(5, "I", i, r) for r in follows[last] if r in "ua"]
        if i < len(rows):
            to.append((2, "D", i + 1, last))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                initial = rows[i][0][:1]
                if initial and initial in follows[last]:
                    to.append((more, "K", i + 1, initial))
                to += [(1 + more, "R", i + 1, r) for r in follows[last] if r in "ua"]
        for more, letter, n, state in to:
            heapq.heappush(heap, (cost + more, audit + letter, n, state))


def replay(rows, audit):
    out, i, names = [], 0, {"u": "user", "a": "assistant"}
    for e in audit:
        last = out[-1][0][:1] if out else ""
        fits = names[{"": "u", "s": "u", "u": "a", "a": "u"}[last]]
        if e == "I":
            out.append((fits, ""))
            continue
        if e == "K":
            out.append(rows[i])
        elif e == "R":
            out.append((fits, rows[i][1]))
        i += 1
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return out


def expected(turned):
    """The report of (turn, role, text) rows in order."""
    rows = [(r, t) for _, r, t in turned]
    faults = first_faults(rows)
    cost, audit = cheapest(rows, faults)
    turns = [t for t, _, _ in turned if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in replay(rows, audit)))


def order(rows):
    mark = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, mark(x[1], x[2])))


def damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if c == 1:
        text = ""
    if c == 2:
        text = re.sub("[.!?]", "", text)
    if c == 4:
        role = "user"
    return [(turn, role, text)] * (0 if c == 0 else 2 if c == 3 else 1)


def reports(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_rows(spark, sf):
    got = reports(QUERIES["op13_conversation_repair"](spark, f"/root/testdata/{sf}"))
    conv = pd.read_parquet(f"/root/testdata/{sf}/conversations.parquet")
    want = {c: expected(order([y for x in part.itertuples() for y in damage(c, x.turn, x.role, x.text)])) for c, part in conv.groupby("conv_id")}
    assert got == want and len({w[6] for w in want.values()}) > 10


def test_op13_nulls_and_ties(spark, tmp_path):
    rnd, rows = random.Random(8), []
    for c in [None, *range(60)]:
        for _ in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([None, None, 1, 2, 3, 9, -4]), rnd.choice([None, "user", "assistant", "system", "tool", "", "User"]), rnd.choice([None, "", " \t", "yes.", "yes.", "no", "what?  ", "é中"])))
    rows.append((next(c for c in range(100, 400) if not damage(c, 1, "user", "x")), 1, "user", "x"))
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = reports(QUERIES["op13_conversation_repair"](spark, str(tmp_path)))
    by: dict = {}
    for c, *rest in rows:
        by.setdefault(c, []).extend(damage(c, *rest))
    assert got == {c: expected(order(x)) for c, x in by.items()}
    assert (0, 0, 0, 0, 0, 0, "", sha("")) in got.values()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert reports(QUERIES["op13_conversation_repair"](spark, str(tmp_path / "none"))) == {}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x"]), st.sampled_from([None, "blank", "truncated"])), max_size=14), st.integers(1, 5))
def test_ranks_give_the_least_audit(rows, size):
    faults = [f for _, f in rows]
    kinds = [{"s": 1, "u": 2, "a": 3}.get(r[0], 0) + {"blank": repair.MUST_GO, "truncated": repair.CUT_SHORT}.get(f, 0) for r, f in rows]
    blocks = [kinds[i : i + size] for i in range(0, len(kinds), size)]
    between, cost = repair.join_blocks([repair.summary(b) for b in blocks])
    audit = "".join(repair.CODES[n] for b, x, y in zip(blocks, between, between[1:]) for _, n in repair.trace(b, x, y))
    audit += "I" * repair.CLOSING[between[-1]]
    assert (cost, audit) == cheapest([(r, "") for r, _ in rows], faults)


def test_long_conversations_go_by_blocks(spark, monkeypatch):
    """One conversation holds most rows, one of its texts half of them."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    rnd = random.Random(2)
    rows = [(7, n, rnd.choice(["user", "assistant"]), rnd.choice(["again.", f"n{n}.", f"n{n}", ""])) for n in range(700)]
    rows += [(c, n, "user", f"{c} {n}.") for c in range(8, 40) for n in range(3)] + [(7, 3, "user", "again.")] * 40
    rnd.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumn("place", F.lit("x"))
    by: dict = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    done = repair.repair_turns(d)
    assert reports(repair.conversation_reports(done)) == {c: expected(order(x)) for c, x in by.items()}
    assert done.count() == len(rows)
    assert repair.repair_turns(d.limit(0)).collect() == []


def test_long_texts_and_names(spark):
    long = "word " * 400_000
    d = spark.createDataFrame([("a.b", 1, "user", long + "!"), ("a.b", 2, "assistant", long + "."), ("a.b", 3, "user", None)], "c string, t int, r string, x string")
    r = repair.conversation_reports(repair.repair_turns(d, "c", "t", "r", "x")).first()
    assert (r.conv_id, r.truncated, r.blank, r.audit, r.cost) == ("a.b", 0, 1, "KKD", 2)
