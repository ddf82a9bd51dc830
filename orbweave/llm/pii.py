"""Personal data by patterns and by bootstrapped contexts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import LOWER, U64, cut, few, gram_hashes, hashed_words, table, text_blocks

KINDS = ("email", "ip", "card", "phone")
#: Distinct scored instances of a trusted context, and the least score of one.
MIN_SEEDS, MIN_CONFIDENCE = 5, 0.8
#: Bits of the filter that says which pairs of words may be contexts.
FILTER_BITS = 1 << 22
#: Contexts are compared with A-Z in lower case and digits as 0.
FOLD = LOWER.copy()
FOLD[48:58] = 48

# The patterns of the contract. A match starts where its run of characters
# starts, or where the match before it ended.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^ \t-\r]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def identifier_like(token: str) -> bool:
    return len(token) >= 6 and sum("0" <= c <= "9" for c in token) >= 4 or "@" in token[1:-1]


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def left_context(text: str, start: int) -> str:
    """The two whole words before the word in which a value starts, A-Z in lower case and
    digits as 0; empty if there are fewer. Words end at ASCII blanks."""
    reach = 64
    while True:
        low = max(0, start - reach)
        words = _TOKEN.findall(text, low, start)
        inside = start > 0 and _TOKEN.match(text[start - 1])
        if not low or len(words) > 3:  # the first word may be cut
            words = words[: len(words) - bool(inside)]
            return " ".join(words[-2:]).translate(_FOLD) if len(words) >= 2 else ""
        reach *= 8


def context_keys(contexts) -> np.ndarray:
    """The 64-bit hash of the two words of each context; 0 of an empty one."""
    out = np.zeros(len(contexts), np.int64)
    for i, j, data, off in text_blocks(contexts):
        _, _, row, h = hashed_words(data, off)
        g, ok = gram_hashes(h, row, 2)
        out[i + row[: len(g)][ok]] = g[ok].view(np.int64)
    return out


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base spans, and candidates with context and value; no text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,kind:int,context:long,value:long>>"

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        near = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("context", pa.int64()), ("value", pa.int64())]))
        for batch in batches:
            base, found, before = [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                spans = base_spans(text)
                cands = [(s, e, k) for s, k, e in spans]
                if _DIGIT.search(text) or "@" in text:
                    taken = sorted((s, e) for s, _, e in spans)
                    j = 0
                    for m in _TOKEN.finditer(text):
                        if not identifier_like(m[0]):
                            continue
                        while j < len(taken) and taken[j][1] <= m.start():
                            j += 1
                        if not any(s < m.end() and e > m.start() for s, e in taken[j : j + 4]):
                            tok = m[0].rstrip(".,;:!?)\"'")
                            cands.append((m.start(), m.start() + len(tok), None))
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                before += [left_context(text, s) for s, _, _ in cands]
                found.append([{"start": s, "end": e, "kind": k, "value": value_key(text[s:e])} for s, e, k in cands])
            keys = iter(context_keys(pa.array(before, pa.string())).tolist())
            for f in (f for row in found for f in row):
                f["context"] = next(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(found, near)], names=["doc_id", "base", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_")).mapInArrow(run, schema)


def value_key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def context_totals(docs: DataFrame, contexts: DataFrame, text_col: str = "text") -> DataFrame:
    """(context, total): how often each of `contexts` occurs before any word at all.

    Tasks get a filter of FILTER_BITS bits, whatever the number of contexts; what passes is
    counted by hash and joined with the contexts themselves.
    """
    bit = F.pmod("context", F.lit(FILTER_BITS))
    words = contexts.groupBy((bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(context, 64)))")).alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # at most FILTER_BITS / 64 rows
        bits[r["w"]] = r["b"]
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import pyarrow as pa

        known = np.unpackbits(sent.value.view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for _, _, data, off in text_blocks(batch.column(0)):
                _, _, row, h = hashed_words(data, off, fold=FOLD)
                g, _ = gram_hashes(h, row, 2)
                g = g[: max(0, len(h) - 2)][row[:-2] == row[2:]] if len(h) > 2 else g[:0]
                key, n = np.unique(g[known[(g & U64(FILTER_BITS - 1)).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["context", "total"])

    seen = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "context long, total long")
    return seen.groupBy("context").agg(F.sum("total").alias("total")).join(contexts, "context", "left_semi")


def trusted_contexts(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(context, kind) of contexts that announce identifiers, from the pattern-instance graph.

    Instances are values. Base matches are seeds: they score 1 and keep their kind for good.
    Any other instance scores as much as its best trusted context, and takes its kind. In
    each round the contexts that aren't trusted yet score the sum of their instances' scores
    over all words that follow them anywhere in the corpus; one that has MIN_SEEDS distinct
    scored instances and reaches MIN_CONFIDENCE is trusted from then on, with that score and
    the commonest kind of those instances. So instances that one context discovers can make
    another one trusted, but no context supports itself. Rounds end when one adds no
    context: nothing that a context scores by can change after that, whatever else is in
    the corpus, and there are at most as many rounds as trusted contexts.
    """
    edges = found.where("context <> 0").groupBy("context", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    wide = cut(edges.groupBy("context").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= MIN_SEEDS).select("context"))
    graph = edges.join(wide, "context", "left_semi").join(context_totals(docs, wide, text_col), "context")
    graph = cut(graph.select("context", "value", "n", "total", "kind"))
    trusted, count = graph.select("context", F.lit(0.0).alias("p"), "kind").limit(0), 0
    while True:
        known = few(trusted, count)
        best = graph.join(known.select("context", "p", F.col("kind").alias("as")), "context").groupBy("value").agg(F.max(F.struct("p", "as")).alias("best"))
        open_ = graph.join(known, "context", "left_anti").join(best, "value", "left")
        s = F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("best.p", F.lit(0.0)))
        scored = open_.select("context", "n", "total", s.alias("s"), F.coalesce("kind", "best.as").alias("kind"))
        by_context = scored.groupBy("context").agg(F.least(F.lit(1.0), F.sum(F.col("n") * F.col("s")) / F.max("total")).alias("p"), F.count(F.when(F.col("s") > 0, 1)).alias("known"), F.mode(F.when(F.col("s") > 0, F.col("kind")), True).alias("kind"))
        new = cut(by_context.where((F.col("known") >= MIN_SEEDS) & (F.col("p") >= MIN_CONFIDENCE)).select("context", "p", "kind"))
        more = new.count()
        if not more:
            return few(trusted.select("context", "kind"), count)
        trusted, count = cut(trusted.union(new), count + more), count + more


def span_string(c: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of struct<start, kind, end>, in order, code points.

    `base` holds the pattern matches. `added` holds identifier-like words, none over a base
    match, that follow a trusted context (see trusted_contexts; repeated rows count each).
    Null text is empty; every row of `docs` gives one row, repeated and null ids too. Texts
    and values of any length are read whole. An empty table gives no rows; columns besides
    id and text are not read.
    """
    e = cut(entities(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    found = e.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    trusted = trusted_contexts(docs, found, text_col).select("context", F.col("kind").alias("k"))
    more = found.where("kind is null").join(trusted, "context").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", F.col("k").alias("kind"), "end"))).alias("added"))
    out = e.join(more, "rid", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.slice("base", 1, 0)).alias("added"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = find_pii(table(spark, sf_dir, "documents"))
    by = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return p.select("doc_id", *by, F.sha2(span_string(F.col("base")), 256).alias("base_sha256"), span_string(F.sort_array(F.concat("base", "added"))).alias("spans"))


def _is(i: int):
    return lambda k: k == i
