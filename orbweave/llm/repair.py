"""Conversation structure repair: the cheapest edits that make turns alternate, with ranks in
place of audit strings.

A conversation is legal if its role initials are `(s?(ua)+)?`. A macro edit of a row is a run
of inserted turns and then what becomes of the row: (D)elete, (K)eep or (R)erole. Its code,
such as "IIK", is never the beginning of another one, so audits of as many rows compare code by
code. A layer of the search holds, for each state of the grammar, the least cost and the rank
of its audit among the layer's audits; the next layer compares (rank before, code), and
pointers lead back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or reroled turn is after each state; turns that may be kept there.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
KEPT = LEGAL | {(START, SYSTEM), (START, USER)}
#: Number of inserts that end a conversation from each state.
CLOSING = (0, 2, 1, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Codes of macro edits in ASCII order. A third insert would lead back to an earlier state.
CODES = sorted("I" * n + e for n in range(3) for e in "DKR")
#: A row's kind is the state of its role's initial (0: none), plus these.
MUST_GO, CUT_SHORT = 4, 8
#: Rows of a block: searched for all states it may begin in, and traced back, by itself.
BLOCK_BITS = 12

Layer = tuple  # for each state None or (cost, rank); costs are less by the layer's least
_steps: dict[tuple[Layer, int], tuple[Layer, int, tuple]] = {}


def ranked(best: dict[int, tuple[int, tuple]]) -> tuple[Layer, int]:
    """The layer of {state: (cost, what its audit compares by)}, and what its costs are less."""
    least = min(cost for cost, _ in best.values())
    order = {key: rank for rank, key in enumerate(sorted(key for _, key in best.values()))}
    return tuple((best[s][0] - least, order[best[s][1]]) if s in best else None for s in range(4)), least


def step(layer: Layer, kind: int) -> tuple[Layer, int, tuple]:
    """(next layer, cost it is less by, pointers): for each state (state before, code)."""
    known = _steps.get((layer, kind))
    if known:
        return known
    turn, free = kind & 3, not kind & MUST_GO
    short = TRUNCATED if kind & CUT_SHORT else 0
    best: dict[int, tuple[int, tuple]] = {}
    back: list = [None] * 4
    for before, at in enumerate(layer):
        for number, code in enumerate(CODES if at else ()):
            state, cost = before, at[0] + INSERT * (len(code) - 1)
            for _ in code[1:]:
                state = NEXT[state]
            if code[-1] == "D":
                cost += DELETE
            elif not free or code[-1] == "K" and (state, turn) not in KEPT:
                continue
            else:
                state, cost = (turn, cost + KEEP + short) if code[-1] == "K" else (NEXT[state], cost + REROLE + short)
            if state not in best or (cost, (at[1], number)) < best[state]:
                best[state], back[state] = (cost, (at[1], number)), (before, number)
    now, least = ranked(best)
    _steps[layer, kind] = now, least, tuple(back)
    return _steps[layer, kind]


def begin(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def summary(kinds: list[int]) -> list[Layer]:
    """For each state that a block may begin in, its last layer with whole costs."""
    out = []
    for state in range(4):
        layer, cost = begin(state), 0
        for k in kinds:
            layer, more, _ = step(layer, k)
            cost += more
        out.append(tuple(x and (x[0] + cost, x[1]) for x in layer))
    return out


def trace(kinds: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """(state before, code) of each row of a block that leads from one state to another."""
    layer, pointers = begin(first), []
    for k in kinds:
        layer, _, back = step(layer, k)
        pointers.append(back)
    out = []
    for back in reversed(pointers):
        last, code = back[last]
        out.append((last, code))
    return out[::-1]


def join_blocks(summaries: list[list[Layer]]) -> tuple[list[int], int]:
    """The states between the blocks of a conversation, and the least cost of all of it."""
    layer, spent, pointers = begin(START), 0, []
    for block in summaries:
        best: dict[int, tuple[int, tuple]] = {}
        back: list = [None] * 4
        for before, at in enumerate(layer):
            for state, to in enumerate(block[before] if at else ()):
                if to and (state not in best or (at[0] + to[0], (at[1], to[1])) < best[state]):
                    best[state], back[state] = (at[0] + to[0], (at[1], to[1])), before
        layer, least = ranked(best)
        spent += least
        pointers.append(back)
    cost, _, state = min((x[0] + INSERT * CLOSING[s], x[1], s) for s, x in enumerate(layer) if x)
    out = [state]
    for back in reversed(pointers):
        out.append(back[out[-1]])
    return out[::-1], spent + cost


# --- Spark ------------------------------------------------------------------------------------

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def faults(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text, id) without texts, with the first fault of each.

    A row is a duplicate if the conversation has its role and text earlier. Which one is the
    first comes from an aggregate and goes back by row, so a text that a conversation repeats
    without end is no one's key.
    """
    text = F.expr(f"trim(TRAILING {_quoted(SPACES)} FROM text)")
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = turns.select("conv_id", "turn", "id", F.substring("role", 1, 1).alias("initial"), mark.alias("mark"), (text == "").alias("blank"), (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("short"))
    first = rows.groupBy("conv_id", "mark").agg(F.min(F.struct("turn", "id")).alias("f")).select(F.col("f.id").alias("id"), F.lit(True).alias("first"))
    rows = rows.join(first, "id", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("short"), "truncated")
    state = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(START)
    rows = rows.withColumn("fault", fault)
    kind = state + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(0)
    return rows.select("conv_id", "turn", "mark", "id", "fault", kind.alias("kind"))


def _quoted(chars: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in chars) + "'"


def runs(conv: list) -> Iterator[tuple[int, int]]:
    """(from, to) of each stretch of equal values."""
    at = 0
    for i in range(1, len(conv) + 1):
        if i == len(conv) or conv[i] != conv[at]:
            yield at, i
            at = i


def _summaries(batches):
    """A row for each conversation in each block: its summary, first and last kind."""
    import pyarrow as pa

    kind_of, names = None, ["conv_id", "place", "first", "last", "costs", "ranks"]

    def summarised(conv: list, place: list, kind: list):
        rows = []
        for i, j in runs(list(zip(conv, (p >> BLOCK_BITS for p in place)))):
            flat = [x or (None, None) for layer in summary(kind[i:j]) for x in layer]
            rows.append((conv[i], place[i], kind[i] & 3, kind[j - 1] & 3, *map(list, zip(*flat))))
        kinds = (kind_of, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=names)

    conv, place, kind = [], [], []
    for batch in batches:
        kind_of = batch.column(0).type
        conv += batch.column(0).to_pylist()
        place += batch.column(1).to_pylist()
        kind += batch.column(2).to_pylist()
        whole = len(place)
        while whole and place[whole - 1] >> BLOCK_BITS == place[-1] >> BLOCK_BITS:
            whole -= 1  # the last block may go on in the next batch
        yield summarised(conv[:whole], place[:whole], kind[:whole])
        conv, place, kind = conv[whole:], place[whole:], kind[whole:]
    if place:
        yield summarised(conv, place, kind)


def _states(batches):
    """A row for each summary: the states the block begins and ends in, the kind before it,
    and whether it is the conversation's last. Summaries come by conversation, in order."""
    import pyarrow as pa

    names, held, conv, kind_of = ["place", "begins", "ends", "before", "last"], [], None, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())

    def settled(held: list) -> list:
        grids = [[[(c, r) if c is not None else None for c, r in zip(x["costs"][4 * p : 4 * p + 4], x["ranks"][4 * p : 4 * p + 4])] for p in range(4)] for x in held]
        between, _ = join_blocks(grids)
        return [(x["place"], a, b, held[i - 1]["last"] if i else None, i == len(held) - 1) for i, (x, a, b) in enumerate(zip(held, between, between[1:]))]

    def batch_of(rows: list):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kind_of)], names=names)

    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if held and x["conv_id"] != conv:
                out += settled(held)
                held = []
            conv = x["conv_id"]
            held.append(x)
        yield batch_of(out)
    if held:
        yield batch_of(settled(held))


def inserted(state: int, n: int) -> tuple[int, list[str]]:
    """The state after n inserted turns, and their roles."""
    out = []
    for _ in range(n):
        state = NEXT[state]
        out.append(ROLES[state])
    return state, out


def _traced(rows, states):
    """The edits of a block's rows."""
    import pyarrow as pa

    rows, states = rows.sort_by("place").to_pylist(), {x["place"]: x for x in states.to_pylist()}
    starts = [n for n, r in enumerate(rows) if r["place"] in states]
    out: list = []
    for i, j in zip(starts, [*starts[1:], len(rows)]):
        here, x = rows[i:j], states[rows[i]["place"]]
        before = x["before"]
        for r, (state, number) in zip(here, trace([r["kind"] for r in here], x["begins"], x["ends"])):
            turn, code = r["kind"] & 3, CODES[number]
            cost = INSERT * (len(code) - 1) + {"K": KEEP, "R": REROLE, "D": DELETE}[code[-1]]
            cost += TRUNCATED if r["kind"] & CUT_SHORT and code[-1] != "D" else 0
            state, opening = inserted(state, len(code) - 1)
            out.append([r["id"], r["place"], r["fault"], before is not None and (before, turn) not in LEGAL, code, cost, opening, ROLES[NEXT[state]] if code[-1] == "R" else None, []])
            before = turn
        if x["last"]:
            n = CLOSING[x["ends"]]
            out[-1][4:6] = out[-1][4] + "I" * n, out[-1][5] + INSERT * n
            out[-1][8] = inserted(x["ends"], n)[1]
    names = pa.list_(pa.string())
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), names, pa.string(), names)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 9, kinds)], names=["id", "place", "fault", "illegal", "edits", "cost", "opening", "as_role", "closing"])


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: conv_id, place, turn, role, text, its first fault, whether it is
    illegal after the turn before it, the edits (letters, in order), their cost, and
    `repaired`, the turns array<struct<role, text>> that stand in its place.

    Turns go by `turn` (nulls first), then by a hash of role and text, equal rows side by
    side; `place` counts up in that order. A null role or text is empty, rows of a null
    conv_id are one conversation, columns besides the four are not read, and an empty table
    gives no rows. What a conversation's last row closes with is part of its edits.

    Rows are sorted by range, so a conversation of any length spreads over tasks: its blocks
    of 4096 rows are searched for each state they may begin in, the small summaries are
    joined by conversation, and each block is traced back between the states that are then
    known. Texts are not read before that; they join by row.
    """
    plain = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = cut(plain.withColumn("id", F.monotonically_increasing_id()))
    order = ["conv_id", "turn", "mark", "id"]
    sorted_rows = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_rows.select("conv_id", F.monotonically_increasing_id().alias("place"), "kind", "id", "fault"))
    conv = placed.schema["conv_id"].dataType.simpleString()
    summaries = placed.select("conv_id", "place", "kind").mapInArrow(_summaries, f"conv_id {conv}, place long, first int, last int, costs array<long>, ranks array<int>")
    states = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_states, "place long, begins int, ends int, before int, last boolean")
    block = F.shiftright("place", BLOCK_BITS)
    edits = placed.groupBy(block.alias("block")).cogroup(states.groupBy(block.alias("block"))).applyInArrow(_traced, "id long, place long, fault string, illegal boolean, edits string, cost long, opening array<string>, as_role string, closing array<string>")
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.filter(F.array(F.struct(F.coalesce("as_role", "role").alias("role"), "text")), lambda _: ~F.col("edits").contains("D"))
    return edits.join(rows, "id").select("conv_id", "place", "turn", "role", "text", "fault", "illegal", "edits", "cost", F.concat(empty("opening"), own, empty("closing")).alias("repaired"))


def conversation_reports(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of repair_turns(): gaps, blank, duplicate, truncated,
    illegal, cost, audit and the SHA-256 of its repaired turns as lines "role:text".

    A digest reads its conversation in order, so a conversation's rows meet in one task; they
    stream through it in order, and no more than one batch and the audit is held.
    """
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    rows = repaired.select("conv_id", "place", "turn", "fault", "illegal", "edits", "cost", F.when(F.size("repaired") > 0, lines).alias("lines"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        import pyarrow as pa

        open_, kind_of = None, None

        def ended(c: dict) -> tuple:
            gaps = c["turns"][1] - c["turns"][0] + 1 - c["distinct"] if c["distinct"] else 0
            return c["conv"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], "".join(c["audit"]), c["sha"].hexdigest()

        def batch_of(rows: list):
            kinds = [kind_of, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 9, kinds)], names=["conv_id", *counts, "audit", "repaired_sha256"])

        for batch in batches:
            kind_of, out = batch.column(0).type, []
            for conv_id, _, turn, fault, illegal, edits, cost, lines in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or open_["conv"] != conv_id:
                    if open_:
                        out.append(ended(open_))
                    open_ = {"conv": conv_id, "turns": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0}
                if turn is not None:
                    open_["distinct"] += not open_["turns"] or open_["turns"][1] != turn
                    open_["turns"] = (open_["turns"][0] if open_["turns"] else turn, turn)
                if fault:
                    open_[fault] += 1
                open_["illegal"] += illegal
                open_["cost"] += cost
                open_["audit"].append(edits)
                if lines is not None:
                    open_["sha"].update((b"\n" if open_["lines"] else b"") + lines.encode())
                    open_["lines"] += 1
            yield batch_of(out)
        if open_:
            yield batch_of([ended(open_)])

    schema = f"conv_id {conv}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by a checksum of conversation and turn; a null is one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("c")).where("c <> 0")
    role = F.when(F.col("c") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("c") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = conversation_reports(repair_turns(damaged(conversations))).withColumnRenamed("conv_id", "id")
    all_of_them = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = all_of_them.join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


# Whole audits and texts stand in the rows of this search: right for small tables only.
OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS c FROM k, crc),
d AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE c <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, left(role, 1) AS ini FROM d),
f AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
ins(st, j, q, lines) AS (VALUES ('', 0, '', []::VARCHAR[]), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']), ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
  ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('u', 2, 'u', ['assistant:', 'user:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:']), ('a', 2, 'a', ['user:', 'assistant:'])),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS rep FROM f
  UNION ALL
  SELECT conv_id, i, st, b.cost, b.audit, b.rep FROM (
    SELECT conv_id, i, st, arg_min({'cost': cost, 'audit': audit, 'rep': rep}, {'cost': cost, 'audit': audit}) AS b FROM (
      SELECT dp.conv_id, f.i, CASE e.e WHEN 'D' THEN q WHEN 'K' THEN f.ini WHEN 'R' THEN CASE q WHEN 'u' THEN 'a' ELSE 'u' END END AS st,
        CAST(dp.cost + 5 * j + CASE e.e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.e <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT) AS cost,
        dp.audit || repeat('I', j) || e.e AS audit,
        list_concat(dp.rep, lines, CASE e.e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text] END) AS rep
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.st = dp.st CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(e)
      WHERE e.e = 'D' OR (f.fault IS NULL OR f.fault = 'truncated') AND (e.e = 'R' OR q || f.ini IN ('s', 'u', 'su', 'ua', 'au') AND f.ini <> '')) x
    GROUP BY conv_id, i, st) y),
e AS (SELECT dp.conv_id, arg_min({'cost': cost + 5 * j, 'audit': audit || repeat('I', j), 'rep': list_concat(rep, lines)}, {'cost': cost + 5 * j, 'audit': audit || repeat('I', j)}) AS b
  FROM dp JOIN ins ON ins.st = dp.st AND (j = 0 AND dp.st IN ('', 'a') OR j > 0 AND dp.st IN ('s', 'u') AND q = 'a') WHERE i = (SELECT max(n) FROM f WHERE f.conv_id IS NOT DISTINCT FROM dp.conv_id) GROUP BY dp.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.b.cost, 0) AS cost, coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.rep, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
