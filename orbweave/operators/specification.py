"""What is inconsistent in the specification of a workflow: nodes, channels, gates, schedules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.checks import cyclic, unreached
from orbweave.operators.walks import closure
from orbweave.sources.tables import kept

#: Kinds of edges that may close a cycle, and those that are no dependencies.
BACKWARD = ["feedback"]
NO_DEPENDENCY = ["feedback", "error", "escalation"]


@dataclass
class Specification:
    """Tables of a workflow; those that are None aren't checked.

    nodes: id, reads, writes (arrays of channels), role; edges: id, src, dst, kind, carries,
    guard, join_group; channels: name, writers, readers (arrays of node ids), fields (array);
    depends: node, pred, conditional; policies: node, join_group, policy ("all", "any"...);
    schedule: node, layer; gates: gate, criterion, evidence (array of checks); checks: id,
    cited_by; decisions: id, state, and columns that a RESOLVED one must fill.
    Ends of edges may be `terminals`. A channel whose writers (or readers) hold the wildcard
    isn't compared, nor are pseudo nodes and nodes of subgraphs (ids with that prefix).
    `broadcast` channels reach every node, `given` ones are there before the first.
    """

    nodes: DataFrame
    edges: DataFrame
    channels: DataFrame
    depends: DataFrame | None = None
    policies: DataFrame | None = None
    schedule: DataFrame | None = None
    gates: DataFrame | None = None
    checks: DataFrame | None = None
    decisions: DataFrame | None = None
    terminals: list[str] = field(default_factory=list)
    wildcard: str = "*"
    pseudo: list[str] = field(default_factory=list)
    subgraph: str | None = None
    broadcast: list[str] = field(default_factory=list)
    given: list[str] = field(default_factory=list)


def _row(df: DataFrame, family: str, subject: str, detail: Column | None = None) -> DataFrame:
    detail = F.lit(None) if detail is None else detail
    return df.select(F.lit(family).alias("family"), F.col(subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _none_of(c: Column, values: list[str]) -> Column:
    return ~c.isin(values) if values else F.lit(True)


def faults(s: Specification) -> DataFrame:
    """(family, subject, detail) of each inconsistency."""
    s.nodes, s.edges, s.channels = kept(s.nodes), kept(s.edges), kept(s.channels)
    found = [*_structure(s), *_provenance(s), *_reach(s)]
    if s.depends is not None:
        found += _dependencies(s)
    if s.policies is not None:
        found += _joins(s)
    if s.schedule is not None:
        found += _schedule(s)
    if s.gates is not None:
        found += _gates(s)
    if s.decisions is not None:
        found += _decisions(s)
    return reduce(DataFrame.union, found)


def _ids(s: Specification) -> DataFrame:
    return s.nodes.select("id").distinct()


def _names(s: Specification) -> DataFrame:
    return s.channels.select("name").distinct()


def _uses(s: Specification, column: str) -> DataFrame:
    return s.nodes.select(F.explode(column).alias("name"), "id").distinct()


def _structure(s: Specification) -> list[DataFrame]:
    ends = s.edges.select(F.col("id").alias("edge"), F.explode(F.array("src", "dst")).alias("id"))
    carried = s.edges.select(F.col("id").alias("edge"), F.explode("carries").alias("name"))
    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    return [
        _row(twice(s.nodes, "id"), "node declared twice", "id", F.col("count")),
        _row(twice(s.channels, "name"), "channel declared twice", "name", F.col("count")),
        _row(twice(s.edges, "id"), "edge declared twice", "id", F.col("count")),
        _row(ends.where(_none_of(F.col("id"), s.terminals)).join(_ids(s), "id", "left_anti"), "edge to no node", "edge", F.col("id")),
        _row(carried.join(_names(s), "name", "left_anti"), "edge carries no channel", "edge", F.col("name")),
    ]


def _provenance(s: Specification) -> list[DataFrame]:
    """Declared writers and readers are the nodes that write and read."""
    counts = _none_of(F.col("id"), s.pseudo)
    if s.subgraph:
        counts = counts & ~F.startswith("id", F.lit(s.subgraph))
    found = []
    for verb, role in (("writes", "writers"), ("reads", "readers")):
        open_ = s.channels.where(F.array_contains(role, s.wildcard)).select("name")
        uses, declared = _uses(s, verb), s.channels.select("name", F.explode(role).alias("id")).distinct()
        real = uses.where(counts).join(_names(s), "name", "left_semi").join(open_, "name", "left_anti")
        said = declared.where(counts).join(open_, "name", "left_anti")
        found.append(_row(uses.join(_names(s), "name", "left_anti"), f"node {verb} no channel", "id", F.col("name")))
        found.append(_row(real.select("name", "id").subtract(said.select("name", "id")), f"{role} leave one out", "name", F.col("id")))
        found.append(_row(said.select("name", "id").subtract(real.select("name", "id")), f"{role} name one too many", "name", F.col("id")))
    unwritten = _uses(s, "reads").where(_none_of(F.col("name"), s.given)).join(_uses(s, "writes").select("name"), "name", "left_anti")
    open_ = s.channels.where(F.array_contains("writers", s.wildcard)).select("name")
    return [*found, _row(unwritten.join(open_, "name", "left_anti"), "channel is read but never written", "name", F.col("id"))]


def _main(s: Specification) -> DataFrame:
    ids = _ids(s)
    main = s.edges.where(_none_of(F.col("kind"), BACKWARD))
    return main.join(ids, main.src == ids.id, "left_semi").join(ids, main.dst == ids.id, "left_semi")


def _reach(s: Specification) -> list[DataFrame]:
    main = kept(_main(s).select("src", "dst"))
    return [_row(unreached(s.nodes.select("id"), main), "node out of reach", "id"), _row(cyclic(main), "node on a cycle", "id")]


def _dependencies(s: Specification) -> list[DataFrame]:
    ids, d = _ids(s), s.depends
    real = s.edges.where(_none_of(F.col("kind"), NO_DEPENDENCY)).select(F.col("dst").alias("node"), F.col("src").alias("pred")).distinct()
    for c in ("node", "pred"):
        real = real.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    said = d.select("node", "pred").distinct()
    above = closure(d.select(F.col("pred").alias("src"), F.col("node").alias("dst"))).select(F.col("a").alias("writer"), F.col("b").alias("id"))
    reads = _uses(s, "reads").where(_none_of(F.col("name"), s.broadcast + s.given)).join(d.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    writers = s.channels.select("name", F.explode("writers").alias("writer"))
    own = writers.select("name", "writer", F.col("writer").alias("id"))
    reached = writers.join(above, "writer").select("name", "id").union(own.select("name", "id"))
    late = reads.join(writers.select("name").distinct(), "name", "left_semi").join(reached.distinct(), ["name", "id"], "left_anti")
    maybe = d.where("conditional").select("node", "pred").distinct()
    arms = maybe.join(s.edges.select(F.col("dst").alias("node"), F.col("src").alias("pred"), "guard", F.coalesce("join_group", F.lit("default")).alias("join_group")), ["node", "pred"], "left")
    bare = arms.groupBy("node", "pred").agg((F.count("*") > F.count("guard")).alias("bare")).where("bare")
    found = [
        _row(said.subtract(real.select("node", "pred")), "dependency without an edge", "node", F.col("pred")),
        _row(real.select("node", "pred").subtract(said), "edge without a dependency", "node", F.col("pred")),
        _row(late, "read without a writer above", "id", F.col("name")),
        _row(bare, "conditional dependency is not guarded", "node", F.col("pred")),
    ]
    if s.policies is not None:
        any_ = s.policies.where("policy = 'any'").select("node", "join_group")
        stuck = arms.where("join_group is not null").join(any_, ["node", "join_group"], "left_anti").select("node", "pred").distinct()
        found.append(_row(stuck, "conditional dependency can't be skipped", "node", F.col("pred")))
    return found


def _joins(s: Specification) -> list[DataFrame]:
    p, ids = s.policies, _ids(s)
    arms = s.edges.select(F.col("dst").alias("node"), F.coalesce("join_group", F.lit("default")).alias("join_group"), "guard")
    any_ = p.where("policy = 'any'").join(arms, ["node", "join_group"]).groupBy("node", "join_group").agg(F.count("*").alias("n"), F.count("guard").alias("guarded"))
    joined = arms.select("node", "join_group").distinct()
    return [
        _row(p.join(ids, p.node == ids.id, "left_anti"), "policy of no node", "node", F.col("join_group")),
        _row(p.join(joined.select("node").distinct(), "node", "left_semi").join(joined, ["node", "join_group"], "left_anti"), "policy of a group without edges", "node", F.col("join_group")),
        _row(joined.join(p.select("node").distinct(), "node", "left_semi").join(p, ["node", "join_group"], "left_anti"), "group without a policy", "node", F.col("join_group")),
        _row(any_.where("n < 2"), "any of a single edge", "node", F.col("join_group")),
        _row(any_.where("guarded < n"), "any with an edge that is not guarded", "node", F.col("join_group")),
    ]


def _schedule(s: Specification) -> list[DataFrame]:
    at, ids = s.schedule.select("node", "layer"), _ids(s)
    found = [
        _row(ids.join(at, ids.id == at.node, "left_anti"), "node is not scheduled", "id"),
        _row(at.join(ids, at.node == ids.id, "left_anti"), "schedule of no node", "node"),
    ]
    if s.depends is not None:
        d = s.depends.select("node", "pred").distinct().join(at, "node").join(at.select(F.col("node").alias("pred"), F.col("layer").alias("before")), "pred")
        found.append(_row(d.where("before >= layer"), "scheduled before what it depends on", "node", F.col("pred")))
    return found


def _gates(s: Specification) -> list[DataFrame]:
    ids, g = _ids(s), s.gates
    reads = _uses(s, "reads").select(F.col("id").alias("gate"), "name")
    words = g.select("gate", F.explode(F.array_distinct(F.regexp_extract_all("criterion", F.lit(r"\b([a-z][a-z0-9]*_[a-z0-9_]*)\b"), 1))).alias("name"))
    blind = words.join(_names(s), "name", "left_semi").join(reads, ["gate", "name"], "left_anti")
    pairs = g.select("gate", F.explode(F.array_distinct(F.regexp_extract_all("criterion", F.lit(r"\b([a-z][a-z0-9_]*\.[a-z][a-z0-9_]*)\b"), 1))).alias("pair"))
    pairs = pairs.select("gate", "pair", F.split_part("pair", F.lit("."), F.lit(1)).alias("name"), F.split_part("pair", F.lit("."), F.lit(2)).alias("field"))
    fielded = s.channels.where("size(fields) > 0").select("name", "fields")
    wrong = pairs.join(fielded, "name").where(~F.array_contains("fields", F.col("field")))
    brought = s.edges.select(F.col("dst").alias("gate"), F.explode("carries").alias("name")).distinct()
    seen = reads.join(g.select("gate"), "gate", "left_semi").where(_none_of(F.col("name"), s.broadcast + s.given))
    mutating = s.nodes.where("role = 'mutate'").select("id").distinct()
    gated = closure(_main(s).select("src", "dst")).join(g.select(F.col("gate").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
    found = [
        _row(g.join(ids, g.gate == ids.id, "left_anti"), "gate is no node", "gate"),
        _row(blind, "criterion names what the gate doesn't read", "gate", F.col("name")),
        _row(wrong, "criterion names no field of the channel", "gate", F.col("pair")),
        _row(seen.join(brought, ["gate", "name"], "left_anti"), "gate reads what no edge brings", "gate", F.col("name")),
        _row(mutating.join(gated, "id", "left_anti"), "node changes things behind no gate", "id"),
    ]
    if s.checks is not None:
        c = s.checks
        cited = g.select("gate", F.explode("evidence").alias("id"))
        found.append(_row(cited.join(c.select("id"), "id", "left_anti"), "evidence names no check", "gate", F.col("id")))
        found.append(_row(c.where("cited_by is not null").join(g, c.cited_by == g.gate, "left_anti"), "check cites no gate", "id", F.col("cited_by")))
    return found


def _decisions(s: Specification) -> list[DataFrame]:
    d = s.decisions
    wanted = [c for c in d.columns if c not in ("id", "state")]
    lacks = F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in wanted]), lambda c: c.isNotNull())
    bare = d.where("state = 'RESOLVED'").select("id", F.array_join(lacks, ", ").alias("lacks")).where("lacks <> ''")
    told = s.channels.select("name", F.explode("fields").alias("field")).join(d.where("state = 'RESOLVED'").select(F.col("id").alias("field")), "field", "left_semi")
    return [_row(bare, "decision without its grounds", "id", F.col("lacks")), _row(told, "channel still names a settled question", "name", F.col("field"))]
