"""Walks over directed graphs: closure, cycles, layers, and depth-first order of includes.

All are rounds of joins whose state stays distributed and is written after each round; a pair
or node enters once, so rounds end with the longest shortest path (closure) or path (layers).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.sources.tables import kept


#: Written pieces of a growing table that are read side by side before they become one.
PIECES = 16


class Grown:
    """A table that rounds add to: what is there isn't written again, but for a merge every
    PIECES rounds, so all rounds together write about as much as the table holds."""

    def __init__(self, first: DataFrame) -> None:
        self.pieces = [first]

    def add(self, piece: DataFrame) -> None:
        self.pieces.append(piece)
        if len(self.pieces) > PIECES:
            self.pieces = [kept(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.pieces)


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(a, b, depth) of each pair such that edges (src, dst) lead from a to b, with the least
    number of edges. A pair enters in the round of its depth and only new pairs are joined
    on, so the paths between two nodes, however many, cost one row. A node on a cycle leads
    to itself. Edges with a null end are ignored.
    """
    e = kept(_links(edges))
    new, depth = kept(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("depth"))), 1
    seen = Grown(new)
    while True:
        depth += 1
        step = new.join(e, new.b == e.src).select("a", F.col("dst").alias("b")).distinct()
        new = kept(step.join(seen.all().select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit(depth).alias("depth")))
        if not new.limit(1).count():
            return seen.all()
        seen.add(new)


def cycles(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(cycle, step, node): a shortest cycle through the least node of each group of nodes
    that lead to each other, named by that node, which is step 0; none, if edges are acyclic.
    `pairs` is closure(edges), if that is there already.
    """
    pairs = closure(edges) if pairs is None else pairs
    back = pairs.select(F.col("a").alias("b_"), F.col("b").alias("a_"))
    both = kept(pairs.join(back, (pairs.a == F.col("a_")) & (pairs.b == F.col("b_")), "left_semi").select("a", "b", "depth"))
    least = both.groupBy("b").agg(F.min("a").alias("a")).where("a = b").select(F.col("a").alias("cycle"))
    home = kept(both.join(least, both.b == least.cycle).select("cycle", F.col("a").alias("node"), F.col("depth").alias("home")))
    at = kept(home.where("cycle = node").select("cycle", F.lit(0).alias("step"), "node", "home"))
    out, e = Grown(at.select("cycle", "step", "node")), kept(_links(edges))
    while True:  # each step goes to the least node that is one edge nearer to the start
        at = at.where("home > 1").join(e, F.col("node") == F.col("src")).select("cycle", (F.col("step") + 1).alias("step"), F.col("dst").alias("node"), (F.col("home") - 1).alias("left"))
        at = kept(at.join(home, ["cycle", "node"]).where("home = left").groupBy("cycle", "step", "home").agg(F.min("node").alias("node")))
        if not at.limit(1).count():
            return out.all()
        out.add(at.select("cycle", "step", "node"))


def refuse_cycles(edges: DataFrame, what: str) -> None:
    """Raise with a shortest cycle, if there is one."""
    found = cycles(edges)
    first = found.agg(F.min("cycle").alias("c")).first()["c"]
    if first is not None:
        ring = [r["node"] for r in found.where(F.col("cycle") == F.lit(first)).orderBy("step").limit(20).collect()]
        raise ValueError(f"{what} form a cycle: {' -> '.join(map(str, [*ring, ring[0]]))}")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): 0 for nodes that no edge enters, else one more than the highest layer
    that an edge comes from, by taking away one layer after the other. `nodes` has a column
    id; the ends of edges count as nodes. A cycle raises and is shown.
    """
    left = kept(_links(edges))
    rest = kept(nodes.select("id").union(left.select("src")).union(left.select("dst")).where("id is not null").distinct())
    out, layer = None, 0
    while rest.limit(1).count():
        here = kept(rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if not here.limit(1).count():
            refuse_cycles(left, "edges")
        found = here.select("id", F.lit(layer).alias("layer"))
        if out is None:
            out = Grown(found)
        else:
            out.add(found)
        rest = kept(rest.join(here, "id", "left_anti"))
        left = kept(left.join(here, left.src == here.id, "left_anti"))
        layer += 1
    return out.all() if out is not None else rest.select("id", F.lit(0).alias("layer"))


def include_walk(files: DataFrame, includes: DataFrame, start: DataFrame) -> DataFrame:
    """(root, at, file, parent, depth, state): what a depth-first reader of includes meets,
    in its order (`at` counts from 0 for each root).

    files: file; includes: file, place, target (in the order of place); start: root. A
    target that is met again is "repeat" and isn't entered, one that is no file is "missing",
    else it is "read". Order comes from paths: a file is entered on the least sequence of
    places that leads to it, which rounds find by improving one path a file; a repeat or a
    missing target hangs under the path of the file that names it. Includes that form a
    cycle within reach of a root are refused and shown. A path's text grows by 9 characters
    a level.
    """
    kind = files.schema["file"].dataType
    known = kept(files.select("file").where("file is not null").distinct())
    links = includes.where("file is not null and target is not null").select("file", "target", "place")
    number = F.lpad(F.col("place").cast("string"), 8, "0")
    links = kept(links.select("file", "target", F.concat(F.lit("/"), number).alias("key")).distinct())
    inner = kept(links.join(known.select(F.col("file").alias("target")), "target", "left_semi"))
    roots = kept(start.select(F.col("root")).join(known, F.col("root") == F.col("file"), "left_semi").distinct())
    best = kept(roots.select("root", F.col("root").alias("file"), F.lit("").alias("path"), F.lit(None).cast(kind).alias("parent")))
    new, reach = best, inner.select(F.col("file").alias("src"), F.col("target").alias("dst"))
    refuse_cycles(_reached(reach, roots), "includes")
    while True:
        step = new.join(inner, "file").groupBy("root", F.col("target").alias("file")).agg(F.min(F.struct(F.concat("path", "key").alias("path"), F.col("file").alias("parent"))).alias("n"))
        both = step.join(best.select("root", "file", F.col("path").alias("old")), ["root", "file"], "left").where("old is null or n.path < old")
        new = kept(both.select("root", "file", "n.path", "n.parent"))
        if not new.limit(1).count():
            break
        best = kept(best.join(new.select("root", "file"), ["root", "file"], "left_anti").union(new))
    met = best.join(links, "file").select("root", F.concat("path", "key").alias("path"), F.col("target").alias("file"), F.col("file").alias("parent"))
    state = met.join(best.select("root", "file", F.col("path").alias("first")), ["root", "file"], "left")
    what = F.when(F.col("first").isNull(), "missing").when(F.col("first") == F.col("path"), "read").otherwise("repeat")
    rows = best.where("path = ''").select("root", "path", "file", "parent", F.lit("read").alias("state")).union(state.select("root", "path", "file", "parent", what))
    order = F.row_number().over(W.partitionBy("root").orderBy("path")) - 1
    depth = (F.length("path") / 9).cast("int")
    return rows.select("root", order.alias("at"), "file", "parent", depth.alias("depth"), "state")


def _reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges that leave what roots lead to."""
    new = kept(roots.select(F.col("root").alias("src")).distinct())
    seen = Grown(new)
    while True:
        step = edges.join(new, "src", "left_semi").select(F.col("dst").alias("src")).distinct()
        new = kept(step.join(seen.all(), "src", "left_anti"))
        if not new.limit(1).count():
            return edges.join(seen.all(), "src", "left_semi")
        seen.add(new)
