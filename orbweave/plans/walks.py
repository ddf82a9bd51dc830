"""Queries over closures, cycles, layers and include walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import walks
from orbweave.plans.registry import query
from orbweave.sources.tables import load


def _graph(spark, d):
    """Suppliers, each with edges to those of twice, twice plus one and three times its key."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    to = s.select("src", F.explode(F.array(F.col("src") * 2, F.col("src") * 2 + 1, F.col("src") * 3)).alias("dst"))
    return s.select(F.col("src").alias("id")), to.where("src > 0").join(s.select(F.col("src").alias("dst")), "dst", "left_semi")


_EDGES = """e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey > 0 AND b.s_suppkey IN (a.s_suppkey * 2, a.s_suppkey * 2 + 1, a.s_suppkey * 3))"""


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT a, b, 1 AS depth FROM e UNION SELECT r.a, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, b, min(depth) AS depth FROM r GROUP BY a, b)
SELECT a, count(*) AS n_descendants, CAST(max(depth) AS INT) AS depth, count(CASE WHEN a = b THEN 1 END) AS on_cycle FROM m GROUP BY a""")
def dag_closure(spark, d):
    _, e = _graph(spark, d)
    own = F.count_if(F.col("a") == F.col("b"))
    return walks.closure(e).groupBy("a").agg(F.count("*").alias("n_descendants"), F.max("depth").alias("depth"), own.alias("on_cycle"))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT s_suppkey AS id, 0 AS layer FROM supplier UNION SELECT e.b, r.layer + 1 FROM r JOIN e ON e.a = r.id)
SELECT id, CAST(max(layer) AS INT) AS layer FROM r GROUP BY id""")
def layer_order(spark, d):
    return walks.layers(*_graph(spark, d))


@query("""WITH b AS (SELECT s_suppkey AS node, s_suppkey // 10 AS block, min(s_suppkey) OVER w AS cycle, count(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_suppkey // 10))
SELECT cycle, CAST(node - cycle AS INT) AS step, node FROM b WHERE block % 3 = 0 AND n = 10""")
def cycle_witness(spark, d):
    """Suppliers in chains of ten, of which every third whole one is closed to a ring."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("src"))
    last = F.col("src") % 10 == 9
    e = s.where(~last | (F.floor(F.col("src") / 10) % 3 == 0)).select("src", F.when(last, F.col("src") - 9).otherwise(F.col("src") + 1).alias("dst"))
    return walks.cycles(e.join(s.select(F.col("src").alias("dst")), "dst", "left_semi"))


# Links of a page lead a few pages on, by their first letter; those that leave the ten pages
# of its book lead to no page.
_LINKS = """h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages), u AS (SELECT page_id AS file, unnest(hs) AS h, unnest(range(len(hs))) AS place FROM h),
t AS (SELECT file, place, file + 1 + length(h) % 4 AS target FROM u),
l AS (SELECT file, place, CASE WHEN target // 10 = file // 10 AND EXISTS (SELECT 1 FROM pages WHERE page_id = target) THEN target ELSE -target END AS target FROM t)"""


def page_links(spark, d):
    p = load(spark, d, "pages")
    links = p.select(F.col("page_id").alias("file"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("place", "h"))
    to = F.col("file") + 1 + F.length("h") % 4
    here = F.floor(to / 10) == F.floor(F.col("file") / 10)
    known = p.select(F.col("page_id").alias("known"))
    links = links.select("file", "place", to.alias("to"), here.alias("here")).join(known, F.col("to") == F.col("known"), "left")
    return links.select("file", "place", F.when(F.col("here") & F.col("known").isNotNull(), F.col("to")).otherwise(-F.col("to")).alias("target"))


@query(f"""WITH RECURSIVE {_LINKS}, w AS (SELECT page_id AS root, page_id AS file, '' AS path, NULL::BIGINT AS parent FROM pages WHERE page_id % 10 = 0
UNION ALL SELECT w.root, l.target, w.path || '/' || lpad(CAST(l.place AS VARCHAR), 8, '0'), w.file FROM w JOIN l ON l.file = w.file AND l.target > 0),
b AS (SELECT root, file, min(path) AS path FROM w GROUP BY root, file),
m AS (SELECT root, path, file, parent, 'read' AS state FROM w WHERE path = '' UNION ALL SELECT b.root, b.path || '/' || lpad(CAST(l.place AS VARCHAR), 8, '0') AS p, l.target, b.file,
  CASE WHEN l.target < 0 THEN 'missing' WHEN (SELECT c.path FROM b c WHERE c.root = b.root AND c.file = l.target) = b.path || '/' || lpad(CAST(l.place AS VARCHAR), 8, '0') THEN 'read' ELSE 'repeat' END FROM b JOIN l ON l.file = b.file)
SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS INT) AS at, file, parent, CAST(length(path) / 9 AS INT) AS depth, state FROM m""")
def include_walk(spark, d):
    """Books of ten pages, read from their first page on along the links of their texts."""
    p = load(spark, d, "pages").select(F.col("page_id").alias("file"))
    return walks.include_walk(p, page_links(spark, d), p.where("file % 10 = 0").select(F.col("file").alias("root")))
