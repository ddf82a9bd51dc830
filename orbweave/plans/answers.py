"""Queries that put distinct questions to models: settled answers, many inputs a call."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.operators import models
from orbweave.operators.aggregates import vector_aggregates
from orbweave.operators.settled import content_key, settle_texts, settle_vectors, symmetric
from orbweave.plans.registry import query
from orbweave.plans.scans import finished, place
from orbweave.sources.tables import NODES_SQL, kept, load, nodes


def neighbours(spark, d):
    """(house, i, j, a, b): a house's next nodes with what their parts are."""
    n = nodes(spark, d)
    part = load(spark, d, "part").select(F.col("p_partkey").alias("asset"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))
    told = n.join(part, "asset").select("house", "idx", "text")
    w = W.partitionBy("house").orderBy("idx")
    then = told.withColumns({"j": F.lead("idx").over(w), "b": F.lead("text").over(w)}).where(F.col("j") == F.col("idx") + 1)
    return then.select("house", F.col("idx").alias("i"), "j", F.col("text").alias("a"), "b")


def writer():
    """A stand-in that answers some prompts only when asked again, and some never."""

    def model(prompt: str) -> str:
        again, pair = prompt.startswith("again "), prompt.removeprefix("again ")
        first, second = pair.split(" | ")
        if first == second:
            return ""
        return "" if first[-1] == second[-1] and not again else f"The {first} stands by the {second}."

    return model


_PAIRS = f"""{NODES_SQL}, t AS (SELECT house, idx, p_type || ' ' || p_brand AS text FROM nodes JOIN part ON p_partkey = asset),
p AS (SELECT x.house, x.idx AS i, y.idx AS j, least(x.text, y.text) AS a, greatest(x.text, y.text) AS b FROM t x JOIN t y ON x.house = y.house AND y.idx = x.idx + 1)"""


@query(f"""WITH {_PAIRS} SELECT house, i, j, sha256('{{"k":["' || a || '","' || b || '","p1","w1"]}}') AS key, CASE WHEN a <> b THEN 'The ' || a || ' stands by the ' || b || '.' END AS sentence,
CAST(CASE WHEN right(a, 1) = right(b, 1) THEN 2 ELSE 1 END AS INT) AS attempts, a = b AS degraded, CASE WHEN a = b THEN 'empty' END AS reason FROM p""")
def settled_relations(spark, d):
    """A sentence for each pair of neighbours; a pair is asked once, whichever way round. The
    first call settles half of the pairs, the second one asks for the rest only."""
    e = neighbours(spark, d)
    a, b = symmetric(F.col("a"), F.col("b"))
    e = e.select("house", "i", "j", content_key([a, b], ["p1", "w1"]).alias("key"), F.concat(a, F.lit(" | "), b).alias("prompt"))
    at = place(spark, "relations")
    asked = kept(e.select("key", "prompt").distinct())  # few: the pairs of what parts there are

    def told(rows):
        return settle_texts(rows, "prompt", writer, lambda t: None if t else "empty", lambda p, t, why: f"again {p}", at)

    told(asked.where(F.substring("key", 1, 1) < "8"))
    got = told(asked).drop("prompt")
    return finished(e.join(got, "key").select("house", "i", "j", "key", F.col("text").alias("sentence"), "attempts", "degraded", "reason"), at)


@query("SELECT p_partkey, CAST(length(p_type || ' ' || p_brand) AS DOUBLE) AS n, CAST(ascii(p_type) AS DOUBLE) AS first FROM part")
def settled_embeddings(spark, d):
    """Vectors of parts' descriptions, of which there are few; each is encoded once."""
    rows = load(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("text"))

    def load_model():
        return lambda texts: [[len(t), ord(t[0])] for t in texts]

    at = place(spark, "vectors")
    got = settle_vectors(rows, "text", ["v1"], load_model, 2, at, normalise=False)
    return finished(got.select("p_partkey", F.get("embedding", F.lit(0)).alias("n"), F.get("embedding", F.lit(1)).alias("first")), at)


# --- records of several inputs ----------------------------------------------------------------

VIEWS = 11

#: Parts whose images one task makes, some 40 MB of them: a small file of parts is many images.
PARTS = 10_000


def images(spark, d):
    """(p_partkey, view, image): 11 stand-in images of each part, some hundred bytes each."""
    p = load(spark, d, "part").select("p_partkey", "p_size")
    p = p.repartition(max(1, -(-p.count() // PARTS)), "p_partkey").select("*", F.explode(F.sequence(F.lit(0), F.lit(VIEWS - 1))).alias("view"))
    content = F.unhex(F.repeat(F.md5(F.concat_ws(":", "p_partkey", "view")), F.col("p_size")))
    return p.select("p_partkey", "view", content.alias("image"))


def annotator():
    return lambda prompt, views: f"{prompt}: {len(views)} views, {sum(map(len, views))} bytes, {views[0][:2].hex()} to {views[-1][:2].hex()}"


@query("""SELECT p_partkey, CAST(1 AS INT) AS attempts, 'What is ' || p_name || '?: 11 views, ' || CAST(11 * 16 * p_size AS VARCHAR) || ' bytes, ' || substring(md5(p_partkey || ':0'), 1, 4) || ' to ' || substring(md5(p_partkey || ':10'), 1, 4) AS text, CAST(NULL AS VARCHAR) AS reason FROM part""")
def annotate_views(spark, d):
    """A prompt and the 11 images of each part, in order, in one call."""
    views = models.gathered(images(spark, d), "p_partkey", "view", "image", VIEWS, VIEWS)
    asked = load(spark, d, "part").select("p_partkey", F.concat(F.lit("What is "), "p_name", F.lit("?")).alias("prompt")).join(views, "p_partkey")
    return models.write_checked(asked, "p_partkey", "prompt", annotator, lambda t: None, lambda p, t, why: p, inputs="inputs")


@query("""WITH v AS (SELECT p_partkey, unnest(range(11)) AS view, p_size FROM part)
SELECT p_partkey, CAST(16 * p_size AS DOUBLE) AS bytes, avg(CAST('0x' || substring(md5(p_partkey || ':' || view), 1, 2) AS INT)) AS first FROM v GROUP BY p_partkey, p_size""")
def image_embeddings(spark, d):
    """Each image is a vector; a part's is their mean."""
    e = models.encode(images(spark, d), "image", lambda: lambda x: [[len(i), i[0]] for i in x], 2, normalise=False, most_bytes=1 << 16)
    m = vector_aggregates(e, ["p_partkey"], "embedding", {"v": "mean"})
    return m.select("p_partkey", F.get("v", F.lit(0)).alias("bytes"), F.get("v", F.lit(1)).alias("first"))


@query(f"""WITH {NODES_SQL} SELECT house, CAST(count(*) AS DOUBLE) AS points, min(x) AS low, max(z) AS high FROM nodes GROUP BY house""")
def cloud_embeddings(spark, d):
    """Each house as a cloud of points in one value, whatever order they are stored in."""
    n = nodes(spark, d).select("house", "idx", F.struct("x", "y", "z").alias("p"))
    clouds = models.gathered(n, "house", "idx", "p", 10_000, out="cloud")
    e = models.encode(clouds, "cloud", lambda: lambda c: [[len(x), min(p["x"] for p in x), max(p["z"] for p in x)] for x in c], 3, batch=64, normalise=False)
    return e.select("house", *[F.get("embedding", F.lit(i)).alias(a) for i, a in enumerate(("points", "low", "high"))])
