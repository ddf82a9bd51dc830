"""Queries over checks, batches, draws, models, trees and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from orbweave.functions.text import contract_id
from orbweave.functions.vectors import r6
from orbweave.operators import checks, models, report, sampling, specification
from orbweave.operators.places import ordered_digest
from orbweave.operators.relations import seeded_split
from orbweave.operators.rules import largest_remainder
from orbweave.plans.registry import query
from orbweave.plans.relational import RULES
from orbweave.plans.rules import part_violations
from orbweave.plans.scans import finished, place
from orbweave.plans.text import serialized
from orbweave.sources.tables import NODES_SQL, load, nodes


def split(seed: int, p: str = "") -> str:
    """CTEs up to `<p>split` (id, split): 80 of 100 orders by seeded hash, half-even. Keys of
    equal hash prefix are ranked together, so no task sees all of them."""
    return f"""{p}keyed AS (SELECT o_orderkey AS id, sha256(concat('{seed}:', CAST(o_orderkey AS VARCHAR(20)))) AS h FROM orders),
{p}sizes AS (SELECT substring(h, 1, 2) AS b, count(*) AS m FROM {p}keyed GROUP BY substring(h, 1, 2)),
{p}blocks AS (SELECT b, sum(m) OVER (ORDER BY b) - m AS before, sum(m) OVER () AS n FROM {p}sizes),
{p}ranked AS (SELECT id, before + row_number() OVER (PARTITION BY substring(h, 1, 2) ORDER BY h, id) AS rn, n FROM {p}keyed JOIN {p}blocks ON b = substring(h, 1, 2)),
{p}split AS (SELECT id, CASE WHEN rn * 10 <= n * 8 + CASE WHEN n * 8 % 10 > 5 OR n * 8 % 10 = 5 AND CAST(floor(n * 8 / 10) AS BIGINT) % 2 = 1 THEN 10 - n * 8 % 10 ELSE -(n * 8 % 10) END THEN 'train' ELSE 'test' END AS split FROM {p}ranked)"""


@query(f"WITH {split(42)}, {split(43, 'o')} SELECT (SELECT count(*) FROM (SELECT id FROM split WHERE split = 'train' INTERSECT SELECT id FROM osplit WHERE split = 'test') x) AS leaked")
def split_leakage(spark, d):
    """The train side of one stored split against the test side of another."""
    a, b = (seeded_split(load(spark, d, "orders"), "o_orderkey", s) for s in (42, 43))
    return checks.leakage(a.where("split = 'train'"), b.where("split = 'test'"), "id")


@query("""WITH m AS (SELECT p_partkey AS id FROM part), u AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT p_partkey FROM part WHERE p_size <= 5 UNION ALL SELECT s_suppkey + 1000000 FROM supplier)
SELECT (SELECT count(*) FROM (SELECT id FROM m EXCEPT SELECT id FROM u) x) AS missing, (SELECT count(*) FROM (SELECT id FROM u EXCEPT SELECT id FROM m) x) AS strangers, (SELECT count(*) - count(DISTINCT id) FROM u) AS duplicates""")
def partition_complete(spark, d):
    """Parts that came back as admitted, small parts and suppliers as quarantined."""
    part, key = load(spark, d, "part"), F.col("p_partkey").alias("id")
    admitted = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).distinct()
    quarantined = part.where("p_size <= 5").select(key).union(load(spark, d, "supplier").select(F.col("s_suppkey") + 1000000))
    return checks.completeness(part.select(key), admitted, quarantined, "id")


_BATCHED = f"""{NODES_SQL}, h AS (SELECT house, idx, asset, sha256(concat(CAST(house AS VARCHAR), ':', CAST(idx AS VARCHAR))) AS h FROM nodes),
m AS (SELECT greatest((sum(n) + 31) // 32, max(n)) AS batches FROM (SELECT count(*) AS n FROM nodes GROUP BY asset) x),
b AS (SELECT house, idx, asset, CAST((row_number() OVER (ORDER BY asset, h, house, idx) - 1) % (SELECT batches FROM m) AS BIGINT) AS batch FROM h)"""


def _batched(spark, d):
    h = nodes(spark, d).select("house", "idx", "asset", F.sha2(F.concat_ws(":", "house", "idx"), 256).alias("h"))
    return sampling.unlike_batches(h, "asset", ["h", "house", "idx"], 32).drop("h")


@query(f"WITH {_BATCHED} SELECT * FROM b")
def unique_batches(spark, d):
    """Nodes in batches of 32 at most, each asset once in a batch."""
    return _batched(spark, d)


@query(f"""WITH {_BATCHED}, g AS (SELECT batch, count(*) AS n, count(DISTINCT asset) AS assets FROM b GROUP BY batch)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS n, count(CASE WHEN n > 32 OR assets < n THEN 1 END) AS faults FROM g""")
def unique_batches_check(spark, d):
    b = _batched(spark, d)
    bad = checks.batch_faults(b, ["batch"], "asset", 32).agg(F.count("*").alias("faults"))
    per = b.groupBy("batch").agg(F.count("*").alias("n")).agg(F.count("*").alias("batches"), F.sum("n").alias("n"))
    return per.crossJoin(F.broadcast(bad))  # one row each


POINTS = f"""{NODES_SQL}, s AS (SELECT house, idx, CASE WHEN sum(x) OVER h > 0 THEN x / sum(x) OVER h * 20 WHEN idx = 0 THEN 20e0 ELSE 0e0 END AS share FROM nodes WINDOW h AS (PARTITION BY house)),
f AS (SELECT house, idx, CAST(floor(share) AS BIGINT) AS base, share - floor(share) AS frac FROM s),
r AS (SELECT *, 20 - sum(base) OVER (PARTITION BY house) AS deficit, row_number() OVER (PARTITION BY house ORDER BY floor(frac * 1e9 + 5e-1) DESC, idx) AS rn FROM f),
p AS (SELECT house, idx, CAST(base + CASE WHEN rn <= deficit THEN 1 ELSE 0 END AS BIGINT) AS points FROM r)"""


@query(f"""WITH {POINTS}, e AS (SELECT house, idx, unnest(range(points)) AS k FROM p), h AS (SELECT *, sha256(concat(CAST(house + idx AS VARCHAR), ':', CAST(house AS VARCHAR), ':', CAST(k AS VARCHAR))) AS h FROM e),
d AS (SELECT house, idx, k, CAST('0x' || substring(h, 1, 8) AS BIGINT) / 4294967296e0 AS a, CAST('0x' || substring(h, 9, 8) AS BIGINT) / 4294967296e0 AS b FROM h)
SELECT house, idx, k, floor((1 - sqrt(a)) * 1e6 + 5e-1) / 1e6 AS u, floor(sqrt(a) * (1 - b) * 1e6 + 5e-1) / 1e6 AS v, floor(sqrt(a) * b * 1e6 + 5e-1) / 1e6 AS w FROM d""")
def draw_points(spark, d):
    """20 points of each house over its parts by area, largest remainders first, each at
    barycentric weights (u, v, w) uniform over a triangle. A part has a seed of its own, so
    its points don't depend on the other parts."""
    p = largest_remainder(nodes(spark, d).select("house", "idx", "x"), "house", "idx", "x", 20).where("points > 0")
    e = p.select("house", "idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1)).alias("k"))
    h = F.sha2(F.concat_ws(":", F.col("house") + F.col("idx"), "house", "k"), 256)
    a, b = (F.conv(F.substring(h, at, 8), 16, 10).cast("double") / 4294967296 for at in (1, 9))
    e = e.select("house", "idx", "k", a.alias("a"), b.alias("b"))
    root = F.sqrt("a")
    return e.select("house", "idx", "k", r6(1 - root).alias("u"), r6(root * (1 - F.col("b"))).alias("v"), r6(root * F.col("b")).alias("w"))


# --- models -----------------------------------------------------------------------------------


@query()
def encode_texts(spark, d):
    """Sentences of records through the model boundary, with a stand-in model of 32 numbers."""
    return models.encode(serialized(spark, d).select("p_partkey", "text"), "text", models.hashed_words(32), 32)


def _writer():
    def model(prompt: str) -> str:
        number = int(prompt.split()[1])
        if number % 11 == 0 and "again" in prompt:
            raise RuntimeError("the model is gone")
        return "" if number % 3 == 0 and "again" not in prompt else f"Part {number} stands beside the next one"

    return model


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS attempts, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 11 = 0 THEN NULL ELSE concat('Part ', CAST(p_partkey AS VARCHAR), ' stands beside the next one') END AS text,
CASE WHEN p_partkey % 3 = 0 AND p_partkey % 11 = 0 THEN 'RuntimeError: the model is gone' END AS reason FROM part""")
def write_relations(spark, d):
    """A text model under a rule, asked again once; what fails twice keeps its reason."""
    rows = load(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lit("Part"), "p_partkey", F.lit("and its neighbour:")).alias("prompt"))
    return models.write_checked(rows, "p_partkey", "prompt", _writer, lambda t: None if t.strip() else "empty", lambda p, t, why: f"{p} ({why}) again")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS width FROM embeddings WHERE vec_id % 8 = 7")
def complete_gallery(spark, d):
    """Vectors of rows that hold all three modalities; one that slips through without raises."""
    e = load(spark, d, "embeddings").withColumn("bits", F.col("vec_id") % 8)
    whole = e.where("bits = 7")
    return whole.select("vec_id", checks.required(F.size("embedding"), F.col("bits") == 7, "the gallery takes complete rows only").alias("width"))


# --- specifications ---------------------------------------------------------------------------

@query("""WITH c AS (SELECT n_nationkey AS stage, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CASE n_nationkey % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'gated' ELSE n_name END END AS fusion, 64 - n_nationkey % 5 AS width, n_regionkey > 0 AS use_layout FROM nation),
w AS (SELECT max(len) AS width FROM (SELECT 64 AS len) x)
SELECT stage, CASE WHEN fusion IS NULL THEN 'fusion is required' WHEN fusion NOT IN ('mean', 'mlp', 'gated') THEN concat('fusion = ', fusion, ' is unknown') WHEN use_layout AND c.width <> w.width THEN concat('layout width ', CAST(c.width AS VARCHAR(20)), ' is not ', CAST(w.width AS VARCHAR(20))) END AS fault FROM c CROSS JOIN w""")
def stage_config_faults(spark, d):
    """Training stages (nations) whose settings a builder would refuse."""
    known = F.when(F.col("n_nationkey") % 3 == 0, "mean").when(F.col("n_nationkey") % 3 == 1, "gated").otherwise(F.col("n_name"))
    c = load(spark, d, "nation").select(F.col("n_nationkey").alias("stage"), F.when(F.col("n_nationkey") % 7 != 0, known).alias("fusion"), (64 - F.col("n_nationkey") % 5).alias("width"), (F.col("n_regionkey") > 0).alias("use_layout"))
    return c.select("stage", checks.stage_fault(F.col("fusion"), F.col("width"), F.col("use_layout"), 64).alias("fault"))


@query("""WITH wanted AS (SELECT s_suppkey AS id FROM supplier), held AS (SELECT c_custkey AS id, sha256(c_name) AS digest FROM customer WHERE c_custkey % 4 <> 0)
SELECT wanted.id, held.digest, CASE WHEN held.id IS NULL THEN concat('no checkpoint of ', CAST(wanted.id AS VARCHAR(20)), ': train it first') END AS refusal FROM wanted LEFT JOIN held ON held.id = wanted.id""")
def checkpoint_records(spark, d):
    """The checkpoints that stages name, or why one can't go on."""
    wanted = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    held = load(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("digest"))
    return checks.checkpoints(wanted, held, "id", "digest")


@query(f"""WITH {NODES_SQL}, h AS (SELECT house, count(*) AS n FROM nodes GROUP BY house) SELECT o_orderkey AS house, coalesce(n, 0) AS n,
CASE WHEN n IS NULL THEN 'no layout' WHEN o_orderstatus = 'F' THEN 'refused: no layout branch' WHEN n = 1 THEN 'context without edges' ELSE 'batch of one' END AS entry FROM orders LEFT JOIN h ON house = o_orderkey""")
def layout_entry(spark, d):
    """How each house's layout enters the model."""
    n = nodes(spark, d).groupBy("house").agg(F.count("*").alias("n"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("house"), (F.col("o_orderstatus") != "F").alias("branch"))
    return checks.layout_entries(o.join(n, "house", "left")).select("house", "n", "entry")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS iteration FROM events)
SELECT event_id, iteration, count(*) OVER (PARTITION BY user_id, iteration ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_iteration,
count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_run FROM e""")
def iteration_state(spark, d):
    """Counts of a run (a user) that start anew with each iteration (a signup), and one that doesn't."""
    e = load(spark, d, "events")
    return checks.iteration_counts(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "iteration", "in_iteration", "in_run")


@query("""WITH t AS (SELECT DISTINCT p_type || '.' || p_brand AS name FROM part WHERE p_size < 25), s AS (SELECT DISTINCT p_type || '.' || p_brand AS name FROM part WHERE p_size > 20 OR p_type = 'PROMO'),
j AS (SELECT coalesce(t.name, s.name) AS name, t.name IS NOT NULL AS t, s.name IS NOT NULL AS s FROM t FULL OUTER JOIN s ON t.name = s.name)
SELECT * FROM (SELECT name, CASE WHEN t AND starts_with(name, 'PROMO.') THEN 'frozen but trained' WHEN t AND NOT s THEN 'not saved' WHEN NOT t AND NOT starts_with(name, 'PROMO.') THEN 'saved but never trained' END AS fault FROM j) x WHERE fault IS NOT NULL""")
def checkpoint_coverage(spark, d):
    """Parameters of a training section against those of its checkpoint, one prefix frozen."""
    name = load(spark, d, "part").withColumn("name", F.concat_ws(".", "p_type", "p_brand"))
    return checks.coverage(name.where("p_size < 25"), name.where("p_size > 20 or p_type = 'PROMO'"), ["PROMO."])


_RING = """n AS (SELECT n_nationkey AS k, n_name AS id, n_regionkey AS r FROM nation), e AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.k = (a.k + 5) % 25),
p AS (SELECT a.id AS node, b.id AS pred FROM n a JOIN n b ON a.k = b.k + 5)"""


@query(f"""WITH {_RING} SELECT 'node on a cycle' AS family, id AS subject, NULL AS detail FROM n UNION ALL SELECT 'node out of reach', id, NULL FROM n
UNION ALL SELECT 'node reads no channel', id, '5' FROM n WHERE r = 4 UNION ALL SELECT 'channel is read but never written', '5', id FROM n WHERE r = 4
UNION ALL SELECT 'readers name one too many', '0', id FROM n WHERE r = 1
UNION ALL SELECT 'edge without a dependency', n.id, src FROM n JOIN e ON e.dst = n.id WHERE k < 5
UNION ALL SELECT 'scheduled before what it depends on', node, pred FROM p JOIN n ON n.id = p.node WHERE k % 7 = 0
UNION ALL SELECT 'policy of a group without edges', id, 'late' FROM n WHERE k % 6 = 0 UNION ALL SELECT 'group without a policy', id, 'default' FROM n WHERE k % 6 = 0
UNION ALL SELECT 'node is not scheduled', id, NULL FROM n WHERE k = 24""")
def spec_consistency(spark, d):
    """A workflow of nations: rings of the nations five apart, regions as channels, and some
    planted faults in readers, schedule and join policies."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("id"), F.col("n_regionkey").alias("r"))
    node = n.select("k", "id", F.array(F.col("r").cast("string")).alias("writes"), F.array((F.col("r") + 1).cast("string")).alias("reads"), F.lit("work").alias("role"))
    to = n.select(F.col("k").alias("to"), F.col("id").alias("dst"))
    edges = node.join(to, (F.col("k") + 5) % 25 == F.col("to")).select(F.concat_ws(">", "id", "dst").alias("id"), F.col("id").alias("src"), "dst", F.lit("data").alias("kind"), F.col("writes").alias("carries"), F.lit(None).cast("string").alias("guard"), F.lit(None).cast("string").alias("join_group"))
    pred = n.select((F.col("k") + 5).alias("k"), F.col("id").alias("pred"))
    depends = n.join(pred, "k").select(F.col("id").alias("node"), "pred", F.lit(False).alias("conditional"))
    members = n.groupBy(F.col("r").cast("string").alias("name")).agg(F.collect_list("id").alias("ids"))
    read_by = n.groupBy((F.col("r") + 1).cast("string").alias("name")).agg(F.collect_list("id").alias("readers"))
    extra = n.where("r = 1").select("id").agg(F.collect_list("id").alias("extra"))
    named = members.join(read_by, "name", "left").crossJoin(F.broadcast(extra))  # one row
    readers = F.when(F.col("name") == "0", F.col("extra")).otherwise(F.coalesce("readers", F.array().cast("array<string>")))
    channels = named.select("name", F.col("ids").alias("writers"), readers.alias("readers"), F.array().cast("array<string>").alias("fields"))
    policies = n.where("k % 6 = 0").select(F.col("id").alias("node"), F.lit("late").alias("join_group"), F.lit("all").alias("policy"))
    layer = F.when((F.col("k") % 7 == 0) & (F.col("k") >= 5), F.floor(F.col("k") / 5) - 1).otherwise(F.floor(F.col("k") / 5))
    schedule = n.where("k < 24").select(F.col("id").alias("node"), layer.alias("layer"))
    return specification.faults(specification.Specification(node.drop("k"), edges, channels, depends=depends, policies=policies, schedule=schedule, broadcast=["1", "2", "3", "4", "5"]))


# --- fingerprints, trees, reports -------------------------------------------------------------

# The rules that decide whether a record is admitted; any change gives another fingerprint.
CONTRACT = {"rules": RULES, "fields": ["p_name", "p_type", "p_size", "p_retailprice"], "dimension_unit": "cm", "most_attempts": 2}
_PAYLOAD = json.dumps(CONTRACT, sort_keys=True, ensure_ascii=False).replace("'", "''")


@query(f"SELECT p_partkey, concat('record_v3@', substring(sha256('{_PAYLOAD}'), 1, 16)) AS contract FROM part")
def contract_fingerprint(spark, d):
    return load(spark, d, "part").select("p_partkey", F.lit(contract_id("record", 3, CONTRACT)).alias("contract"))


def _level(n: int) -> str:
    """A level of digest trees with 16 nodes under each."""
    hashed = f"sha256('{n}' || chr(10) || string_agg(leaf, chr(10) ORDER BY pos))"
    once = hashed if n == 1 else f"CASE WHEN m = 1 THEN max(leaf) ELSE {hashed} END"
    return f"l{n} AS (SELECT module, n, pos // 16 AS pos, (m + 15) // 16 AS m, {once} AS leaf FROM l{n - 1} GROUP BY module, n, pos // 16, m)"


@query(f"""WITH l0 AS (SELECT p_type AS module, count(*) OVER w AS n, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) - 1 AS pos, count(*) OVER w AS m,
p_name || ':' || CAST(p_partkey AS VARCHAR) || '=' || sha256(CAST(p_size AS VARCHAR) || ':' || p_brand) AS leaf FROM part WINDOW w AS (PARTITION BY p_type)),
{", ".join(_level(n) for n in range(1, 7))} SELECT module, n, leaf AS digest FROM l6""")
def weight_digest(spark, d):
    """One digest for each module over its tensors in the order of their names, as a tree of
    16 nodes a branch; a tensor's bytes are digested first."""
    leaf = F.concat_ws("=", F.concat_ws(":", "p_name", "p_partkey"), F.sha2(F.concat_ws(":", "p_size", "p_brand"), 256))
    rows = load(spark, d, "part").withColumn("module", F.col("p_type"))
    return ordered_digest(rows, ["module"], ["p_name", "p_partkey"], leaf, 16)


def house_trees(spark, d):
    """(house, tree): each house's nodes as a nested JSON tree in which node i holds the nodes
    2 i + 1 and 2 i + 2; a stand-in for stored houses."""
    n = nodes(spark, d).groupBy("house").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "asset"))), lambda x: x["asset"]).alias("assets"))

    def write(batches):
        import pyarrow as pa

        for b in batches:
            trees = []
            for assets in b.column(1).to_pylist():
                told = [""] * (2 * len(assets) + 2)  # a node is written after those it holds
                for i in reversed(range(len(assets))):
                    inner = ",".join(t for t in told[2 * i + 1 : 2 * i + 3] if t)
                    told[i] = f'{{"room":"room{assets[i] % 3}","id":"o{i}","asset":{assets[i]},"children":[{inner}]}}'
                trees.append(f'{{"objects":[{told[0]}]}}')
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.string())], names=["house", "tree"])

    return n.mapInArrow(write, "house long, tree string")


@query(f"""WITH RECURSIVE {NODES_SQL}, t AS (SELECT house, idx, asset, CAST(NULL AS VARCHAR) AS parent, 0::BIGINT AS depth, '0' AS path, 'room' || CAST(asset % 3 AS VARCHAR) AS room FROM nodes WHERE idx = 0
UNION ALL SELECT n.house, n.idx, n.asset, t.path, t.depth + 1, t.path || CASE WHEN n.idx % 2 = 1 THEN 'a' ELSE 'b' END, t.room FROM t JOIN nodes n ON n.house = t.house AND n.idx > 0 AND (n.idx - 1) // 2 = t.idx),
k AS (SELECT *, row_number() OVER (PARTITION BY house ORDER BY path) - 1 AS at FROM t)
SELECT k.house, k.at AS idx, 'o' || CAST(k.idx AS VARCHAR) AS id, k.asset, p.at AS parent, k.depth, k.room FROM k LEFT JOIN k p ON p.house = k.house AND p.path = k.parent""")
def tree_flatten(spark, d):
    return models.flatten_trees(house_trees(spark, d))


@query()
def status_report(spark, d):
    """The state of the parts by type as Markdown."""
    parts = part_violations(spark, d).groupBy("p_type").agg(F.count("*").alias("n"), F.count("violation").alias("refused"), F.avg("p_retailprice").alias("price"))
    return spark.createDataFrame([(report.markdown(parts, "Parts", ["p_type"]),)], "report string")


def _log(spark, d):
    """Events as the log of a run for each type: a value, and the user as another metric."""
    return load(spark, d, "events").select("event_type", "event_id", "value", F.when(F.col("event_type") != "view", F.col("user_id")).alias("user"))


@query("""WITH l AS (SELECT event_type AS run, 'value' AS metric, event_id AS step, value FROM events UNION ALL SELECT event_type, 'user', event_id, CAST(user_id AS DOUBLE) FROM events WHERE event_type <> 'view'),
r AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY step, value) AS rn, count(*) OVER (PARTITION BY run, metric) AS n FROM l)
SELECT run, metric, step, value FROM r WHERE (rn - 1) % (n // 100 + 1) = 0 OR rn = n""")
def curve_points(spark, d):
    """Thinned curves of each run, whose last points are the log's."""
    return report.curve_points(_log(spark, d), "event_type", "event_id", ["value", "user"], 100)


@query()
def curve_page(spark, d):
    """The page of curves, written to the shared folder and read again."""
    at = place(spark, "page")
    page = report.curve_page(_log(spark, d), "Events", "event_type", "event_id", {"value": ["value"], "user": ["user"]}, 100)
    report.write_page(spark, page, at)
    return finished(spark.read.text(at, wholetext=True).select(F.col("value").alias("page")), at)
