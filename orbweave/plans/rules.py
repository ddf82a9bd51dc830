"""Queries of rules, states and gates: operators on stand-in tables; their SQL is written apart."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orbweave.operators import gates, rules
from orbweave.plans.registry import query
from orbweave.plans.relational import RULES, r6
from orbweave.sources.tables import NODES_SQL, load, nodes

def part_rules():
    """The rules of parts as records, in their order."""
    return [
        (F.col("p_name").isNull() | F.col("p_type").isNull(), "required field missing"),
        (rules.blank(F.col("p_name")), "name must be a non-empty string"),
        (rules.outside(F.col("p_size"), 1, 45), F.concat(F.lit("size = "), F.col("p_size").cast("string"), F.lit(" is outside 1-45"))),
        (rules.outside(F.col("p_retailprice"), 905, 1900), "price outside 905-1900"),
        (F.col("p_retailprice") / F.pow(F.col("p_size"), F.lit(3)) > 500, "density is implausible"),
        (F.col("p_type") == "PROMO", "type is not allowed"),
    ]


def part_violations(spark, d):
    return load(spark, d, "part").withColumn("violation", rules.first_violation(part_rules()))


@query(f"SELECT p_partkey, {RULES} AS violation FROM part")
def validate_records(spark, d):
    return part_violations(spark, d).select("p_partkey", "violation")


@query(f"""WITH v AS (SELECT p_partkey, p_type, {RULES} AS violation FROM part)
SELECT p_type, count(*) AS n, count(violation) AS n_bad, CASE WHEN count(violation) = 0 THEN 'declared' ELSE 'refused' END AS verdict FROM v GROUP BY p_type""")
def revalidate_population(spark, d):
    v = part_violations(spark, d).groupBy("p_type").agg(F.count("*").alias("n"), F.count("violation").alias("n_bad"))
    return v.withColumn("verdict", F.when(F.col("n_bad") == 0, "declared").otherwise("refused"))


@query(f"SELECT p_partkey, 'annotate' AS stage, 'r1' AS code_revision, {RULES} AS exception_msg FROM part WHERE {RULES} IS NOT NULL")
def quarantine_rows(spark, d):
    bad = part_violations(spark, d).where("violation is not null")
    return bad.select("p_partkey", F.lit("annotate").alias("stage"), F.lit("r1").alias("code_revision"), F.col("violation").alias("exception_msg"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 300 THEN 'longer than 300'
WHEN lower(text) = upper(text) THEN 'no letter' END AS violation FROM documents""")
def validate_text(spark, d):
    t = F.col("text")
    why = rules.first_violation([(t.isNull() | rules.blank(t), "empty"), (F.length(t) > 300, "longer than 300"), (F.lower(t) == F.upper(t), "no letter")])
    return load(spark, d, "documents").select("doc_id", why.alias("violation"))


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AND l.quality = 1 AND d.n_chars = length(d.text) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def is_complete(spark, d):
    both = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    whole = rules.complete([F.col("quality"), F.col("text")], [F.col("quality") == 1, F.col("n_chars") == F.length("text")])
    return both.select("doc_id", whole.alias("complete"))


@query("""SELECT 'events' AS contract, event_type AS name, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type
UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY o_orderstatus""")
def contract_violations(spark, d):
    e = rules.strangers(load(spark, d, "events"), "events", "event_type", ["view", "click", "purchase"])
    return e.union(rules.strangers(load(spark, d, "orders"), "orders", "o_orderstatus", ["O", "F"]))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def work_list(spark, d):
    return rules.work_list(load(spark, d, "documents").select("doc_id"), load(spark, d, "labels"), "doc_id", F.col("quality") == 1)


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type <> 'PROMO') GROUP BY l_partkey")
def unmatched_dim(spark, d):
    return rules.unmatched(load(spark, d, "lineitem"), load(spark, d, "part").where("p_type <> 'PROMO'"), "l_partkey", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_type FROM lineitem JOIN part ON p_partkey = l_partkey")
def strict_types(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rules.strict_lookup(li, load(spark, d, "part").select("p_partkey", "p_type"), "l_partkey", "p_partkey").drop("p_partkey")


@query(f"""WITH {NODES_SQL}, pairs AS (SELECT a.house, a.asset AS asset_a FROM nodes a JOIN nodes b ON a.house = b.house AND b.idx = a.idx + 1), cache AS (SELECT p_partkey, p_size % 5 = 0 AS degraded FROM part WHERE p_size % 3 <> 0),
s AS (SELECT house, CASE WHEN p_partkey IS NULL THEN 'uncached' WHEN degraded THEN 'degraded' ELSE 'covered' END AS state FROM pairs LEFT JOIN cache ON p_partkey = asset_a)
SELECT house, count(*) AS n, count(CASE WHEN state = 'covered' THEN 1 END) AS covered, count(CASE WHEN state = 'degraded' THEN 1 END) AS degraded, count(CASE WHEN state = 'uncached' THEN 1 END) AS uncached,
{r6("CAST(count(CASE WHEN state = 'covered' THEN 1 END) AS DOUBLE) / count(*)")} AS covered_fraction FROM s GROUP BY house""")
def edge_coverage(spark, d):
    """Each node but a house's last one has an edge to the next: it is the row before it, so
    one pass over the numbered nodes has all edges."""
    n = nodes(spark, d)
    edges = n.withColumn("last", F.max("idx").over(W.partitionBy("house"))).where("idx < last")
    cache = load(spark, d, "part").where("p_size % 3 <> 0")
    return rules.coverage_by(rules.match_states(edges.select("house", "asset"), cache, "asset", "p_partkey", F.col("p_size") % 5 == 0), "house")


_PROV = """prov AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'none' WHEN l.quality = 1 AND l.toxic = 0 THEN 'current' WHEN l.quality = 0 AND sha256(d.text) = sha256(trim(d.text)) THEN 'declared' ELSE 'unaccounted' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _provenance(spark, d):
    docs = load(spark, d, "documents").withColumn("declared_digest", F.sha2(F.trim("text"), 256))
    return rules.provenance(docs, load(spark, d, "labels"), "doc_id", F.sha2("text", 256), F.col("quality") == 0, (F.col("quality") == 1) & (F.col("toxic") == 0))


@query(f"WITH {_PROV} SELECT doc_id, state FROM prov")
def provenance_state(spark, d):
    return _provenance(spark, d).select("doc_id", "state")


@query(f"WITH {_PROV} SELECT state, count(*) AS n, CASE WHEN state IN ('none', 'unaccounted') THEN 'todo' ELSE 'kept' END AS list FROM prov GROUP BY state")
def state_counts(spark, d):
    s = _provenance(spark, d).groupBy("state").agg(F.count("*").alias("n"))
    return s.withColumn("list", F.when(F.col("state").isin("none", "unaccounted"), "todo").otherwise("kept"))


@query("""WITH ours AS (SELECT l_returnflag AS cell, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag),
paper AS (SELECT o_orderstatus AS cell, count(*) AS n FROM orders GROUP BY o_orderstatus)
SELECT coalesce(ours.cell, paper.cell) AS cell, ours.n AS ours, paper.n AS published, CASE WHEN paper.n IS NULL THEN 'not published' WHEN ours.n IS NULL THEN 'missing' WHEN ours.n >= paper.n THEN 'holds' ELSE 'differs' END AS verdict
FROM ours FULL OUTER JOIN paper ON ours.cell = paper.cell""")
def compare_cells(spark, d):
    ours = load(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_returnflag").alias("cell")).agg(F.count("*").alias("n"))
    paper = load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("cell")).agg(F.count("*").alias("n"))
    return rules.compared(ours, paper, "cell", "n")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'absent' WHEN l.quality IS NULL THEN 'unreadable' ELSE 'record' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def read_state(spark, d):
    return rules.read_states(load(spark, d, "documents").select("doc_id"), load(spark, d, "labels"), "doc_id", F.col("quality").isNotNull())


@query("""SELECT doc_id, CASE WHEN n > 1 THEN 'duplicate' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unknown state' WHEN text IS NULL THEN 'empty digest' END AS violation
FROM (SELECT doc_id, lang, text, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) t WHERE n > 1 OR lang NOT IN ('en', 'fr', 'de') OR text IS NULL""")
def registry_violations(spark, d):
    docs = load(spark, d, "documents")
    return rules.registry_faults(docs, "doc_id", F.sha2("text", 256), [(~F.col("lang").isin("en", "fr", "de"), "unknown state"), (F.col("text").isNull(), "empty digest")])


@query("""WITH promoted AS (SELECT s_suppkey AS id, sha256(s_name) AS digest FROM supplier WHERE s_suppkey % 2 = 0), staged AS (SELECT s_suppkey AS id, sha256(CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE upper(s_name) END) AS digest FROM supplier)
SELECT staged.id, CASE WHEN promoted.id IS NULL THEN 'promote' WHEN promoted.digest = staged.digest THEN 'same' ELSE 'refused' END AS status FROM staged LEFT JOIN promoted ON promoted.id = staged.id""")
def promotion_status(spark, d):
    s = load(spark, d, "supplier").withColumn("id", F.col("s_suppkey"))
    staged = s.select("id", F.sha2(F.when(F.col("id") % 4 == 0, F.col("s_name")).otherwise(F.upper("s_name")), 256).alias("digest"))
    return rules.promotion(staged, s.where("id % 2 = 0").select("id", F.sha2("s_name", 256).alias("digest")), "id", "digest")


@query(f"""WITH {NODES_SQL}, s AS (SELECT house, idx, CASE WHEN sum(x) OVER h > 0 THEN x / sum(x) OVER h * 1000 WHEN idx = 0 THEN 1000e0 ELSE 0e0 END AS share FROM nodes WINDOW h AS (PARTITION BY house)),
f AS (SELECT house, idx, CAST(floor(share) AS BIGINT) AS base, share - floor(share) AS frac FROM s),
r AS (SELECT *, 1000 - sum(base) OVER (PARTITION BY house) AS deficit, row_number() OVER (PARTITION BY house ORDER BY floor(frac * 1e9 + 5e-1) DESC, idx) AS rn FROM f)
SELECT house, idx, CAST(base + CASE WHEN rn <= deficit THEN 1 ELSE 0 END AS BIGINT) AS points FROM r""")
def allocate_points(spark, d):
    return rules.largest_remainder(nodes(spark, d).select("house", "idx", "x"), "house", "idx", "x", 1000).drop("x")


@query("SELECT source, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_wins(spark, d):
    return rules.first_by(load(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_wins(spark, d):
    return rules.first_by(load(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"], last=True)


@query("""WITH m AS (SELECT lang, max(n_chars) AS longest FROM documents GROUP BY lang)
SELECT m.lang, longest, min(doc_id) AS doc_id FROM m JOIN documents d ON d.lang = m.lang AND d.n_chars = longest GROUP BY m.lang, longest""")
def longest_doc(spark, d):
    return rules.greatest_with_witness(load(spark, d, "documents"), ["lang"], "n_chars", "doc_id", "longest")


@query("""WITH r AS (SELECT l_orderkey AS house, CASE WHEN l_tax > 6e-2 THEN 0 WHEN l_tax > 4e-2 THEN 1 WHEN l_discount > 5e-2 THEN 2 WHEN l_discount > 2e-2 THEN 3 WHEN l_quantity > 10 THEN 4 ELSE 5 END AS rank FROM lineitem)
SELECT house, CASE max(rank) WHEN 0 THEN 'texture' WHEN 1 THEN 'face' WHEN 2 THEN 'vertex' WHEN 3 THEN 'flat' WHEN 4 THEN 'gltf_default' ELSE 'fallback_grey' END AS worst FROM r GROUP BY house""")
def worst_source(spark, d):
    ladder = {"texture": F.col("l_tax") > 0.06, "face": F.col("l_tax") > 0.04, "vertex": F.col("l_discount") > 0.05, "flat": F.col("l_discount") > 0.02, "gltf_default": F.col("l_quantity") > 10}
    return rules.worst(load(spark, d, "lineitem").withColumn("house", F.col("l_orderkey")), ["house"], ladder, "fallback_grey")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'frozen' ELSE 'trainable' END AS published, CASE WHEN p_partkey % 3 = 0 THEN 'frozen' ELSE 'trainable' END AS actual, CASE WHEN p_type = 'PROMO' THEN 'random_single_view' ELSE 'mean' END AS pooling FROM part),
t(published, actual, pooling, deviates, exceeds, may_use_cache, cache_layout) AS (VALUES ('frozen', 'frozen', 'mean', false, false, true, 'aggregated'), ('frozen', 'frozen', 'random_single_view', false, false, true, 'per_view'), ('frozen', 'trainable', 'mean', false, true, false, 'none'), ('frozen', 'trainable', 'random_single_view', false, true, false, 'none'),
('trainable', 'frozen', 'mean', true, false, true, 'aggregated'), ('trainable', 'frozen', 'random_single_view', true, false, true, 'per_view'), ('trainable', 'trainable', 'mean', false, false, false, 'none'), ('trainable', 'trainable', 'random_single_view', false, false, false, 'none'))
SELECT p_partkey, t.* FROM p JOIN t USING (published, actual, pooling)""")
def decision_table(spark, d):
    """Parts as encoders; the SQL has the truth table itself."""
    p = load(spark, d, "part")
    scope = lambda c: F.when(c, "frozen").otherwise("trainable")
    p = p.select("p_partkey", scope(F.col("p_size") % 2 == 0).alias("published"), scope(F.col("p_partkey") % 3 == 0).alias("actual"), F.when(F.col("p_type") == "PROMO", "random_single_view").otherwise("mean").alias("pooling"))
    return p.withColumns(rules.encoder_decisions(F.col("published"), F.col("actual"), F.col("pooling")))


@query("SELECT p_partkey, p_retailprice / (CAST(p_size AS DOUBLE) * p_size * p_size) BETWEEN 1e-9 AND 1e0 AS plausible FROM part")
def density_check(spark, d):
    volume = F.col("p_size").cast("double") * F.col("p_size") * F.col("p_size")
    return load(spark, d, "part").select("p_partkey", (~rules.outside(F.col("p_retailprice") / volume, 1e-9, 1.0)).alias("plausible"))


@query("""SELECT p_partkey, NOT ((p_retailprice / (p_size * 40) < 5e-1 OR p_retailprice / (p_size * 40) > 3) AND abs(p_retailprice - p_size * 40) > 25e-2 * greatest(p_retailprice, CAST(p_size * 40 AS DOUBLE))) AS fits FROM part WHERE p_size > 0""")
def bbox_check(spark, d):
    return load(spark, d, "part").where("p_size > 0").select("p_partkey", rules.extents_agree(F.col("p_retailprice"), F.col("p_size") * 40).alias("fits"))


@query("SELECT doc_id, text IS NOT NULL AND source = 'src1' AND lang IS NOT NULL AS under_contract FROM documents")
def under_contract(spark, d):
    return load(spark, d, "documents").select("doc_id", rules.complete([F.col("text"), F.col("lang")], [F.col("source") == "src1"]).alias("under_contract"))


@query("SELECT event_id, coalesce(CAST(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR(20)) END AS BIGINT) AS VARCHAR(20)), '') AS value FROM events")
def safe_projection(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("user_id").cast("string"))
    return load(spark, d, "events").select("event_id", rules.or_else(raw.try_cast("long"), "").alias("value"))


@query("""SELECT CASE WHEN p_size > 40 THEN 'v3' WHEN p_size > 20 THEN 'v1' WHEN p_retailprice > 1000 THEN 'current' ELSE 'undeclarable' END AS population, count(*) AS n FROM part GROUP BY 1""")
def classify_population(spark, d):
    return rules.classified(load(spark, d, "part"), {"v3": F.col("p_size") > 40, "v1": F.col("p_size") > 20, "current": F.col("p_retailprice") > 1000}, "undeclarable", "population")


@query(f"""WITH first AS (SELECT p_partkey, {RULES} AS v1 FROM part), second AS (SELECT f.p_partkey, v1, CASE WHEN v1 IS NOT NULL AND p_size % 2 = 0 THEN v1 END AS v2 FROM first f JOIN part p ON p.p_partkey = f.p_partkey)
SELECT p_partkey, CAST(CASE WHEN v1 IS NULL THEN 1 ELSE 2 END AS BIGINT) AS attempts, CASE WHEN v1 IS NULL OR v2 IS NULL THEN 'record' ELSE 'quarantine' END AS status, CASE WHEN v1 IS NOT NULL THEN v2 END AS reason FROM second""")
def repair_outcomes(spark, d):
    p = part_violations(spark, d).withColumn("second", F.when(F.col("p_size") % 2 == 0, F.col("violation")))
    return rules.repaired(p, "p_partkey", "violation", "second")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * p_size * p_size AS volume, 'cm' AS dimension_unit, 'kg' AS mass_unit, CAST(3 AS BIGINT) AS prompt_version FROM part")
def enrich_record(spark, d):
    return load(spark, d, "part").select("p_partkey", *rules.enriched(F.col("p_size"), 3))


# --- gates ------------------------------------------------------------------------------------


@query(f"""WITH o AS (SELECT 'G1' AS gate, 'orphans' AS criterion, CAST(count(*) AS DOUBLE) AS observed, 0e0 AS most FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'G2', 'labelled share missing', {r6("1 - CAST((SELECT count(*) FROM labels) AS DOUBLE) / nullif(count(*), 0)")}, 5e-1 FROM documents
UNION ALL SELECT 'G3', 'error share', {r6("CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) / nullif(count(*), 0)")}, 1e-1 FROM events)
SELECT gate, criterion, observed, CASE WHEN observed IS NULL THEN 'BLOCKED' WHEN observed <= most THEN 'PASS' ELSE 'FAIL' END AS verdict, CAST(CASE WHEN observed IS NULL THEN 3 WHEN observed <= most THEN 0 ELSE 2 END AS BIGINT) AS rc FROM o""")
def gate_report(spark, d):
    t = lambda name: load(spark, d, name)
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    orphans = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").agg(F.count("*").cast("double").alias("observed"))
    sizes = t("documents").agg(F.count("*").alias("n")).crossJoin(F.broadcast(t("labels").agg(F.count("*").alias("m"))))  # one row each
    labelled = sizes.select(six(1 - F.col("m") / F.nullif(F.col("n"), F.lit(0))).alias("observed"))
    errors = t("events").agg(six(F.count_if(F.col("event_type") == "error") / F.nullif(F.count("*"), F.lit(0))).alias("observed"))
    criteria = None
    for gate, criterion, seen, most in (("G1", "orphans", orphans, 0.0), ("G2", "labelled share missing", labelled, 0.5), ("G3", "error share", errors, 0.1)):
        row = seen.select(F.lit(gate).alias("gate"), F.lit(criterion).alias("criterion"), "observed", F.lit(None).cast("double").alias("least"), F.lit(most).alias("most"))
        criteria = row if criteria is None else criteria.union(row)
    return gates.judged(criteria).drop("least", "most")


@query("""WITH RECURSIVE v AS (SELECT s_suppkey AS gate, CASE WHEN s_suppkey % 13 = 0 THEN 'BLOCKED' WHEN s_acctbal >= 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM supplier),
own AS (SELECT s_suppkey AS gate, min(c_custkey) AS input FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 97 = s_suppkey % 97 WHERE c_custkey % 11 = 0 GROUP BY s_suppkey),
e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey > 0 AND b.s_suppkey IN (a.s_suppkey * 2, a.s_suppkey * 3)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), up AS (SELECT b AS gate, min(a) AS above FROM r JOIN own ON own.gate = r.a GROUP BY b)
SELECT v.gate, CASE WHEN own.input IS NOT NULL OR above IS NOT NULL THEN 'INVALIDATED' ELSE verdict END AS verdict, CAST(CASE WHEN own.input IS NOT NULL OR above IS NOT NULL THEN 4 WHEN verdict = 'PASS' THEN 0 WHEN verdict = 'FAIL' THEN 2 ELSE 3 END AS BIGINT) AS rc,
CASE WHEN own.input IS NOT NULL THEN 'input ' || own.input WHEN above IS NOT NULL THEN 'gate ' || above END AS reason FROM v LEFT JOIN own ON own.gate = v.gate LEFT JOIN up ON up.gate = v.gate""")
def gate_standing(spark, d):
    """Suppliers as gates that have judged customers of their nation; some customers have
    changed since, which runs down to the gates of twice and three times the key."""
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    criteria = s.select(F.col("s_suppkey").alias("gate"), F.lit("balance").alias("criterion"), F.when(F.col("s_suppkey") % 13 != 0, F.col("s_acctbal")).alias("observed"), F.lit(0.0).alias("least"), F.lit(None).cast("double").alias("most"))
    met = s.join(c, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 97 == F.col("s_suppkey") % 97))
    used = met.select(F.col("s_suppkey").alias("gate"), F.col("c_custkey").alias("input"), F.sha2("c_name", 256).alias("digest"))
    now = c.select(F.col("c_custkey").alias("input"), F.sha2(F.when(F.col("c_custkey") % 11 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")), 256).alias("digest"))
    ids = s.select(F.col("s_suppkey").alias("dst"))
    down = s.where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), F.explode(F.array(F.col("s_suppkey") * 2, F.col("s_suppkey") * 3)).alias("dst")).join(ids, "dst", "left_semi")
    return gates.standing(gates.gate_verdicts(criteria), used, now, down)
