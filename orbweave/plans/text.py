"""Queries over text, identity and JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions import text as X
from orbweave.operators import tokens
from orbweave.operators.places import ordered_digest
from orbweave.operators.settled import symmetric
from orbweave.plans.registry import query, run_sql
from orbweave.sources.tables import load

_CAMEL_SQL = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') || '_' || upper(p_type[1]) || lower(p_type[2:])"
_HUMAN_SQL = rf"trim(replace(lower(regexp_replace({_CAMEL_SQL}, '([A-Z])', ' \1', 'g')), '_', ' '))"


def _human(spark, d):
    camel = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("_"), F.initcap("p_type"))
    return load(spark, d, "part").select("p_partkey", X.humanise(camel).alias("text"))


@query(f"SELECT p_partkey, {_HUMAN_SQL} AS text FROM part")
def humanise(spark, d):
    return _human(spark, d)


@query(f"SELECT p_partkey, 'a ' || {_HUMAN_SQL} AS text FROM part")
def object_text(spark, d):
    return _human(spark, d).select("p_partkey", F.concat(F.lit("a "), "text").alias("text"))


@query("""WITH k AS (SELECT p_partkey, concat(p_type, '|', CAST(p_size AS VARCHAR(20)), '|', CAST(p_partkey AS VARCHAR(20))) AS id FROM part),
rooms AS (SELECT concat('room|', CAST(n_nationkey AS VARCHAR(20))) AS room FROM nation)
SELECT p_partkey, coalesce(nullif(split_part(id, '|', 1), ''), id) AS category, room
FROM k LEFT JOIN rooms ON room = concat('room|', split_part(id, '|', 2))""")
def split_key(spark, d):
    """Categories of keys of three fields, and the room that the second one names."""
    key = load(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_type", "p_size", "p_partkey").alias("id"))
    rooms = load(spark, d, "nation").select(F.concat_ws("|", F.lit("room"), "n_nationkey").alias("room"))
    kind, number = X.key_field(F.col("id"), 1), X.key_field(F.col("id"), 2)
    return key.join(rooms, F.col("room") == F.concat(F.lit("room|"), number), "left").select("p_partkey", kind.alias("category"), "room")


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE
regexp_replace(regexp_replace(substring(text, 1, 120), ' [^ ]*\z', ''), '[ ,;:]+\z', '') || '.' END AS capped FROM documents""")
def cap_text(spark, d):
    return load(spark, d, "documents").select("doc_id", X.cap(F.col("text"), 120).alias("capped"))


@query(r"SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.1f', l_extendedprice / 8), '[.]0\z', '') AS dim FROM lineitem")
def render_dim(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.decimal_text(F.col("l_extendedprice") / 8).alias("dim"))


@query("SELECT c_custkey, upper(substring(lower(c_mktsegment), 1, 1)) || substring(lower(c_mktsegment), 2) AS segment FROM customer")
def capitalise(spark, d):
    return load(spark, d, "customer").select("c_custkey", X.capitalise(F.lower("c_mktsegment")).alias("segment"))


def _flags():
    return {f: F.col("p_size").bitwiseAND(F.lit(2**i)) > 0 for i, f in enumerate(X.FLAGS)}


_PLACE_SQL = """CASE p_size & 15 WHEN 0 THEN 'with no typical placement' WHEN 12 THEN 'typically placed on the floor or on other objects' ELSE
CASE WHEN p_size & 1 > 0 THEN 'typically mounted' WHEN p_size & 2 > 0 THEN 'typically mounted' ELSE 'typically placed' END || ' ' ||
array_to_string(list_filter([CASE WHEN p_size & 1 > 0 THEN 'on a ceiling' END, CASE WHEN p_size & 2 > 0 THEN 'on a wall' END,
CASE WHEN p_size & 4 > 0 THEN 'on the floor' END, CASE WHEN p_size & 8 > 0 THEN 'on top of other objects' END], lambda x: x IS NOT NULL), ' or ') END"""


@query(f"SELECT p_partkey, {_PLACE_SQL} AS phrase FROM part")
def placement_phrase(spark, d):
    return load(spark, d, "part").select("p_partkey", X.placement(_flags()).alias("phrase"))


def serialized(spark, d):
    p = load(spark, d, "part")
    size = F.col("p_size").cast("double")
    s = X.sentence(F.concat(F.lit("A "), "p_name"), F.lower("p_type"), F.split("p_name", " "), size, F.col("p_retailprice") / 8, size / 4, X.placement(_flags()))
    return p.select("p_partkey", s.alias("text"))


def _dim_sql(c):
    return rf"regexp_replace(printf('%.1f', {c}), '[.]0\z', '')"


_SENTENCE_SQL = f"""SELECT p_partkey, 'A ' || p_name || '. ' || upper(p_type[1]) || lower(p_type[2:]) || ' made of ' || replace(p_name, ' ', ', ') || ', roughly ' ||
{_dim_sql("CAST(p_size AS DOUBLE)")} || ' by ' || {_dim_sql("p_retailprice / 8")} || ' by ' || {_dim_sql("CAST(p_size AS DOUBLE) / 4")} || ' centimetres, ' || {_PLACE_SQL} || '.' AS text FROM part"""


@query(_SENTENCE_SQL)
def serialize_record(spark, d):
    return serialized(spark, d)


# The sentence as SQL text of Spark, written apart from the expressions it is compared with.
_AGAIN = """WITH s AS (SELECT *, array_compact(array(CASE WHEN (p_size & 1) > 0 THEN 'on a ceiling' END, CASE WHEN (p_size & 2) > 0 THEN 'on a wall' END,
CASE WHEN (p_size & 4) > 0 THEN 'on the floor' END, CASE WHEN (p_size & 8) > 0 THEN 'on top of other objects' END)) AS at, '[.]0$' AS end FROM part)
SELECT p_partkey, concat('A ', p_name, '. ', initcap(p_type), ' made of ', replace(p_name, ' ', ', '), ', roughly ', regexp_replace(format_number(CAST(p_size AS DOUBLE), '0.0'), end, ''), ' by ',
regexp_replace(format_number(p_retailprice / 8, '0.0'), end, ''), ' by ', regexp_replace(format_number(CAST(p_size AS DOUBLE) / 4, '0.0'), end, ''), ' centimetres, ',
CASE p_size & 15 WHEN 0 THEN 'with no typical placement' WHEN 12 THEN 'typically placed on the floor or on other objects'
ELSE concat(if((p_size & 3) > 0, 'typically mounted ', 'typically placed '), array_join(at, ' or ')) END, '.') AS again FROM s"""


def differing(one, other):
    """(p_partkey, text, again): rows of which either side is null, missing or another string."""
    return one.join(other, "p_partkey", "full").where(~F.col("text").eqNullSafe(F.col("again"))).select("p_partkey", "text", "again")


@query()
def serializer_diff(spark, d):
    """Rows on which the serialiser and a separately written SQL text differ; none is right."""
    return differing(serialized(spark, d), run_sql(spark, d, _AGAIN))


_TREE = ", ".join(f"l{n} AS (SELECT n, pos // 1024 AS pos, (m + 1023) // 1024 AS m, {'' if n == 1 else 'CASE WHEN m = 1 THEN max(leaf) ELSE '}sha256('{n}' || chr(10) || string_agg(leaf, chr(10) ORDER BY pos)){'' if n == 1 else ' END'} AS leaf FROM l{n - 1} GROUP BY n, pos // 1024, m)" for n in range(1, 5))


@query(f"""WITH s AS ({_SENTENCE_SQL}), l0 AS (SELECT count(*) OVER () AS n, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS m, sha256(text) AS leaf FROM s), {_TREE} SELECT n, leaf AS digest FROM l4""")
def serializer_identity(spark, d):
    """One digest over what the serialiser makes of all parts, in the order of their keys: a
    serialiser that behaves otherwise on any of them has another one."""
    return ordered_digest(serialized(spark, d), [], ["p_partkey"], F.sha2("text", 256))


_FOLD = "CASE trim(lower(m)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.SYNONYMS.items()) + " ELSE trim(lower(m)) END"


@query(f"""WITH m AS (SELECT p_partkey, pos, {_FOLD} AS m FROM (SELECT p_partkey, unnest([split_part(p_name, ' ', 1), ' Wooden ', CASE WHEN p_size % 2 = 0 THEN 'METALS' ELSE 'wood' END, p_type]) AS m, unnest([1, 2, 3, 4]) AS pos FROM part))
SELECT p_partkey, string_agg(m, ',' ORDER BY pos) AS materials FROM (SELECT p_partkey, m, min(pos) AS pos FROM m GROUP BY p_partkey, m) GROUP BY p_partkey""")
def fold_synonyms(spark, d):
    raw = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" Wooden "), F.when(F.col("p_size") % 2 == 0, "METALS").otherwise("wood"), F.col("p_type"))
    return load(spark, d, "part").select("p_partkey", F.array_join(X.fold_synonyms(raw), ",").alias("materials"))


_WORDS = r"regexp_extract_all(lower({}), '\p{{L}}{{3,}}')"


@query(rf"""WITH r AS (SELECT conv_id, turn, role, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b, text FROM conversations),
w AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'Here is one: "' || text || '"' WHEN 1 THEN '```json' || chr(10) || text || '```' WHEN 2 THEN 'The ' || b || ': ' || text ELSE chr(10) || 'Sentence:' || chr(10) || text END AS raw FROM r),
t AS (SELECT *, regexp_replace(regexp_replace(raw, '```[a-z]*', '', 'g'), '^\s+', '') AS t FROM w),
h AS (SELECT *, list_has_any({_WORDS.format(r"regexp_extract(t, '^([^:\n]*):\s', 1)")}, list_concat({_WORDS.format("a")}, {_WORDS.format("b")})) AS told FROM t),
c AS (SELECT *, regexp_replace(CASE WHEN told THEN t ELSE regexp_replace(t, '^[^:\n]*:\s+', '') END, '^\s+|\s+\z', '', 'g') AS c FROM h)
SELECT conv_id, turn, role, regexp_replace(split_part(c, chr(10), 1), '^["'']+|["'']+\z', '', 'g') AS sentence FROM c""")
def unwrap_text(spark, d):
    """Texts as a model wraps them; one wrapping names the second word and stays."""
    c = load(spark, d, "conversations").withColumn("b", F.split_part("text", F.lit(" "), F.lit(2)))
    wraps = [F.concat(F.lit('Here is one: "'), "text", F.lit('"')), F.concat(F.lit("```json\n"), "text", F.lit("```")), F.concat(F.lit("The "), "b", F.lit(": "), "text"), F.concat(F.lit("\nSentence:\n"), "text")]
    raw = F.element_at(F.array(*wraps), (F.col("turn") % 4 + 1).cast("int"))
    return c.select("conv_id", "turn", "role", X.unwrap(raw, F.split_part("text", F.lit(" "), F.lit(1)), F.col("b")).alias("sentence"))


@query("""SELECT doc_id, concat('The last answer failed: ', CASE WHEN length(text) > 1000 THEN 'too long' ELSE 'no category' END,
'. It began: ', substring(text, 1, 300), '. Answer again.') AS prompt FROM documents WHERE text IS NOT NULL""")
def repair_prompt(spark, d):
    why = F.when(F.length("text") > 1000, "too long").otherwise("no category")
    return load(spark, d, "documents").where("text is not null").select("doc_id", X.repair_prompt(F.col("text"), why).alias("prompt"))


@query(f"SELECT doc_id, regexp_matches(text, '{X.COORDINATE_WORDS}') AS forbidden FROM documents")
def forbidden_terms(spark, d):
    return load(spark, d, "documents").select("doc_id", F.col("text").rlike(X.COORDINATE_WORDS).alias("forbidden"))


@query(r"SELECT page_id, regexp_replace(html, '(^|[^\\])%[^\n]*', '\1', 'g') AS stripped FROM pages")
def strip_comments(spark, d):
    return load(spark, d, "pages").select("page_id", F.regexp_replace("html", r"(^|[^\\])%[^\n]*", "$1").alias("stripped"))


@query(r"""WITH b AS (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS bs FROM pages),
e AS (SELECT page_id, unnest(bs) AS block, generate_subscripts(bs, 1) AS pos FROM b)
SELECT page_id, CAST(pos AS BIGINT) AS pos, sha256(block) AS digest, CAST(length(block) AS BIGINT) AS n FROM e""")
def extract_blocks(spark, d):
    p = load(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1)).alias("pos", "block"))
    return p.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.sha2("block", 256).alias("digest"), F.length("block").cast("long").alias("n"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \n\t]+')) + 2 AS BIGINT) AS tokens, len(regexp_extract_all(text, '[^ \n\t]+')) + 2 > 77 AS over FROM documents")
def token_budget(spark, d):
    n = (F.regexp_count("text", F.lit("[^ \\n\\t]+")) + 2).cast("long")
    return load(spark, d, "documents").select("doc_id", n.alias("tokens"), (n > 77).alias("over"))


@query()
def subword_budget(spark, d):
    """Subwords of texts with start and end, and whether an encoder of 77 would cut them."""
    import public_tokenizers

    sent = tokens.merge_table(spark, public_tokenizers.path("word_bpe_49k.json"))
    n = tokens.token_counts(load(spark, d, "documents").select("doc_id", "text"), "text", sent)
    return n.select("doc_id", "tokens", (F.col("tokens") > 77).alias("over"))


@F.pandas_udf(T.StringType())
def _foreign(texts: pd.Series) -> pd.Series:
    import re
    import unicodedata

    def fits(c):
        name = unicodedata.name(c, "")
        return name.startswith(("LATIN", "COMBINING")) or unicodedata.category(c)[0] == "N" or (unicodedata.category(c)[0] in "PSZC" and ord(c) < 0x2100)

    seen: dict[str, bool] = {}
    out = []
    for t in texts:
        chars = dict.fromkeys(re.findall(r"[^\x00-\x7f]", t or ""))
        out.append("".join(c for c in chars if not seen.setdefault(c, fits(c))))
    return pd.Series(out)


@query()
def non_latin_chars(spark, d):
    """Characters of no Latin script, in order of first appearance."""
    return load(spark, d, "documents").select("doc_id", _foreign(F.regexp_replace("text", "[\\x00-\\x7F]", "")).alias("foreign"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l)
SELECT printf('%s_%05d', CAST(doc_id AS VARCHAR), n - 1) AS house, CAST(length(line) AS BIGINT) AS n_chars FROM e WHERE trim(line) <> ''""")
def house_ids(spark, d):
    """A key from source and line number; blank lines are counted but give no row."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.trim("line") != "")
    return lines.select(F.format_string("%s_%05d", F.col("doc_id").cast("string"), "n").alias("house"), F.length("line").cast("long").alias("n_chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def parse_props(spark, d):
    return load(spark, d, "events").where(F.try_parse_json("props").isNotNull()).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'Sure: ```json ' || props || '``` done' END AS raw FROM events)
SELECT event_id, CAST(json_extract_string(nullif(regexp_extract(raw, '(?s)(\{.*\})', 1), ''), '$.k') AS BIGINT) AS k FROM r""")
def extract_json(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.concat(F.lit("Sure: ```json "), "props", F.lit("``` done")))
    return load(spark, d, "events").select("event_id", F.get_json_object(X.json_object(raw), "$.k").cast("long").alias("k"))


@query("""SELECT DISTINCT sha256(concat('["', least(p_type, p_brand), '","', greatest(p_type, p_brand), '","v1"]')) AS pair_key, least(p_type, p_brand) AS a, greatest(p_type, p_brand) AS b FROM part""")
def pair_key(spark, d):
    a, b = symmetric(F.col("p_type"), F.col("p_brand"))
    key = F.sha2(F.to_json(F.array(a, b, F.lit("v1"))), 256)
    return load(spark, d, "part").select(key.alias("pair_key"), a.alias("a"), b.alias("b")).distinct()


@query("SELECT p_partkey, CAST('0x' || substring(sha256(CAST(p_partkey AS VARCHAR)), 9, 8) AS BIGINT) AS seed FROM part")
def uid_seed(spark, d):
    digest = F.sha2(F.col("p_partkey").cast("string"), 256)  # the low half of its first 8 bytes
    return load(spark, d, "part").select("p_partkey", F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").alias("seed"))


@query("SELECT doc_id, sha256(text) AS digest, sha256(text) = sha256(trim(text)) AS matches FROM documents")
def record_digest(spark, d):
    digest = X.content_digest(F.col("text"))
    return load(spark, d, "documents").select("doc_id", digest.alias("digest"), (digest == X.content_digest(F.trim("text"))).alias("matches"))


@query()
def config_hash(spark, d):
    """Digest of a settings table in key order, whatever order it arrives in."""
    rows = load(spark, d, "nation").select(F.struct(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")).alias("e"))
    return rows.agg(F.sha2(F.to_json(F.map_from_entries(F.sort_array(F.collect_list("e")))), 256).alias("config_hash"))


@query("""WITH base AS (SELECT n_nationkey AS k, n_name AS v FROM nation), over AS (SELECT n_nationkey AS k, upper(n_name) AS v FROM nation WHERE n_nationkey % 3 = 0)
SELECT base.k, coalesce(over.v, base.v) AS v, over.k IS NOT NULL AS overridden, sha256(concat(CAST(base.k AS VARCHAR(20)), ':', coalesce(over.v, base.v))) AS digest FROM base LEFT JOIN over ON base.k = over.k""")
def config_merge(spark, d):
    n = load(spark, d, "nation")
    over = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("v"))
    return X.overridden(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), over, "k", "v")
