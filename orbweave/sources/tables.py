"""Tables, stand-in projections and the merge rules of named datasets."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NODE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object instances of houses: (house, idx, asset, x, y, z), idx gapless from 0.

    Columns get their names before rows are dealt by house, so that what groups by house later
    finds them dealt, and their values afterwards, so that nothing is sent twice."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("house"), *NODE_ORDER)
    idx = F.row_number().over(W.partitionBy("house").orderBy(*NODE_ORDER)) - 1
    placed = li.withColumn("idx", idx.cast("long"))
    return placed.select("house", "idx", F.col("l_partkey").alias("asset"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"))


NODES_SQL = f"""nodes AS (SELECT l_orderkey AS house, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(NODE_ORDER)}) - 1 AS BIGINT) AS idx,
  l_partkey AS asset, l_quantity AS x, l_extendedprice / 1000 AS y, l_tax * 100 AS z FROM lineitem)"""


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where
    none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orbweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a checkpoint that survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# --- scans ------------------------------------------------------------------------------------


def one_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more; parsers stop after a first value."""
    listed = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1), F.lit(False))


def _parsed(raw: DataFrame, schema, required: list[str], where: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of a column `value` of JSON texts; `where` names each one's place."""
    r = F.from_json("value", schema)
    lacks = F.filter(F.array(*[F.when(r[c].isNull(), F.lit(c)) for c in required] or [F.lit(None).cast("string")]), lambda c: c.isNotNull())
    why = F.when(~one_json(F.col("value")), "not JSON").when(r.isNull() | ~F.trim("value").startswith("{"), "not an object")
    why = why.when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(lacks, ", ")))
    tried = raw.select("*", r.alias("r_"), why.alias("reason"))
    return tried.where("reason is null").select(where, "r_.*"), tried.where("reason is not null").select(where, "value", "reason")


def json_lines(spark: SparkSession, path: str, schema, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of a folder of JSON lines, with each line's file.

    A line that a killed writer tore, that is no object or lacks a `required` field goes to
    quarantine with the reason; blank lines count nowhere.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return _parsed(lines, schema, required or [], "file")


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 0 in each file.

    A file may be read in several splits: a split's lines come in order, and the counts of a
    file's earlier splits are added, of which there is one row each. Blank lines count.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    sizes = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "split", (before - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "split"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def keyed_json_lines(spark: SparkSession, path: str, schema, required: list[str] | None = None, digits: int = 5, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of files of JSON lines, with the key "<name>_<line>" and the file.

    The name comes from the column `file` (by default its stem). Lines count from 0, blank
    ones too, which give no row; see json_lines."""
    name = F.url_decode(F.regexp_extract("file", r"([^/]+?)(\.[^/.]*)*$", 1)) if name is None else name
    key = F.concat(name, F.lit("_"), F.lpad(F.col("line").cast("string"), F.greatest(F.lit(digits), F.length(F.col("line").cast("string"))), F.lit("0")))
    lines = line_numbers(spark, path).where(F.trim("value") != "").select(F.struct(key.alias("key"), "file").alias("at"), "value")
    good, bad = _parsed(lines, schema, required or [], "at")
    return good.select("at.*", *[c for c in good.columns if c != "at"]), bad.select("at.*", "value", "reason")


def record_folder(spark: SparkSession, path: str, schema, required: list[str] | None = None, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of a folder that holds a record a file; see json_lines. Torn
    characters are quarantined too; files of no bytes are not rows to Spark and give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    return _parsed(files.select(F.col("path").alias("file"), text.alias("value")), schema, required or [], "file")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(uid, path) of files that hold a JSON object of paths by uid; of a uid in several, the
    least path. A file that is no such object raises."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    entries = F.from_json("value", "map<string,string>")
    bad = F.raise_error(F.concat(F.lit("no manifest: "), "file"))
    rows = text.select(F.explode(F.when(one_json(F.col("value")) & entries.isNotNull(), entries).otherwise(bad.cast("map<string,string>"))).alias("uid", "path"))
    return rows.groupBy("uid").agg(F.min("path").alias("path"))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", least_bytes: int = 0) -> DataFrame:
    """(path, length) of files, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").where(F.col("length") > least_bytes)


# --- merge rules and sinks --------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key, whichever side it came from; of equal
    versions the greatest row."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("r")).select(*keys, "r.*").select(*old.columns)


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def conflicts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows): keys that have more than one different row over both sides."""
    rest = F.to_json(F.struct(*[F.col(c) for c in sorted(set(old.columns) - set(keys))]), {"ignoreNullFields": "false"})
    rows = old.unionByName(new).groupBy(*keys, F.sha2(rest, 256).alias("row_")).count()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def write_once(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key `old` lacks, one of each. A second, different row of a key
    raises, whether the first one is in `old` or in `new`; nulls are values."""
    first = conflicts(old, new, keys).first()
    if first is not None:
        raise ValueError(f"a write-once row would change: {({k: first[k] for k in keys})}")
    return new.join(old, _same(new, old, keys), "left_anti").dropDuplicates(keys)


def numeric_add(ledger: DataFrame, keys: list[str], value: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.sum(value).alias(value))


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at `path`, or an empty one of the schema where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key the target lacks, one of each; a second call with the same rows
    appends nothing. The job's commit makes all of them visible at once. One writer at a time."""
    old = stored(spark, path, new.schema)
    new.join(old, _same(new, old, keys), "left_anti").dropDuplicates(keys).write.mode("append").parquet(path)


def no_clobber(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Append under the rule of write_once: a stored record never changes. One writer at a time."""
    write_once(stored(spark, path, new.schema), new, keys).write.mode("append").parquet(path)


def index_descriptor(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(count, dim, digest): the digest sums row hashes, so neither order nor partitions
    matter and nothing is gathered."""
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(id_col, vec_col)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return vectors.agg(F.count("*").alias("count"), F.max(F.size(vec_col)).alias("dim"), F.sum(part).cast("string").alias("digest"))


def write_vectors(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Write an index as float vectors of one width, and describe what was written. Another
    width, a null id or a repeated one raises and leaves nothing behind."""
    rows = vectors.select(id_col, F.col(vec_col).cast("array<float>").alias(vec_col))
    sizes = rows.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("ids"), F.count_distinct(F.size(vec_col)).alias("widths")).first()
    if sizes["ids"] != sizes["n"] or sizes["widths"] > 1:
        raise ValueError(f"an index of {sizes['n']} rows has {sizes['ids']} ids and {sizes['widths']} widths")
    rows.write.parquet(path)
    return index_descriptor(vectors.sparkSession.read.parquet(path), id_col, vec_col).withColumn("uri", F.lit(path))
