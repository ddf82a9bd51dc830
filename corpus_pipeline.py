"""The corpus pipeline: toxicity, near copies, benchmark leaks, source mix and shards.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import decontam, jaccard, mixing, sharding, toxicity
from orbweave.llm.common import cut, plain, shared_folder, table, unused

#: A document goes at this toxicity, as op3_toxicity calls it; shards of the result; words
#: and similarity of copies.
TOXIC, SHARDS, WORDS, SIMILAR = 0.3, 40, 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores under TOXIC; null and empty texts score too. The score is
    the text's alone, so equal texts stay or go together, whatever their ids."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train_toxicity(table(spark, sf_dir, "documents"), labels)
    score, spans = unused(docs, "toxic_score", "toxic_spans")
    scored = toxicity.score_toxicity(docs, model, score_col=score, spans_col=spans)
    return scored.where(F.col(score) < TOXIC).select(*map(plain, docs.columns))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column that names each row whatever its id: its file and place there.
    Rows that don't come straight from files get a number that a checkpoint keeps."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select("*", F.struct(place["file_path"], place["row_index"]).alias(name))
    except AnalysisException:
        return cut(docs.select("*", F.struct(F.monotonically_increasing_id().alias("row_index")).alias(name)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: of the smallest doc_id (null last), and of equal ids
    the first one by file and place. Rows without words are no one's copies and stay."""
    (row,) = unused(docs, "row")
    rows = numbered(docs, row)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    kind = jaccard.jaccard_classes(rows.select(name.alias("doc_id"), "text"), WORDS, SIMILAR, 100)
    copies = kind.where("doc_id <> component_id").select(F.col("doc_id.row").alias(row))
    return rows.join(copies, row, "left_anti").select(*map(plain, docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in whose text no benchmark item occurs, judged row by row whatever their ids.
    A null or empty text holds none and stays; without rows or items nothing goes."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as often as the mix takes them. A null source is a source; a column that
    is named like one of mix_sources' results comes back as it was. No rows give none."""
    names = unused(docs, *(f"c{i}" for i in range(len(docs.columns))), "copy")
    inner = dict(zip(docs.columns, names))
    mixed = mixing.mix_sources(docs.toDF(*names[:-1]), mixing.cycle_weights, id_col=inner["doc_id"], text_col=inner["text"], source_col=inner["source"])
    again = mixed.where("mix_copies > 0").withColumn(names[-1], F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return again.select(*(F.col(inner[c]).alias(c) for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; repeated rows get slots of their own. A null text has size 16; no rows give none."""
    return sharding.assign_shards(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: Fitted scores and similarity joins aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again. A table
    goes when the next one is there; that of the last written stage stays, as the rows come
    from it."""
    docs, at, old = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if old:
            path = spark._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        old = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
