"""Settled answers: a model is asked once for each distinct question, in all runs together.

Answers live in a folder that only grows, keyed by what was asked. A run asks for the keys
that the folder lacks, appends what it got, and joins the folder back to its questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.operators.models import encode, write_checked
from orbweave.sources.tables import json_lines, kept, stored


def content_key(values: list[Column], versions: list[str]) -> Column:
    """A digest of what is asked and of the versions of prompt and model. Values keep their
    order and their bounds, so that ("ab", "c") and ("a", "bc") differ; null is a value."""
    parts = F.array(*[v.cast("string") for v in values], *[F.lit(v) for v in versions])
    return F.sha2(F.to_json(F.struct(parts.alias("k")), {"ignoreNullFields": "false"}), 256)


def symmetric(a: Column, b: Column) -> list[Column]:
    """Two values in one order, whichever way round they came; a null is the lesser one."""
    swap = b.isNull() | (a > b)
    return [F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)]


class JsonStore:
    """Answers as JSON lines. A line that a killed writer tore counts as not there, so its
    question is asked again; of several whole lines of one key one that gives an answer
    stands, else the least, whatever order they came in."""

    def __init__(self, path: str, schema: str, key: str = "key", degraded: str = "degraded") -> None:
        self.path, self.schema, self.key, self.degraded = path, schema, key, degraded

    def read(self, spark) -> DataFrame:
        raw = T.StructType([T.StructField("value", T.StringType())])
        if not _there(spark, self.path):
            return spark.createDataFrame([], raw).select(F.from_json("value", self.schema).alias("r")).select("r.*")
        good, _ = json_lines(spark, self.path, self.schema, [self.key, self.degraded])
        good = good.drop("file")
        rest = [c for c in good.columns if c != self.key]
        one = F.min_by(F.struct(*rest), F.struct(self.degraded, *[c for c in rest if c != self.degraded]))
        return good.groupBy(self.key).agg(one.alias("r")).select(self.key, "r.*")

    def append(self, answers: DataFrame) -> None:
        line = F.to_json(F.struct(*answers.columns), {"ignoreNullFields": "false"})
        answers.select(line.alias("value")).write.mode("append").text(self.path)


class ParquetStore:
    """Answers as Parquet, for vectors; of several rows of one key one stands."""

    def __init__(self, path: str, schema: str, key: str = "key") -> None:
        self.path, self.schema, self.key = path, schema, key

    def read(self, spark) -> DataFrame:
        return stored(spark, self.path, T.DataType.fromDDL(self.schema)).dropDuplicates([self.key])

    def append(self, answers: DataFrame) -> None:
        answers.write.mode("append").parquet(self.path)


def _there(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def settle(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], store, waves: int = 1) -> DataFrame:
    """`questions` with their answers; the key is the column named by the store.

    Rows of one key ask the same; one of them (the least) is put to answer(rows), which
    gives the key and the store's other columns. Keys that the store holds aren't asked. The
    rest is asked in `waves` by hash of the key, and a wave's answers are committed at once:
    a run that is killed loses one wave at most. Within a wave a task that is lost is asked
    again. Rows with a null key are not asked and get nulls. One run at a time may write.
    """
    spark, key = questions.sparkSession, store.key
    rest = [c for c in questions.columns if c != key]
    asked = questions.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    todo = kept(asked.join(store.read(spark).select(key), key, "left_anti"))
    for w in range(waves):
        wave = todo.where(F.pmod(F.xxhash64(key), F.lit(waves)) == w)
        if wave.limit(1).count():
            store.append(answer(wave))
    return questions.join(store.read(spark), key, "left")


def settle_texts(questions: DataFrame, prompt: str, load: Callable[[], Callable], check: Callable[[str], str | None], repair: Callable[[str, str, str], str], path: str, attempts: int = 2, waves: int = 1) -> DataFrame:
    """`questions` (with columns key and `prompt`) with attempts, text, reason and degraded.

    See write_checked for the rule. What fails `attempts` times is settled too: its text is
    null and degraded true, so that it is neither asked again nor taken for an answer.
    """
    store = JsonStore(path, "key string, attempts int, text string, reason string, degraded boolean")

    def answer(rows: DataFrame) -> DataFrame:
        got = write_checked(rows, "key", prompt, load, check, repair, attempts)
        return got.withColumn("degraded", F.col("text").isNull())

    return settle(questions, answer, store, waves)


def settle_vectors(rows: DataFrame, column: str, versions: list[str], load: Callable[[], Callable], width: int, path: str, batch: int = 256, waves: int = 1, normalise: bool = True) -> DataFrame:
    """`rows` with an embedding of `column`: each distinct value is encoded once. A null has a
    null vector and isn't sent; see encode for what raises."""
    key = F.when(F.col(column).isNotNull(), content_key([F.col(column)], versions))
    store = ParquetStore(path, "key string, embedding array<double>")
    asked = rows.select(column, key.alias("key")).distinct()
    got = settle(asked, lambda r: encode(r, column, load, width, batch, normalise=normalise).select("key", "embedding"), store, waves)
    return rows.join(got.where("key is not null").select(column, "embedding"), column, "left")
