"""Bounded samples of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_fold(c: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null ids: fold of "")."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, label) of at most `bound` labelled documents, those first by md5 of the id.

    `labels`: doc_id, label (0 or 1); rows with a null in either are left out, and of
    several labels for one id the larger holds. The bound makes the broadcast safe.
    """
    ids = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def fit_in_task(docs: DataFrame, labels: DataFrame, bound: int, max_chars: int, fit: Callable, kind: type):
    """The model, of the dataclass `kind`, that fit(texts, labels) makes of the sample in one
    task: the sample is bounded, and only the model's fields come to the driver.
    Training texts longer than max_chars are left out.

    Rows are sorted, so a task that is run again fits the same model. An empty sample fits
    on nothing.
    """
    s = labelled_sample(docs, labels, bound).select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    s = s.where(F.length("text") <= max_chars).repartition(1).sortWithinPartitions(F.md5("text"), "label")

    def run(batches):
        import pyarrow as pa

        rows = list(batches)
        if rows:
            t = pa.Table.from_batches(rows)
            model = pickle.dumps(vars(fit(t["text"], t["label"].to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = s.mapInArrow(run, "model binary").collect()
    return kind(**pickle.loads(made[0]["model"])) if made else fit([], [])
