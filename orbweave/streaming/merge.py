"""Merging a stream into a table so that a batch counts once, however often it is run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.tables import remove, upsert


class MergedTable:
    """A table of one row a key below a folder, merged from numbered batches.

    Each batch is kept under its number: run again, it replaces itself, so a batch that was
    written but never committed by its stream changes nothing when it is repeated. Folders
    that a killed writer left without a marker of success aren't read. compact() folds
    batches into a base that says up to which number it goes; a reader takes the newest base
    and the batches after it, so a compaction that is killed at any point changes nothing
    either. One stream writes.

    With `version`, a key has its row of the highest version, whichever batch that came in
    (of equal versions the greatest row). Without, the other columns are numbers and add up.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], version: str | None = None) -> None:
        self.spark, self.path, self.keys, self.version = spark, path, keys, version
        self.schema = spark.createDataFrame([], schema).schema

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of complete folders, ascending; compaction bounds how many there are."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(re.search(rf"{kind}=(\d+)/", str(f.getPath()))[1]) for f in found or [])

    def _merged(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        if self.version:
            return upsert(rows, rows.limit(0), self.keys, self.version)
        return rows.groupBy(*self.keys).agg(*[F.sum(c).cast(self.schema[c].dataType).alias(c) for c in rest]).select(*self.schema.names)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _parts(self) -> tuple[list[str], int]:
        base = self._numbers("upto")[-1:]
        upto = base[0] if base else -1
        later = [n for n in self._numbers("batch") if n > upto]
        return [f"{self.path}/upto={n}" for n in base] + [f"{self.path}/batch={n}" for n in later], max([upto, *later])

    def apply(self, batch: DataFrame, number: int) -> None:
        """Write a batch under its number; what a base already holds is not written again."""
        if number > max(self._numbers("upto"), default=-1):
            self._merged(batch.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        return self._merged(self._read(self._parts()[0]))

    def compact(self) -> None:
        """Fold all complete batches into a new base and remove what it holds."""
        folders, upto = self._parts()
        if len(folders) < 2:
            return
        self._merged(self._read(folders)).write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
        self.clean()

    def clean(self) -> None:
        """Remove what the newest base holds."""
        base = self._numbers("upto")
        for kind in ("upto", "batch"):
            for n in self._numbers(kind):
                if base and (n < base[-1] or kind == "batch" and n == base[-1]):
                    remove(self.spark, f"{self.path}/{kind}={n}")


def merge_stream(stream: DataFrame, table: MergedTable, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda b: b, compact_every: int = 50, after: Callable[[int], None] = lambda n: None) -> None:
    """Merge what a stream holds now into `table`, and stop; a second call goes on from there.

    shape(batch) gives the table's columns. after(number) runs between a batch's write and its
    commit by the stream. `checkpoint` is the stream's, in a folder that all executors share.
    """

    def keep(batch: DataFrame, number: int) -> None:
        table.apply(shape(batch), number)
        if number % compact_every == compact_every - 1:
            table.compact()
        after(number)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
