"""Facts of a stream as a log of runs: a batch writes only what it brings, and runs of like size are merged now and then.

A run is a folder run=<first>-<last> of the batches that it holds. Readers take the widest finished runs, so a merge that is cut off
is as if it had never begun, and a batch that is run again writes its run anew or finds itself merged already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.streaming.updates import latest, superseded

#: Runs of one size that are merged into one of the next.
FANOUT = 4


@dataclass(frozen=True)
class FactLog:
    """The facts under a path. key: what a fact is about; at: when it begins to hold; tie: what decides between equal times.
    history: whether all facts are kept, each once, or only each key's newest."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    at: str = "valid_at"
    tie: str = "edge_id"
    history: bool = False
    fanout: int = FANOUT

    def _kept(self, rows: DataFrame) -> DataFrame:
        """What is left of rows when repeats and, without history, older facts go. The order in which rows came doesn't matter."""
        names = self.schema.names
        return rows.select(*names).distinct() if self.history else latest(rows.select(*names), list(self.key), self.at, self.tie).select(*names)

    def _files(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def runs(self, spark: SparkSession) -> list[tuple[int, int]]:
        """The finished runs that no wider one holds, in order."""
        fs, top = self._files(spark, self.path)
        found = []
        for status in fs.listStatus(top) if fs.exists(top) else []:
            name = status.getPath().getName()
            if name.startswith("run=") and fs.exists(self._files(spark, f"{self.path}/{name}/_SUCCESS")[1]):
                first, last = name[4:].split("-")
                found.append((int(first), int(last)))
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _read(self, spark: SparkSession, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/run={a}-{b}" for a, b in runs])

    def sink(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: writes the batch as a run, then merges runs where there are enough of one size."""
        spark = batch.sparkSession
        if not any(a <= number <= b and (a, b) != (number, number) for a, b in self.runs(spark)):
            self._kept(batch).write.mode("overwrite").parquet(f"{self.path}/run={number}-{number}")
        self.compact(spark)

    def compact(self, spark: SparkSession) -> None:
        """Merges the last `fanout` neighbouring runs of one size, again and again; a row is rewritten once for each size, so writing
        n batches costs n log n, not n². Runs that a finished one holds are removed."""
        while True:
            runs = self.runs(spark)
            size = lambda r: r[1] - r[0] + 1
            some = runs[-self.fanout :]
            if len(some) < self.fanout or len({size(r) for r in some}) > 1 or any(x[1] + 1 != y[0] for x, y in zip(some, some[1:])):
                return
            self._kept(self._read(spark, some)).write.mode("overwrite").parquet(f"{self.path}/run={some[0][0]}-{some[-1][1]}")
            for a, b in some:
                fs, old = self._files(spark, f"{self.path}/run={a}-{b}")
                fs.delete(old, True)

    def newest(self, spark: SparkSession) -> DataFrame:
        """Each key's newest fact."""
        return latest(self._read(spark, self.runs(spark)), list(self.key), self.at, self.tie).select(*self.schema.names)

    def facts(self, spark: SparkSession) -> DataFrame:
        """All facts, each once, with invalid_at: the time from which a later one about the same holds, whenever that came in."""
        if not self.history:
            raise ValueError("this log keeps only the newest facts")
        rows = self._read(spark, self.runs(spark)).distinct()
        return superseded(rows.drop("invalid_at"), list(self.key), self.at, self.tie)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes in all that a stream has."""
        stream.writeStream.foreachBatch(self.sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def entity_facts(events: DataFrame, subject: str, kind: str, at: str, tie: str, value: str) -> DataFrame:
    """Events as facts (src, rel, valid_at, edge_id, value) of what happened to whom."""
    return events.select(F.col(subject).cast("string").alias("src"), F.col(kind).alias("rel"), F.col(at).cast("timestamp").alias("valid_at"), F.col(tie).cast("long").alias("edge_id"), F.col(value).cast("double").alias("value"))
