"""Fact updates as a stream: bi-temporal upserts, as-of views, and windowed aggregates with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(facts: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; equal times go to the larger tie-break."""
    rest = [c for c in facts.columns if c not in key]
    return facts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def superseded(facts: DataFrame, key: list[str], at: str = "valid_at", tie: str = "edge_id") -> DataFrame:
    """facts with invalid_at, the time from which a later fact of the same key holds; the last one's is open."""
    return facts.withColumn("invalid_at", F.lead(at).over(Window.partitionBy(*key).orderBy(at, tie)))


def as_of(facts: DataFrame, moment) -> DataFrame:
    """Facts that hold at a moment."""
    return facts.filter((F.col("valid_at") <= moment) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > moment)))


def upsert_to(path: str, key: list[str], at: str, tie: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key under path/batch=<n>. A batch that is run again writes the
    same folder anew, and late or repeated rows change nothing that is newer."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
        earlier = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(files) if s.getPath().getName().startswith("batch=")) if fs.exists(files) else []
        earlier = [n for n in earlier if n < number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/_SUCCESS"))]
        rows = batch if not earlier else batch.unionByName(spark.read.parquet(f"{path}/batch={earlier[-1]}"))
        latest(rows, key, at, tie).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for n in earlier[:-1]:  # the last full state stays for a batch that must be run again
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}"), True)

    return sink


def tumbling(events: DataFrame, at: str, width: str, late: str | None = None, by: list[str] = ()) -> DataFrame:
    """Counts and sums in windows of a fixed width; with `late` for streams that may be so much out of order."""
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts in sessions that end after a gap."""
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, at: str, key: list[str], late: str) -> DataFrame:
    """Events without repeats that arrive within the lateness."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, checkpoint: str, out: str, mode: str = "complete", key: list[str] = ()) -> DataFrame:
    """Runs a streaming query over what is there, and returns its table. Each batch's rows go to files under out/batch=<n>, and
    a batch that is run again writes the same folder anew, so nothing passes through the driver. complete: the last batch
    is the table; update: each key's row of the latest batch; append: all rows."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == F.lit(last))
    elif mode == "update":
        rows = latest(rows, list(key), "batch", "batch")
    return rows.select(*stream.columns)


def append_results(stream: DataFrame, out: str, checkpoint: str, form: str = "json"):
    """Appends results as they are ready; files and checkpoint together make each row appear once. Returns when all that is
    there has been written."""
    q = stream.writeStream.format(form).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
