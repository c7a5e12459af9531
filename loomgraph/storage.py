"""Places that driver and executors share: lineage cuts, and tables that are written once and read again."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where it is unset, on a local master."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-checkpoints-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a side that may be broadcast after they have been counted; beyond them the join shuffles.
BROADCAST_ROWS = 100_000


def small_or_not(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has been counted to have `most` rows (BROADCAST_ROWS) at most, else df for a shuffled join."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def signature(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the paths with the sizes and times of what lies there: it changes when a table does."""
    seen = []
    for path in paths:
        fs, where = _files(spark, path)
        for status in fs.listStatus(where) if fs.exists(where) else []:
            seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join([*paths, *sorted(seen)]).encode()).hexdigest()


def written_once(spark: SparkSession, key: str, write: Callable[[str], None]) -> str:
    """The path of what write(path) has written under this key, now or earlier. It is written beside and then renamed, so a
    half-written one is never read."""
    path = f"{shared_dir(spark)}/{key}"
    fs, where = _files(spark, path)
    if not fs.exists(where):
        beside = f"{path}-{uuid.uuid4().hex}"
        write(beside)
        if not fs.rename(_files(spark, beside)[1], where) and not fs.exists(where):
            raise OSError(f"can't write {path}")
    return path


def numbered(df: DataFrame, order: list, out: str = "position") -> DataFrame:
    """df with its rows numbered from 0 in this order, without all rows in one task: they are dealt out by ranges, and what
    the parts before hold is added to each place. The dealt rows are checkpointed, so the parts stay what they are."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    ends: dict[int, int] = {}
    total = 0
    for part, n in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each part
        ends[part] = total
        total += n
    if not ends:
        return dealt.drop("_part", "_place").withColumn(out, F.lit(0).cast("long"))
    before = df.sparkSession.createDataFrame(list(ends.items()), "_part int, _before long")
    return dealt.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
