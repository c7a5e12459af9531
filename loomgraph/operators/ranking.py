"""Rankings and averages over a metric, with values recovered from fact texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expressions import is_growth, name_contains, segment_of, usable_value, value_of
from loomgraph.graph import PropertyGraph


def metric_rows(g: PropertyGraph, kind: str, metric: str | None = None, rels: list[str] | None = None, segment_rel: str | None = None, real: Iterable[str] = (), known: dict[str, str] | None = None, growth: bool = False) -> DataFrame:
    """(edge_id, subject_id, subject_name, object_name, fact, value, segment) of the usable values of nodes of a kind.

    Facts about growth are left out unless wanted; a value that is missing or no percentage is read from the fact; rows
    without either are dropped. The segment comes from the tag if it is a real one, else from `known`; of several tags the
    first by edge counts."""
    objects = g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("object_name"))
    if metric is not None:
        objects = objects.filter(name_contains(F.col("object_name"), F.lit(metric), ratio=True))
    subjects = g.of_type(kind).select(F.col("id").alias("src"), F.col("name").alias("subject_name"))
    rows = g.adjacency(*(rels or [])).join(objects, "dst").join(subjects, "src")
    rows = rows if growth else rows.filter(~is_growth(F.col("fact")))
    rows = rows.withColumn("value", usable_value(value_of(g.edges.columns), F.col("fact"))).filter("value IS NOT NULL")
    if segment_rel:
        tags = g.with_rel(segment_rel).join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("tag")), "dst")
        if real:
            tags = tags.filter(F.col("tag").isin(*real))
        tags = tags.groupBy("src").agg(F.min_by("tag", "edge_id").alias("tag"))
        rows = rows.join(tags, "src", "left")
        segment = segment_of(F.col("subject_name"), F.col("tag"), real, known or {}) if real else F.col("tag")
    else:
        segment = F.lit(None).cast("string")
    return rows.select("edge_id", F.col("src").alias("subject_id"), "subject_name", "object_name", "fact", "value", segment.alias("segment"))


def global_rank(rows: DataFrame, largest: bool = True, segment: str | None = None) -> DataFrame:
    """The one row of largest or smallest value, ties by lowest edge; within a segment where one is given."""
    rows = rows if segment is None else rows.filter(F.col("segment") == segment)
    v = F.col("value")
    out = "max_value" if largest else "min_value"
    return rows.orderBy(v.desc() if largest else v.asc(), "edge_id").limit(1).select("subject_id", "subject_name", "object_name", "fact", v.alias(out))


def first_values(rows: DataFrame) -> DataFrame:
    """The first usable value of each subject and segment, in the order of edges."""
    return rows.filter("segment IS NOT NULL").groupBy("segment", "subject_id").agg(F.min_by("value", "edge_id").alias("value"))


def segment_averages(rows: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """Mean and number of subjects for each segment."""
    rows = rows if not segments else rows.filter(F.col("segment").isin(*segments))
    return first_values(rows).groupBy("segment").agg(F.round(F.avg("value"), 2).alias("avg_value"), F.count(F.lit(1)).alias("company_count")).withColumnRenamed("segment", "subject_name")


def segment_rank(rows: DataFrame, largest: bool = True) -> DataFrame:
    """All segments by their averages, with their rank."""
    averages = segment_averages(rows)
    order = [F.col("avg_value").desc() if largest else F.col("avg_value").asc(), F.col("subject_name")]
    return averages.orderBy(*order)


def group_vs_group(rows: DataFrame, segments: list[str]) -> DataFrame:
    return segment_averages(rows, segments).orderBy("subject_name")


def group_average(g: PropertyGraph, segment_rel: str, rels: list[str]) -> DataFrame:
    """Plain mean of stored values for each group and number of its members, nulls left out; all groups, best first."""
    member = g.with_rel(segment_rel).select("src", F.col("dst").alias("group_id")).distinct()
    rows = g.with_rel(*rels).join(member, "src")
    means = rows.groupBy("group_id").agg(F.avg("value").alias("avg_value"), F.count_distinct("src").alias("company_count"))
    return means.join(g.nodes.select(F.col("id").alias("group_id"), F.col("name").alias("segment_name")), "group_id").select("segment_name", "avg_value", "company_count")


def company_to_group(rows: DataFrame, subject: str | None = None) -> DataFrame:
    """Each subject's own first value against the mean of its segment's other members (all subjects, or one).

    Sums and counts for each segment are joined once, so subjects aren't paired with their peers."""
    values = first_values(rows)
    totals = values.groupBy("segment").agg(F.sum(F.col("value").cast("decimal(30,8)")).alias("total"), F.count(F.lit(1)).alias("members"))
    own = values if subject is None else values.filter(F.col("subject_id") == subject)
    peers = F.col("members") - 1
    mean = F.when(peers > 0, F.round((F.col("total").cast("double") - F.col("value")) / peers, 2))
    return own.join(totals, "segment").select("subject_id", F.col("segment").alias("segment_name"), "value", mean.alias("segment_average"), peers.alias("peer_count"))


def own_value(rows: DataFrame, subject: str) -> DataFrame:
    """One company's own value."""
    return rows.filter(F.col("subject_id") == subject).orderBy("edge_id").limit(1)
