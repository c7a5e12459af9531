"""Queries for ingestion: resolved entities, facts that end one another, and facts that a stream brings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.catalogue import query
from loomgraph.plans.testgraph import table
from loomgraph.sources import resolution
from loomgraph.storage import shared_dir
from loomgraph.streaming.factlog import FactLog, entity_facts

#: Four ways in which a part's name is written, and the share from which other names are alike: 'old gear' isn't 'cold gear'.
_WRITTEN = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(p_name, ' Ltd.') ELSE concat('The ', p_name, ', Inc.') END"
_ALIKE = 0.9
_CANONICAL = f"""used AS (SELECT p_name, {_WRITTEN} AS name, count(*) AS uses FROM part GROUP BY ALL),
best AS (SELECT p_name, name AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY uses DESC, length(name) DESC, name) AS k FROM used) WHERE k = 1)"""


@query(f"WITH {_CANONICAL} SELECT DISTINCT name, canonical FROM used JOIN best USING (p_name)")
def entities_resolved(spark, sf_dir) -> DataFrame:
    """The names of all parts as they are written, each with the name that stands for its group."""
    return resolution.resolved(table(spark, sf_dir, "part").select(F.expr(_WRITTEN).alias("name")), _ALIKE)


@query(
    f"""WITH {_CANONICAL}, facts AS (SELECT DISTINCT best.canonical AS subject, p_brand AS object, 1000000 + p_partkey * 60 AS since FROM part JOIN best USING (p_name)),
changes AS (SELECT * FROM (SELECT *, lag(object) OVER w AS was FROM facts WINDOW w AS (PARTITION BY subject ORDER BY since, object)) WHERE was IS NULL OR was <> object),
ends AS (SELECT *, lead(since) OVER (PARTITION BY subject ORDER BY since, object) AS until FROM changes)
SELECT f.subject, f.object, f.since AS valid_second, CAST(until AS BIGINT) AS invalid_second FROM facts f LEFT JOIN ends e ON e.subject = f.subject AND e.object = f.object AND e.since = f.since"""
)
def facts_resolved(spark, sf_dir) -> DataFrame:
    """Whose brand each part has, minute by minute, over resolved names; a brand holds until another one does."""
    p = table(spark, sf_dir, "part")
    facts = p.select(F.expr(_WRITTEN).alias("subject"), F.lit("HELD_BY").alias("rel"), F.col("p_brand").alias("object"), F.lit("held").alias("fact"), F.timestamp_seconds(1000000 + F.col("p_partkey") * 60).alias("valid_at"))
    g, _ = resolution.resolved_graph(facts, ["HELD_BY"], _ALIKE)
    named = lambda key, out: g.nodes.select(F.col("id").alias(key), F.col("name").alias(out))
    rows = g.edges.join(named("src", "subject"), "src").join(named("dst", "object"), "dst")
    return rows.select("subject", "object", F.unix_seconds("valid_at").alias("valid_second"), F.unix_seconds("invalid_at").alias("invalid_second"))


def _log(spark, sf_dir, history: bool) -> FactLog:
    """All events as facts in a log, taken in by a stream over the table's files."""
    events = table(spark, sf_dir, "events")
    top = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    shape = entity_facts(events, "user_id", "event_type", "ts", "event_id", "value").schema
    log = FactLog(f"{top}/log", shape, ("src", "rel"), history=history)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log.follow(entity_facts(stream, "user_id", "event_type", "ts", "event_id", "value"), f"{top}/state")
    return log


@query("SELECT src, rel, edge_id, round(value, 4) AS value FROM (SELECT CAST(user_id AS VARCHAR) AS src, event_type AS rel, event_id AS edge_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_newest_facts(spark, sf_dir) -> DataFrame:
    """What each user did last of each kind, from the log that a stream has filled."""
    return _log(spark, sf_dir, False).newest(spark).select("src", "rel", "edge_id", F.round("value", 4).alias("value"))


@query("SELECT CAST(user_id AS VARCHAR) AS src, event_type AS rel, event_id AS edge_id, lead(event_id) OVER w IS NULL AS is_open FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def stream_fact_history(spark, sf_dir) -> DataFrame:
    """All facts that a stream has brought, and whether each still holds."""
    return _log(spark, sf_dir, True).facts(spark).select("src", "rel", "edge_id", F.col("invalid_at").isNull().alias("is_open"))
