"""The rest of the catalogue: checks, evaluation, sources, routing, updates and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph.graph import PropertyGraph
from loomgraph.operators import quality, search
from loomgraph.plans import routing
from loomgraph.plans.catalogue import graph_query, numbers_sql, query
from loomgraph.plans.testgraph import table, testgraph
from loomgraph.sources import files
from loomgraph.storage import shared_dir
from loomgraph.streaming import updates

# -- contract and ontology --------------------------------------------------------------------------------------------
graph_query(
    """SELECT 'edges' AS metric, count(*) AS value FROM edges UNION ALL SELECT 'relations', count(DISTINCT rel) FROM edges UNION ALL SELECT 'unmapped_edges', count(*) FROM edges WHERE rel NOT IN ('SUPPLIES', 'ORDERED', 'LOCATED_IN')
UNION ALL SELECT 'edges_without_fact', count(*) FROM edges WHERE fact IS NULL UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'nodes_without_name', count(*) FROM nodes WHERE coalesce(name, '') = '' UNION ALL SELECT 'nodes_without_type', count(*) FROM nodes WHERE type IS NULL""",
    "nodes", "edges", name="graph_contract", f=lambda g: quality.contract(g, ["SUPPLIES", "ORDERED", "LOCATED_IN"]),
)
graph_query("SELECT rel, count(*) AS edges, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM edges GROUP BY rel", "edges", name="relation_counts", f=quality.relation_counts)
_ALLOWED = [("SUPPLIER", "PART", "SUPPLIES"), ("CUSTOMER", "NATION", "LOCATED_IN"), ("NATION", "REGION", "IN_REGION"), ("Entity", "Entity", "HAS_BRAND")]


@query(
    """+ allowed(a, b, rel) AS (VALUES ('SUPPLIER', 'PART', 'SUPPLIES'), ('CUSTOMER', 'NATION', 'LOCATED_IN'), ('NATION', 'REGION', 'IN_REGION')),
r AS (SELECT edge_id, x.type AS src_type, rel, y.type AS dst_type FROM (SELECT edge_id, src, dst, rel FROM places UNION ALL SELECT edge_id, src, dst, rel FROM kinds) JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst)
---
SELECT *, CASE WHEN rel IN ('HAS_TYPE', 'BELONGS_TO_SEGMENT') THEN 'undeclared relation' ELSE 'not allowed for the types' END AS reason FROM r WHERE rel <> 'HAS_BRAND' AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = src_type AND b = dst_type AND allowed.rel = r.rel)""",
    "nodes", "places", "kinds",
)
def ontology_conformance(spark, sf_dir):
    g = testgraph(spark, sf_dir)
    allowed = spark.createDataFrame(_ALLOWED, "src_type string, dst_type string, rel string")
    g = PropertyGraph(g.nodes, g.edges.filter("rel IN ('IN_REGION', 'LOCATED_IN', 'BELONGS_TO_SEGMENT', 'HAS_BRAND', 'HAS_TYPE')"))
    return quality.conformance(g, allowed.select("rel"), allowed)


graph_query("SELECT 'C' || c_custkey AS id, c_name AS name, c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS is_gap FROM customer", name="data_gap_check", f=lambda g: quality.data_gaps(g, "CUSTOMER", ["ORDERED"]))


@query(
    f"""WITH n AS (SELECT source, {numbers_sql('text')} AS w, {numbers_sql("split_part(text, chr(10), 1)")} AS h FROM documents), c AS (SELECT source, sum(len(w)) AS wanted, sum(len(list_intersect(w, h))) AS found FROM n GROUP BY 1)
SELECT source, CAST(wanted AS BIGINT) AS wanted, CAST(found AS BIGINT) AS found, 0 AS growth_rows, 0 AS growth_found, CASE WHEN wanted > 0 THEN round(found / CAST(wanted AS DOUBLE), 4) END AS captured FROM c"""
)
def extraction_coverage(spark, sf_dir):
    """How many of a document's numbers its source's first line holds."""
    d = table(spark, sf_dir, "documents").select("source", "text")
    return quality.extraction_coverage(d.withColumn("stored", F.substring_index("text", "\n", 1)), "source", "text", "stored")


@query("SELECT upper(event_type) AS rel, upper(event_type) AS canonical, event_type AS preferred FROM events GROUP BY event_type UNION ALL SELECT event_type, upper(event_type), event_type FROM events GROUP BY event_type")
def preferred_casing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("rel"))
    return quality.preferred_casing(e.union(e.select(F.upper("rel"))))


# -- evaluation -------------------------------------------------------------------------------------------------------
_RECORDS = "SELECT doc_id, CASE quality WHEN 1 THEN 'Relevant' ELSE 'Not Relevant' END AS label, doc_id % 3 AS n, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 4) / CAST(3 AS DOUBLE) END AS recall FROM labels"
_OUTCOME = f"SELECT doc_id, CASE WHEN label = 'Relevant' THEN 'answered' WHEN n = 0 THEN 'no_retrieval' WHEN recall IS NULL THEN 'unscored' WHEN recall >= 0.99 THEN 'generation_miss' WHEN recall = 0 THEN 'retrieval_miss' ELSE 'partial_retrieval' END AS outcome, recall FROM ({_RECORDS})"


def _outcomes(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Relevant").otherwise("Not Relevant").alias("label"), (F.col("doc_id") % 3).alias("n"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 4) / F.lit(3.0)).alias("recall"))
    return r.select("doc_id", X.outcome(F.col("label"), F.col("n"), F.col("recall")).alias("outcome"), "recall")


query(f"SELECT doc_id, outcome FROM ({_OUTCOME})", name="outcome_attribution")(lambda spark, d: _outcomes(spark, d).select("doc_id", "outcome"))
query(f"SELECT outcome, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM ({_OUTCOME}) GROUP BY 1", name="failure_report")(lambda spark, d: quality.report(_outcomes(spark, d), "outcome"))
query(f"SELECT count(*) AS rows, count(recall) AS scored, round(avg(recall), 6) AS mean_recall, round(avg(CASE WHEN recall >= 0.99 THEN 1.0 WHEN recall IS NOT NULL THEN 0.0 END), 6) AS hit_rate FROM ({_OUTCOME})", name="batch_stats")(
    lambda spark, d: _outcomes(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count("recall").alias("scored"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg((F.col("recall") >= 0.99).cast("double")), 6).alias("hit_rate"))
)
query(
    """SELECT user_id, event_type AS label, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k, count(*) OVER (PARTITION BY user_id) AS winners FROM (
SELECT *, max(votes) OVER (PARTITION BY user_id) AS most FROM (
SELECT user_id, event_type, count(*) AS votes, list_position(['click', 'error', 'login', 'purchase', 'view'], event_type) AS place FROM events GROUP BY ALL)) WHERE votes = most) WHERE k = winners // 2 + 1""", name="majority_vote",
)(lambda spark, d: quality.majority(table(spark, d, "events"), "user_id", "event_type", ["click", "error", "login", "purchase", "view"]).withColumnRenamed("event_type", "label"))


@query()
def retrieval_recall(spark, sf_dir):
    """How much of each benchmark item's numbers and names the next item holds."""
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("ground_truth")).join(b.select("item_id", F.col("text").alias("kg_hop_path")), "item_id").withColumn("query", F.lit(""))
    return quality.with_recall(pairs).select("item_id", "wanted", "found", "recall")


# -- sources ----------------------------------------------------------------------------------------------------------
@query("SELECT page_id, length(html) > 0 AS has_html FROM pages")
def page_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.length("html") > 0).alias("has_html"))


@query(
    r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(html, '(?i)<p\b[^>]*>')[2:], lambda p: trim(regexp_replace(regexp_replace(regexp_replace(p, '(?is)(</p>|</article>|</div>).*$', ''),
'(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), lambda p: length(p) > 50), chr(10) || chr(10)) AS content FROM pages"""
)
def article_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.article_paragraphs().alias("content"))


@query("SELECT '[Preamble] ' || split_part(trim(text), chr(10), 1) AS title, count(*) AS n FROM documents WHERE trim(text) <> '' AND length(text) < 5000 AND contains(text, chr(10)) AND NOT contains(text, '---') AND NOT contains(text, '==') GROUP BY 1")
def episodes_chunk(spark, sf_dir):
    """Titles of one-chunk episodes of documents; entries without a second line have no content and so no episode."""
    d = table(spark, sf_dir, "documents").filter((F.trim("text") != "") & (F.length("text") < 5000) & F.col("text").contains("\n") & ~F.col("text").contains("---") & ~F.col("text").contains("=="))
    return files.episodes(d, "text").groupBy(F.col("name").alias("title")).agg(F.count(F.lit(1)).alias("n"))


query("SELECT item_id, text FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id <= 10)", name="resume_anti")(
    lambda spark, d: files.without_done(table(spark, d, "benchmark"), table(spark, d, "benchmark").filter("item_id <= 10").select(F.col("text").alias("query"))).select("item_id", "text")
)
query("SELECT event_type, event_id, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 12", name="stratified_sample")(
    lambda spark, d: table(spark, d, "events").select("event_type", "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("k")).filter("k <= 12")
)

# -- routing and linking ----------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, len(list_filter(string_split_regex(lower(text), '[^\\pL\\pN_]+'), lambda w: w IN ('the', 'and', 'der', 'que'))) AS n FROM conversations")
def gazetteer_link(spark, sf_dir):
    """Mentions of listed names in question texts, longest name first, on word boundaries."""
    from loomgraph.plans.linking import mentions

    return mentions(table(spark, sf_dir, "conversations"), "text", ["the", "and", "der", "que"], "m").select("conv_id", "turn", F.size("m").cast("long").alias("n"))


# -- updates and windows ----------------------------------------------------------------------------------------------
query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE k = 1", name="asof_latest_fact")(
    lambda spark, d: updates.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts").filter(F.col("ts") <= F.lit("2024-01-15").cast("timestamp")), ["user_id", "event_type"], "ts", "event_id")
)
query("SELECT event_id, ts AS valid_at, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at FROM events", name="superseded_facts")(
    lambda spark, d: updates.superseded(table(spark, d, "events").withColumnRenamed("ts", "valid_at"), ["user_id", "event_type"], tie="event_id").select("event_id", "valid_at", "invalid_at")
)


def _stream(spark, sf_dir, build, mode, key=()):
    """The table of a streaming query over events, run over what is there. Its checkpoints and rows are in the shared folder."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return updates.run_available(build(stream), f"{top}/state", f"{top}/rows", mode, key)


def _tumbling(stream):
    windows = updates.tumbling(stream, "ts", "1 day", "2 days", ["event_type"])
    return windows.select(F.col("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", name="stream_tumbling")(
    lambda spark, d: _stream(spark, d, _tumbling, "update", ["day", "event_type"])
)
query(
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k""", name="stream_session",
)(lambda spark, d: _stream(spark, d, lambda s: updates.sessions(s, "ts", "6 hours", ["user_id"], "2 days").select("user_id", F.col("w.start").alias("start"), "n"), "complete"))
query("SELECT event_type, count(*) AS n FROM events GROUP BY 1", name="stream_dedup")(
    lambda spark, d: _stream(spark, d, lambda s: updates.distinct_events(s.unionByName(s), "ts", ["event_id", "event_type"], "60 days").select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
)
