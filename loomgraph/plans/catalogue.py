"""The registered queries over the driver's tables, each beside SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph.graph import PropertyGraph
from loomgraph.operators import neighbourhood as N
from loomgraph.operators import paths, patterns, quality, ranking, search
from loomgraph.plans.testgraph import table, testgraph, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def query(sql: str | None = None, *tables: str, name: str | None = None, recursive: bool = False) -> Callable:
    """Registers a function of (spark, sf_dir); sql may use the named common table expressions."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = with_tables(sql, *tables, recursive=recursive) if tables else sql
        return f

    return add


def graph_query(sql: str | None, *tables: str, name: str, f: Callable[[PropertyGraph], DataFrame], recursive: bool = False) -> None:
    """Registers a query that needs only the graph."""
    query(sql, *tables, name=name, recursive=recursive)(lambda spark, sf_dir: f(testgraph(spark, sf_dir)))


# -- nodes and edges --------------------------------------------------------------------------------------------------
@query("SELECT id, name, type, label AS specific FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM nodes) WHERE k = 1", "nodes")
def graph_node_index(spark, sf_dir):
    """Nodes with their bucketed type; of equal names the lowest id. Grouping, not a window, so a frequent name is summed up
    before it is shuffled."""
    nodes = testgraph(spark, sf_dir).nodes.withColumn("specific", X.specific_label(F.col("labels")))
    return nodes.groupBy("name").agg(F.min(F.struct("id", "type", "specific")).alias("n")).select("n.id", "name", "n.type", "n.specific")


graph_query(
    "SELECT edge_id, a.name || ' ' || lower(replace(rel, '_', ' ')) || ' ' || b.name AS text FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst", "nodes", "edges", name="graph_edge_docs",
    f=lambda g: N.endpoints(g, g.edges).select("edge_id", F.concat_ws(" ", "subject_name", F.lower(F.replace("rel", F.lit("_"), F.lit(" "))), "object_name").alias("text")),
)
graph_query(
    "SELECT DISTINCT a.name AS subject_name, rel AS relationship, b.name AS object_name, fact FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst", "nodes", "supplies", name="graph_fact_index",
    f=lambda g: N.endpoints(g, g.edges.filter("rel = 'SUPPLIES' AND fact IS NOT NULL"), g.of_type("SUPPLIER"), g.of_type("PART")).select("subject_name", F.col("rel").alias("relationship"), "object_name", "fact").distinct(),
)
graph_query(
    "SELECT n.id, n.name, e.rel, list_sort(list(m.name)) AS neighbours FROM nodes n LEFT JOIN places e ON e.src = n.id LEFT JOIN nodes m ON m.id = e.dst WHERE n.type IN ('SUPPLIER', 'NATION', 'REGION') GROUP BY ALL", "nodes", "places", name="graph_node_docs",
    f=lambda g: g.of_type("SUPPLIER", "NATION", "REGION").select("id", "name")
    .join(g.with_rel("IN_REGION", "LOCATED_IN", "BELONGS_TO_SEGMENT").select(F.col("src").alias("id"), "rel", "dst"), "id", "left")
    .join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst", "left").groupBy("id", "name", "rel")
    .agg(F.array_sort(F.when(F.count("other") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.collect_list("other"))).alias("neighbours")),
)

# -- templates around one or two nodes --------------------------------------------------------------------------------
graph_query(
    """SELECT edge_id, src AS subject_id, a.name AS subject_name, rel AS relationship, dst AS object_id, b.name AS object_name, b.type AS object_type, fact, coalesce(value, share) AS value
FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src = 'S1' ORDER BY b.name, edge_id LIMIT 50""", "nodes", "supplies", name="neighbors_simple",
    f=lambda g: N.neighbours(g, "S1", ["SUPPLIES"], "Supplier").select("edge_id", "subject_id", "subject_name", "relationship", "object_id", "object_name", "object_type", "fact", "value"),
)
graph_query(
    "SELECT DISTINCT a.name AS subject_name, rel AS relationship, dst AS object_id, b.name AS object_name, fact FROM adj JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src = 'N1' AND rel IN ('IN_REGION', 'LOCATED_IN')", "nodes", "adj", name="relaxed_direction",
    f=lambda g: N.relaxed_direction(g, "N1", ["IN_REGION", "LOCATED_IN"]),
)
graph_query(
    "SELECT DISTINCT a.name AS subject_name, rel AS relationship, dst AS object_id, b.name AS object_name, fact FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src IN ('S1', 'S2')", "nodes", "supplies", name="log_union",
    f=lambda g: N.log_union(g, "S1", "S2", ["SUPPLIES"]),
)
graph_query(
    "SELECT x.dst AS object_id, n.name AS object_name, x.rel AS relationship, y.rel AS other_relationship FROM supplies x JOIN supplies y ON x.dst = y.dst AND x.edge_id <> y.edge_id JOIN nodes n ON n.id = x.dst WHERE x.src = 'S1' AND y.src = 'S2'", "nodes", "supplies", name="log_intersection",
    f=lambda g: N.log_intersection(g, "S1", "S2", ["SUPPLIES"]),
)
graph_query(
    "SELECT dst AS object_id, name AS object_name, rel AS relationship FROM supplies JOIN nodes ON id = dst WHERE src = 'S1' AND dst NOT IN (SELECT dst FROM adj WHERE src = 'S2')", "nodes", "adj", name="log_difference",
    f=lambda g: N.log_difference(g, "S1", "S2", ["SUPPLIES"]),
)
for _how, _test in {"more": "> 500", "less": "< 999", "approx": "BETWEEN 522 AND 524", "atmost": "<= 520", "atleast": ">= 520", "equal": "= 523"}.items():
    _t = {"more": 500, "less": None, "approx": 523, "atmost": 520, "atleast": 520, "equal": 523}[_how]
    graph_query(
        f"SELECT src AS subject_id, name AS subject_name, count(*) AS object_count{', 523 AS target_count' if _how == 'approx' else ''} FROM supplies JOIN nodes ON id = src GROUP BY ALL HAVING count(*) {_test}", "nodes", "supplies", name=f"count_{_how}",
        f=lambda g, how=_how, t=_t: N.counted(g, how, t, ["SUPPLIES"], "SUPPLIER"),
    )
graph_query(
    "SELECT src AS subject_id, name AS subject_name, count(*) AS object_count, list_sort(list(fact)) AS facts FROM supplies JOIN nodes ON id = src GROUP BY ALL", "nodes", "supplies", name="quant_count_collect",
    f=lambda g: N.collected(g, "SUPPLIER", ["SUPPLIES"], "PART").drop("pairs"),
)
for _how, _test in {"atmost": "coalesce(share, 1.0) <= 0.1", "atleast": "coalesce(share, 0.0) >= 0.2", "approx": "coalesce(share, 0.5) BETWEEN 0.3 - 0.1 AND 0.3 + 0.1", "equal": "coalesce(share, 0.0) = 0.3"}.items():
    graph_query(
        f"SELECT edge_id, a.name AS subject_name, rel AS relationship, b.name AS object_name, share AS value FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE {_test}".replace("0.3 - 0.1 AND 0.3 + 0.1", "CAST(0.3 AS DOUBLE) - CAST(0.1 AS DOUBLE) AND CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE)"), "nodes", "supplies", name=f"quant_{_how}",
        f=lambda g, how=_how: N.by_value(PropertyGraph(g.nodes, g.with_rel("SUPPLIES")), how, {"atmost": 0.1, "atleast": 0.2, "approx": 0.3, "equal": 0.3}[how], columns=("share",)),
    )
for _max in (True, False):
    graph_query(
        f"""SELECT src AS subject_id, a.name AS subject_name, rel AS relationship, b.name AS object_name, fact, v AS {'max_value' if _max else 'min_value'} FROM (
SELECT *, row_number() OVER (PARTITION BY src ORDER BY v {'DESC' if _max else 'ASC'}, edge_id) AS k FROM (SELECT *, coalesce(value, share, 1.0) AS v FROM supplies)) JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE k = 1""", "nodes", "supplies", name="quant_max" if _max else "quant_min",
        f=lambda g, m=_max: N.extreme(PropertyGraph(g.nodes, g.edges.filter("rel = 'SUPPLIES'")), None, m).filter(F.col("subject_id").startswith("S")),
    )
_USABLE = """+ usable AS (SELECT edge_id, src, dst, fact, CASE WHEN coalesce(value, share) IS NULL OR abs(coalesce(value, share)) > 100 THEN TRY_CAST(replace(regexp_extract(fact, '(-?\\d[\\d,]*\\.?\\d*)\\s*%', 1), ',', '') AS DOUBLE) ELSE coalesce(value, share) END AS v
  FROM (SELECT edge_id, src, dst, fact, value, NULL AS share FROM supplies) WHERE NOT regexp_matches(fact, '(?i)\\bgrowth\\b|\\bgrew\\b|\\brose\\b|\\bincreased?\\b|\\bdeclined?\\b|\\bfell\\b|\\byear[- ]on[- ]year\\b|\\byoy\\b')),
tagged AS (SELECT u.*, r_name AS segment FROM usable u JOIN supplier ON 'S' || s_suppkey = src JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE v IS NOT NULL),
firsts AS (SELECT segment, src, arg_min(v, edge_id) AS v FROM tagged GROUP BY ALL)
---
"""


def _metric(g: PropertyGraph, metric: str | None = None) -> DataFrame:
    """Suppliers' discounts as a metric, with the supplier's region as its segment."""
    located = g.with_rel("LOCATED_IN").filter(F.col("src").startswith("S")).select("edge_id", "src", F.col("dst").alias("n"))
    tags = located.join(g.with_rel("IN_REGION").select(F.col("src").alias("n"), "dst"), "n").select("edge_id", "src", "dst", F.lit("IN_SEGMENT").alias("rel"))
    edges = g.with_rel("SUPPLIES").drop("share").unionByName(tags, allowMissingColumns=True)
    return ranking.metric_rows(PropertyGraph(g.nodes, edges), "SUPPLIER", metric, ["SUPPLIES"], "IN_SEGMENT", REGIONS)


_NAMED = "replace(lower('Almond Antique Ratio'), ' ratio', '')"
for _max in (True, False):
    graph_query(
        _USABLE + f"SELECT src AS subject_id, s.name AS subject_name, p.name AS object_name, fact, v AS {'max_value' if _max else 'min_value'} FROM tagged JOIN nodes s ON s.id = src JOIN nodes p ON p.id = dst ORDER BY v {'DESC' if _max else 'ASC'}, edge_id LIMIT 1", "nodes", "supplies", name=f"global_rank_{'max' if _max else 'min'}",
        f=lambda g, m=_max: ranking.global_rank(_metric(g), m),
    )
    graph_query(
        _USABLE + f"SELECT segment AS subject_name, round(avg(v), 2) AS avg_value, count(*) AS company_count FROM firsts GROUP BY 1 ORDER BY 2 {'DESC' if _max else 'ASC'}, 1", "supplies", name=f"segment_rank_{'max' if _max else 'min'}",
        f=lambda g, m=_max: ranking.segment_rank(_metric(g), m),
    )
graph_query(
    _USABLE + "SELECT src AS subject_id, s.name AS subject_name, p.name AS object_name, fact, v AS max_value FROM tagged JOIN nodes s ON s.id = src JOIN nodes p ON p.id = dst WHERE segment = 'ASIA' ORDER BY v DESC, edge_id LIMIT 1", "nodes", "supplies", name="global_rank_segment",
    f=lambda g: ranking.global_rank(_metric(g), True, "ASIA"),
)
graph_query(
    _USABLE + "SELECT segment AS subject_name, round(avg(v), 2) AS avg_value, count(*) AS company_count FROM firsts WHERE segment IN ('ASIA', 'EUROPE') GROUP BY 1", "supplies", name="group_vs_group",
    f=lambda g: ranking.group_vs_group(_metric(g), ["ASIA", "EUROPE"]),
)
graph_query(
    "SELECT c_mktsegment AS segment_name, avg(value) AS avg_value, count(DISTINCT src) AS company_count FROM ordered JOIN customer ON 'C' || c_custkey = src GROUP BY 1", "ordered", name="group_aggregate_base",
    f=lambda g: ranking.group_average(g, "BELONGS_TO_SEGMENT", ["ORDERED"]),
)
graph_query(
    _USABLE + """SELECT src AS subject_id, segment AS segment_name, v AS value, CASE WHEN m > 1 THEN round((CAST(t AS DOUBLE) - v) / (m - 1), 2) END AS segment_average, m - 1 AS peer_count
FROM firsts JOIN (SELECT segment, sum(CAST(v AS DECIMAL(30, 8))) AS t, count(*) AS m FROM firsts GROUP BY 1) USING (segment)""", "supplies", name="comp_to_group_avg",
    f=lambda g: ranking.company_to_group(_metric(g)),
)
graph_query(
    _USABLE + "SELECT edge_id, src AS subject_id, fact, v AS value FROM tagged WHERE src = 'S1' ORDER BY edge_id LIMIT 1", "supplies", name="comp_own_value",
    f=lambda g: ranking.own_value(_metric(g), "S1").select("edge_id", "subject_id", "fact", "value"),
)
graph_query(
    """SELECT DISTINCT a.name AS subject_name, rel AS relationship, b.name AS object_name FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
WHERE lower(b.name) LIKE '%gear%' OR lower(b.name) LIKE '%plate%' ORDER BY 1, 3, 2 LIMIT 50""", "nodes", "supplies", name="list_by_topic",
    f=lambda g: N.companies_by_topic(g, ["gear", "plate"], "SUPPLIER", ["SUPPLIES"]),
)


@query("SELECT 'C' || c_custkey AS subject_id, c_name AS subject_name, attribute, value FROM (SELECT c_custkey, c_name, unnest(['nation', 'segment']) AS attribute, unnest([CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value FROM customer) WHERE value <> ''")
def attribute_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    props = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("created_at"), F.lit("now"))
    return N.attributes(c.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), props.alias("props")))


graph_query(
    "SELECT * FROM (SELECT DISTINCT a.name AS subject_name, rel AS relationship, dst AS object_id, b.name AS object_name, fact FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src = 'S1' ORDER BY object_name, relationship, object_id, fact LIMIT 20) UNION ALL SELECT * FROM (SELECT DISTINCT a.name, rel, dst, b.name, fact FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src = 'S2' ORDER BY 4, 2, 3, 5 LIMIT 20)", "nodes", "supplies", name="compare_metric",
    f=lambda g: N.compared(g, "S1", "S2", ["SUPPLIES"]),
)
graph_query(
    "SELECT * FROM (SELECT DISTINCT a.name AS subject_name, rel AS relationship, dst AS object_id, b.name AS object_name, fact FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src = 'S1' AND lower(b.name) LIKE '%gear%' ORDER BY object_name, relationship, object_id, fact LIMIT 20) UNION ALL SELECT * FROM (SELECT DISTINCT a.name, rel, dst, b.name, fact FROM supplies JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src = 'S2' AND lower(b.name) LIKE '%gear%' ORDER BY 4, 2, 3, 5 LIMIT 20)", "nodes", "supplies", name="compare_metric_named",
    f=lambda g: N.compared(g, "S1", "S2", ["SUPPLIES"], "gear"),
)


@query(
    """SELECT subject_name, object_id, added FROM (SELECT a.name AS subject_name, dst AS object_id, FALSE AS added FROM supplies JOIN nodes a ON a.id = src WHERE src = 'S1' AND coalesce(value, share) > 9)
UNION ALL SELECT * FROM (SELECT a.name, dst, TRUE FROM supplies JOIN nodes a ON a.id = src WHERE src = 'S1' AND NOT coalesce(coalesce(value, share) > 9, FALSE) ORDER BY dst LIMIT 40)""", "nodes", "supplies",
)
def topped_up(spark, sf_dir):
    """A narrow query's rows, topped up from a broader one."""
    rows = N.facts_of(testgraph(spark, sf_dir), "S1", ["SUPPLIES"])
    return N.topped_up(rows.filter("value > 9").select("subject_name", "object_id"), rows.select("subject_name", "object_id"), ["subject_name", "object_id"])


# -- paths ------------------------------------------------------------------------------------------------------------
def _places(g: PropertyGraph) -> PropertyGraph:
    """Where customers and suppliers are and what segment they are in: paths stay short and few."""
    return PropertyGraph(g.nodes, g.with_rel("IN_REGION", "LOCATED_IN", "BELONGS_TO_SEGMENT").select("edge_id", "src", "dst", "rel", "fact"))


_BFS = """, both_ways AS (SELECT src, dst FROM places UNION ALL SELECT dst, src FROM places WHERE src <> dst),
walk(id, hops) AS (SELECT '{start}', 0 UNION SELECT dst, hops + 1 FROM walk JOIN both_ways ON src = walk.id WHERE hops < {most}),
near AS (SELECT id, min(hops) AS hops FROM walk GROUP BY 1)
"""
graph_query(
    "+" + _BFS.format(start="R1", most=4)[1:] + "---\nSELECT id, CAST(hops AS INTEGER) AS hops FROM near", "places", name="shortest_path_hops", recursive=True,
    f=lambda g: paths.distances(_places(g), "R1", 4).select("id", "hops"),
)
graph_query(
    "+" + _BFS.format(start="S1", most=3)[1:] + "---\nSELECT id, name, CAST(hops AS INTEGER) AS hops FROM near JOIN nodes USING (id) WHERE hops > 0 AND type = 'REGION' ORDER BY hops, id LIMIT 20", "nodes", "places", name="reachable_k", recursive=True,
    f=lambda g: paths.reachable(_places(g), "S1", 3, "REGION"),
)
for _how, _case in {"more": "CASE WHEN hops_a < hops_b THEN 'S1' ELSE 'S2' END AS more_exposed", "less": "CASE WHEN hops_a > hops_b THEN 'S1' ELSE 'S2' END AS less_exposed", "approx": ""}.items():
    _shock = "BUILDING" if _how == "approx" else "R1"  # a segment is as far from most suppliers
    graph_query(
        "+" + _BFS.format(start=_shock, most=6)[1:] + f"---\nSELECT * {',' if _case else ''} {_case} FROM (SELECT CAST(max(CASE WHEN id = 'S1' THEN hops END) AS INTEGER) AS hops_a, CAST(max(CASE WHEN id = 'S2' THEN hops END) AS INTEGER) AS hops_b FROM near)" + (" WHERE abs(hops_a - hops_b) <= 1" if _how == "approx" else ""),
        "places", name=f"compare_shock_{_how}", recursive=True,
        f=lambda g, how=_how, shock=_shock: paths.compare_exposure(_places(g), "S1", "S2", shock, how, 6).drop("facts_a", "facts_b"),
    )
graph_query(
    "+" + _BFS.format(start="S1", most=6)[1:] + "---\nSELECT 'S1' AS a, 'S2' AS b, CAST(hops AS INTEGER) AS hops FROM near WHERE id = 'S2'", "places", name="compare_pair", recursive=True,
    f=lambda g: paths.compare_pair(_places(g), "S1", "S2", 6).drop("path_nodes"),
)
graph_query(
    """SELECT e.dst AS id, 1 AS hops, 'S1 -[' || e.rel || ']-> ' || e.dst AS path FROM places e WHERE e.src = 'S1'
UNION ALL SELECT f.dst, 2, 'S1 -[' || e.rel || ']-> ' || e.dst || ' -[' || f.rel || ']-> ' || f.dst FROM places e JOIN places f ON f.src = e.dst AND f.edge_id <> e.edge_id WHERE e.src = 'S1'""", "places", name="causal_trails",
    f=lambda g: paths.trails(_places(g), "S1", None, None, 4, None).select("id", "hops", paths.rendered(F.col("path_nodes"), F.col("path_rels")).alias("path")),
)
graph_query(
    "SELECT edge_id FROM places WHERE src = 'S1' UNION SELECT f.edge_id FROM places e JOIN places f ON f.src = e.dst WHERE e.src = 'S1' AND e.rel = 'LOCATED_IN'", "places", name="edges_between",
    f=lambda g: paths.edges_between(PropertyGraph(g.nodes, g.edges.filter("rel IN ('IN_REGION', 'LOCATED_IN')").filter(F.col("src").startswith("S") & (F.col("src") == "S1") | (F.col("rel") == "IN_REGION")).select("edge_id", "src", "dst", "rel", "fact")), "S1", _region_of_first(g), 2),
)


def _region_of_first(g: PropertyGraph) -> str:
    rows = patterns.chain(PropertyGraph(g.nodes, g.edges), ["LOCATED_IN", "IN_REGION"], "S1")
    return rows.first()["n2"]


# -- recipes ----------------------------------------------------------------------------------------------------------
graph_query(
    "SELECT id, name FROM nodes WHERE type = 'PART' AND id IN (SELECT dst FROM supplies WHERE src = 'S1') AND id IN (SELECT dst FROM supplies WHERE src = 'S2')", "nodes", "supplies", name="two_event_semi",
    f=lambda g: patterns.tied_to_both(PropertyGraph(g.nodes, g.with_rel("SUPPLIES")), "S1", "S2", "PART"),
)
graph_query(
    "SELECT r.name AS constraint_name, list_sort(list(DISTINCT n.name)) AS suppliers FROM places JOIN nodes r ON r.id = dst JOIN nodes n ON n.id = src WHERE rel = 'IN_REGION' GROUP BY 1", "nodes", "places", name="bottleneck_collect",
    f=lambda g: patterns.bottlenecks(PropertyGraph(g.nodes, g.with_rel("IN_REGION").select("edge_id", "src", "dst", "rel")), "IN_REGION", "NATION"),
)
graph_query(
    "SELECT 'S' || s_suppkey AS n0, 'N' || s_nationkey AS n1, 'R' || n_regionkey AS n2 FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'R' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey", name="pattern_chain",
    f=lambda g: patterns.chain(g, ["LOCATED_IN", "IN_REGION"]),
)
graph_query(
    "SELECT DISTINCT r.name AS entity_name, r.type AS entity_type, rel AS relationship, n.id AS linked_id, n.name AS linked_name, n.type AS linked_type FROM places JOIN nodes r ON r.id = dst JOIN nodes n ON n.id = src WHERE rel = 'IN_REGION'", "nodes", "places", name="thematic_pattern",
    f=lambda g: patterns.match(PropertyGraph(g.nodes, g.edges.withColumn("channel", F.lit(None).cast("string"))), None, patterns.Pattern(("IN_REGION",), "in", "NATION")).drop("channel"),
)


@query(
    """WITH v AS (SELECT s_suppkey, count(DISTINCT l_partkey) AS parts, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
t AS (SELECT *, ntile(10) OVER (ORDER BY parts DESC, s_suppkey) AS a, ntile(10) OVER (ORDER BY quantity DESC, s_suppkey) AS b FROM v) SELECT s_suppkey, parts, CAST(quantity AS BIGINT) AS quantity FROM t WHERE a = 1 AND b = 1"""
)
def top_decile_both(spark, sf_dir):
    """Suppliers in the top decile of two measures, numbered by ranges, not in one task."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("parts"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return patterns.deciles(v, "s_suppkey", "parts", "quantity").filter("parts_part = 1 AND quantity_part = 1").select("s_suppkey", "parts", "quantity")


# -- search -----------------------------------------------------------------------------------------------------------
def _scored(spark, sf_dir) -> DataFrame:
    """All vectors with their similarity to the first one."""
    e = table(spark, sf_dir, "embeddings")
    return search.similar_to(e, e.filter("vec_id = 0").first()["embedding"]).select("vec_id", "label", "sim")


_SIM = "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))), 6) AS sim FROM embeddings, q)"
query(f"{_SIM} SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 10", name="vec_topk")(lambda spark, d: search.top_k(_scored(spark, d), 10, "vec_id"))
query(f"{_SIM} SELECT * FROM (SELECT * FROM s WHERE sim >= 0.0 ORDER BY sim DESC, vec_id LIMIT 80) WHERE label = 3 ORDER BY sim DESC, vec_id LIMIT 10", name="vec_scoped_topk")(lambda spark, d: search.scoped_top_k(_scored(spark, d), 10, "vec_id", F.col("label") == 3, 0.0))
query(
    f"{_SIM} SELECT vec_id, label, sim, CAST(group_rank AS INTEGER) AS group_rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS group_rank FROM (SELECT * FROM s WHERE sim >= 0.05 ORDER BY sim DESC, vec_id LIMIT 800)) WHERE group_rank <= 5 ORDER BY sim DESC, vec_id LIMIT 200", name="vec_diversified"
)(lambda spark, d: search.diversified(_scored(spark, d), "vec_id", "label", floor=0.05))
query(f"{_SIM} SELECT vec_id, label, sim, CAST(group_rank AS INTEGER) AS group_rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS group_rank FROM s) WHERE group_rank <= 2", name="vec_topn_per_group")(lambda spark, d: search.top_each(_scored(spark, d), "vec_id", "label"))
query(f"{_SIM} SELECT label, CAST(min(k) AS INTEGER) AS pos FROM (SELECT label, row_number() OVER (ORDER BY sim DESC, vec_id) AS k FROM s WHERE sim >= 0.05 ORDER BY sim DESC, vec_id LIMIT 40) GROUP BY 1 ORDER BY 2 LIMIT 5", name="vec_first_relations")(lambda spark, d: search.first_values(_scored(spark, d), "vec_id", "label", floor=0.05))
query(f"{_SIM} SELECT vec_id, label, sim, round(sim + CASE WHEN label = 3 THEN 0.2 ELSE 0 END, 6) AS boosted FROM (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 15) ORDER BY 4 DESC, 1 LIMIT 1", name="semantic_link_boost")(
    lambda spark, d: search.linked(_scored(spark, d), "a long span", F.col("label").cast("string"), F.col("label").cast("string"), ["3"], "vec_id")
)
_HITS = "CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'und') AS INTEGER)"
query(f"SELECT doc_id, score FROM (SELECT doc_id, {_HITS} AS score FROM documents) WHERE score >= 2 ORDER BY score DESC, doc_id LIMIT 40", name="keyword_overlap")(lambda spark, d: search.keyword_search(table(spark, d, "documents").select("doc_id", "text"), "text", ["the", "tion", "und"], "doc_id").drop("text"))


@query("SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '([a-z][a-z\\-]{3,})', 1))) AS n FROM benchmark")
def keyword_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(X.keywords(F.col("text"))).cast("long").alias("n"))


@query(
    """SELECT p_name, pos, source FROM (SELECT p_name, pos, 0 AS source FROM (SELECT p_name, min(p_partkey) AS pos FROM part WHERE p_size <= 10 GROUP BY 1)
UNION ALL SELECT p_name, pos, 1 FROM (SELECT p_name, min(p_partkey) AS pos FROM part GROUP BY 1) WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 10)) ORDER BY source, pos LIMIT 100"""
)
def merge_rank_cap(spark, sf_dir):
    """Two sources of names merged in order without repeats, up to a cap."""
    part = table(spark, sf_dir, "part")
    names = lambda df: df.groupBy("p_name").agg(F.min("p_partkey").alias("pos"))
    return search.merged(names(part.filter("p_size <= 10")), names(part), ["p_name"], "pos", 100)


# -- scalars ----------------------------------------------------------------------------------------------------------
@query(
    r"""WITH t AS (SELECT event_type AS raw, string_agg(upper(p[1]) || p[2:], '' ORDER BY i) AS pascal FROM (SELECT DISTINCT event_type, unnest(string_split(event_type, '_')) AS p, generate_subscripts(string_split(event_type, '_'), 1) AS i FROM events) GROUP BY 1)
SELECT pascal, upper(trim(regexp_replace(pascal, '([A-Z])', '_\1', 'g'), '_')) AS snake FROM t"""
)
def casing_variants(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    pascal = F.array_join(F.transform(F.split("event_type", "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100))), "")
    return kinds.select(pascal.alias("pascal")).withColumn("snake", F.element_at(X.casing_variants(F.array("pascal")), -1))


@query("SELECT upper(event_type) AS canonical, list_sort([event_type, upper(event_type)]) AS spellings, 2 * count(*) AS edges FROM events GROUP BY event_type")
def casing_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("rel"))
    return quality.casing_drift(e.union(e.select(F.upper("rel"))))


@query(r"SELECT edge_id, TRY_CAST(replace(regexp_extract(fact, '(-?\d[\d,]*\.?\d*)\s*%', 1), ',', '') AS DOUBLE) AS number, CASE WHEN value IS NULL OR abs(value) > 100 THEN TRY_CAST(replace(regexp_extract(fact, '(-?\d[\d,]*\.?\d*)\s*%', 1), ',', '') AS DOUBLE) ELSE value END AS usable FROM supplies", "supplies")
def value_recovery(spark, sf_dir):
    g = testgraph(spark, sf_dir)
    return g.with_rel("SUPPLIES").select("edge_id", X.number_from_fact(F.col("fact")).alias("number"), X.usable_value(F.col("value"), F.col("fact")).alias("usable"))


def numbers_sql(text: str) -> str:
    """The distinct numbers of a text that matter, as SQL: runs glued to a letter are blanked first."""
    found = f"regexp_extract_all(' ' || regexp_replace(coalesce({text}, ''), '[A-Za-z][0-9][0-9,]*(\\.[0-9]+)?%?', 'A', 'g'), '[0-9][0-9,]*(?:\\.[0-9]+)?%?')"
    valued = f"list_transform({found}, lambda x: {{'raw': x, 'v': CAST(regexp_replace(x, '[,%]', '', 'g') AS DOUBLE)}})"
    return f"list_sort(list_distinct(list_transform(list_filter({valued}, lambda x: ends_with(x.raw, '%') OR x.v >= 10 OR x.v <> floor(x.v)), lambda x: printf('%g', x.v))))"


@query(f"SELECT doc_id, {numbers_sql('text')} AS numbers FROM documents")
def extract_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.extract_numbers(F.col("text"))).alias("numbers"))


@query(r"SELECT s_suppkey, trim(regexp_replace(regexp_replace(s_name || ' in the AFRICA and asia', '(?i)middle east|supplier|africa|asia', ' ', 'g'), '\s+', ' ', 'g')) AS masked FROM supplier")
def mask_terms(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.mask_terms(F.concat("s_name", F.lit(" in the AFRICA and asia")), ["Asia", "Africa", "MIDDLE EAST", "supplier"]).alias("masked"))


@query("SELECT edge_id, fact AS text FROM supplies", "supplies")
def row_text(spark, sf_dir):
    rows = testgraph(spark, sf_dir).with_rel("SUPPLIES").select("edge_id", "fact", F.col("src").alias("subject_name"))
    return rows.select("edge_id", X.row_text(rows.columns).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_size + 0.25 END AS number FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, 0.5 FROM part WHERE p_partkey % 3 = 2")
def question_thresholds(spark, sf_dir):
    """The bounds of questions: whole, with a fraction, or in words."""
    p = table(spark, sf_dir, "part")
    amount = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".25")))
    asked = F.when(F.col("p_partkey") % 3 == 2, F.lit("Is more than half of it sold?")).otherwise(F.concat(F.lit("Is its size at least "), amount, F.lit("% of all?")))
    return p.select("p_partkey", X.threshold(asked).alias("number"))


from loomgraph.plans import catalogue_more, catalogue_whole  # noqa: E402, F401  registers the rest
from loomgraph.plans import catalogue_batch, catalogue_control, catalogue_ingest, catalogue_many, catalogue_text  # noqa: E402, F401  isort: skip
