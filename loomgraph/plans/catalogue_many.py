"""Queries over tables of questions about paths, and the recipes for shocks: all of them on the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators import many, paths, propagation
from loomgraph.plans.catalogue import QUERIES, SQL, graph_query, query
from loomgraph.plans.testgraph import table, testgraph, with_tables

#: Hops that the tables of pairs are searched over.
MOST = 4


def _with_sql(name: str, sql: str, *tables: str) -> None:
    """SQL for a query that is registered without."""
    assert name in QUERIES
    SQL[name] = with_tables(sql, *tables, recursive=True)


# -- pairs ------------------------------------------------------------------------------------------------------------
#: Hops from every node of asked(source), by levels.
_FROM = """+ near(src, dst) AS (SELECT DISTINCT src, dst FROM adj WHERE src <> dst),
walk(source, id, hops) AS (SELECT source, source, 0 FROM (SELECT DISTINCT source FROM asked) UNION SELECT source, dst, hops + 1 FROM walk JOIN near ON src = walk.id WHERE hops < {most}),
far AS (SELECT source, id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY ALL)
---
"""
_PAIRS = "asked AS (SELECT s_suppkey, 'N' || (s_suppkey % 25) AS source, 'S' || s_suppkey AS target FROM supplier)"


def _asked(sql: str, most: int = MOST) -> str:
    head, rest = _FROM.format(most=most).split("+", 1)[1].split("---\n")
    return f"+ {sql},{head}---\n{rest}"


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), (F.col("s_suppkey") % 25).cast("string")).alias("source"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target"))


@query(_asked(_PAIRS) + "SELECT DISTINCT source, target, hops FROM asked JOIN far USING (source) WHERE far.id = target", "edges", "adj", recursive=True)
def hops_many(spark, sf_dir):
    """Hops from nations to suppliers, one search for all."""
    return many.hops(testgraph(spark, sf_dir), _pairs(spark, sf_dir), MOST)


@query(_asked(_PAIRS) + "SELECT source AS a, target AS b, hops FROM asked JOIN far USING (source) WHERE far.id = target AND hops <= 2", "edges", "adj", recursive=True)
def compare_pairs_approx_many(spark, sf_dir):
    """Suppliers within two hops of a nation that each is asked about."""
    return many.compare_pairs(testgraph(spark, sf_dir), _pairs(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")), MOST, approx=True)


_SHOCKS = "shocks AS (SELECT c_custkey, 'C' || c_custkey AS a, 'C' || (c_custkey * 7 % 1000 + 1) AS b, 'R' || (c_custkey % 5) AS shock FROM customer), asked AS (SELECT shock AS source FROM shocks)"


def _questions(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text("C", c).alias("a"), text("C", c * 7 % 1000 + 1).alias("b"), text("R", c % 5).alias("shock"))


for _how, _test in {"more": "CASE WHEN x.hops < y.hops THEN a ELSE b END AS more_exposed", "less": "CASE WHEN x.hops > y.hops THEN a ELSE b END AS less_exposed", "approx": ""}.items():
    query(
        _asked(_SHOCKS) + f"SELECT c_custkey, a, b, shock, x.hops AS hops_a, y.hops AS hops_b{', ' if _test else ''}{_test} FROM shocks LEFT JOIN far x ON x.source = shock AND x.id = a LEFT JOIN far y ON y.source = shock AND y.id = b"
        + (" WHERE abs(x.hops - y.hops) <= 1" if _how == "approx" else ""),
        "edges", "adj", name=f"exposures_{_how}_many", recursive=True,
    )(lambda spark, d, how=_how: many.compare_exposures(testgraph(spark, d), _questions(spark, d), how, MOST))

graph_query(
    "+ c1 AS (SELECT dst AS id, count(*) AS n FROM adj WHERE src = 'N1' GROUP BY 1), c2 AS (SELECT dst AS id, sum(n) AS n FROM adj JOIN c1 ON src = c1.id GROUP BY 1), c3 AS (SELECT dst AS id, sum(n) AS n FROM adj JOIN c2 ON src = c2.id GROUP BY 1)\n---\n"
    "SELECT id, 1 AS hops, CAST(n AS BIGINT) AS walks FROM c1 UNION ALL SELECT id, 2, CAST(n AS BIGINT) FROM c2 UNION ALL SELECT id, 3, CAST(n AS BIGINT) FROM c3", "edges", "adj", name="walk_counts",
    f=lambda g: many.walk_counts(g, "N1", 3, directed=False).withColumn("walks", F.col("walks").cast("long")),
)
graph_query(
    """+ brand AS (SELECT min(p_brand) AS b FROM part)
---
SELECT dst AS id, 2 AS hops, ['S1', p, dst] AS path_nodes, [r1, r2] AS path_rels, [e1, e2] AS path_edges FROM (
  SELECT x.edge_id AS e1, x.rel AS r1, x.dst AS p, y.edge_id AS e2, y.rel AS r2, y.dst AS dst FROM edges x JOIN edges y ON y.src = x.dst WHERE x.src = 'S1' AND y.dst = (SELECT b FROM brand)) ORDER BY path_edges LIMIT 10""", "edges", name="best_trails",
    f=lambda g: many.best_trails(g, "S1", g.of_type("BRAND").agg(F.min("id")).first()[0], 10),
)


@query()
def shortest_many(spark, sf_dir):
    """A shortest path from every supplier's nation in question to the supplier, with the nodes, relations and facts on it."""
    return many.shortest(testgraph(spark, sf_dir), _pairs(spark, sf_dir), MOST)


# -- shocks -----------------------------------------------------------------------------------------------------------
_LEGS = [("IN_REGION", "in"), ("LOCATED_IN", "in"), ("SUPPLIES", "any"), ("ORDERED", "in")]
graph_query(
    """SELECT c.src AS id, max(s.share) AS severity, CAST(count(*) AS BIGINT) AS ways FROM places n JOIN places p ON p.rel = 'LOCATED_IN' AND p.dst = n.src JOIN supplies s ON s.src = p.src JOIN ordered c ON c.dst = s.dst
WHERE n.rel = 'IN_REGION' AND n.dst = 'R1' GROUP BY 1""", "places", "supplies", "ordered", name="shock_severity",
    f=lambda g: propagation.severity(g, _LEGS, "R1", 2, "share", "CUSTOMER").withColumn("ways", F.col("ways").cast("long")),
)
graph_query(
    "SELECT n.dst AS n0, n.src AS n1, p.src AS n2, n.edge_id AS e1, p.edge_id AS e2 FROM places n JOIN places p ON p.rel = 'LOCATED_IN' AND p.dst = n.src WHERE n.rel = 'IN_REGION'", "places", name="chain_any_direction",
    f=lambda g: propagation.along(g, _LEGS[:2]),
)
_BRAND = "(SELECT min(p_brand) FROM part)"
graph_query(
    f"""SELECT id, name, round(CAST(sum(CASE WHEN p_brand = {_BRAND} THEN value ELSE 0 END) AS DOUBLE) / CAST(sum(value) AS DOUBLE), 6) AS theme_purity, count(*) FILTER (WHERE p_brand = {_BRAND}) AS edge_count
FROM ordered JOIN part ON 'P' || p_partkey = dst JOIN nodes ON id = src GROUP BY 1, 2 HAVING edge_count > 0""", "nodes", "ordered", name="revenue_purity",
    f=lambda g: _purity(g, g.of_type("BRAND").agg(F.min("id")).first()[0]),
)


def _purity(g: PropertyGraph, brand: str) -> DataFrame:
    """How much of what customers order is of a brand, and the number of ways from the brand to them."""
    theme = g.with_rel("HAS_BRAND").filter(F.col("dst") == brand).select(F.col("src").alias("id"))
    return propagation.revenue_purity(g, brand, [("HAS_BRAND", "in"), ("ORDERED", "in")], ["ORDERED"], theme, "CUSTOMER")


def _flow(g: PropertyGraph) -> PropertyGraph:
    """Shocks flow from regions to nations, to suppliers and on to what they supply; every third edge turns the sign."""
    down = g.with_rel("IN_REGION", "LOCATED_IN").filter(F.col("dst").startswith("R") | F.col("src").startswith("S"))
    down = down.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", F.lit(None).cast("double").alias("share"))
    edges = down.unionByName(g.with_rel("SUPPLIES").select("edge_id", "src", "dst", "rel", "share"))
    return PropertyGraph(g.nodes, edges.withColumn("sign", F.when(F.col("edge_id") % 3 == 0, "-").otherwise("+")))


_ROUND = """flow AS (SELECT edge_id, dst AS src, src AS dst, CAST(1 AS DOUBLE) AS w FROM places WHERE rel = 'IN_REGION' OR rel = 'LOCATED_IN' AND src LIKE 'S%' UNION ALL SELECT edge_id, src, dst, share FROM supplies),
signed AS (SELECT src, dst, w, CASE WHEN edge_id % 3 = 0 THEN -1 ELSE 1 END AS s, CASE WHEN src = 'R1' THEN -1 ELSE 1 END AS flip, sum(w) OVER (PARTITION BY src) AS whole FROM flow),
shares AS (SELECT src, dst, sum(s * w / whole * 0.5) AS a, sum(flip * s * w / whole * 0.5) AS b FROM signed GROUP BY ALL),
r0 AS (SELECT * FROM (VALUES ('R1', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)), ('R2', 1, 1)) t(id, x, y)),
r1 AS (SELECT dst AS id, sum(x * a) AS x, sum(y * b) AS y FROM r0 JOIN shares ON src = id GROUP BY 1),
r2 AS (SELECT dst AS id, sum(x * a) AS x, sum(y * b) AS y FROM r1 JOIN shares ON src = id GROUP BY 1),
r3 AS (SELECT dst AS id, sum(x * a) AS x, sum(y * b) AS y FROM r2 JOIN shares ON src = id GROUP BY 1),
total AS (SELECT id, sum(x) AS x, sum(y) AS y FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY 1)"""
_SHOCK = [("R1", 1.0), ("R2", 1.0)]
graph_query(
    f"+ {_ROUND}\n---\nSELECT id, round(x, 9) AS effect FROM total", "places", "supplies", name="shock_effects",
    f=lambda g: propagation.propagated(_flow(g), g.nodes.sparkSession.createDataFrame(_SHOCK, "id string, effect double"), rounds=3, tolerance=0.0, weight="share").withColumn("effect", F.round("effect", 9)),
)
graph_query(
    f"""+ {_ROUND}
---
SELECT id, effect, flipped_effect FROM (SELECT id, round(x, 9) AS effect, round(y, 9) AS flipped_effect, ntile(10) OVER (ORDER BY round(abs(x), 9) DESC, id) AS p, ntile(10) OVER (ORDER BY round(abs(y), 9) DESC, id) AS q
FROM total JOIN nodes USING (id) WHERE type = 'PART') WHERE p = 1 AND q = 1""", "nodes", "places", "supplies", name="volatile_both",
    f=lambda g: propagation.volatile(_flow(g), g.nodes.sparkSession.createDataFrame(_SHOCK, "id string, effect double"), "R1", "PART", rounds=3, tolerance=0.0, weight="share")
    .select("id", F.round("effect", 9).alias("effect"), F.round("flipped_effect", 9).alias("flipped_effect")),
)

# -- SQL for the queries over the whole graph -------------------------------------------------------------------------
_ONE = "asked AS (SELECT '{start}' AS source)"
_with_sql("shortest_path_hops_whole", _asked(_ONE.format(start="R1"), 12) + "SELECT id, hops FROM far", "edges", "adj")
_with_sql("reachable_k_whole", _asked(_ONE.format(start="S1"), 6) + "SELECT id, name, hops FROM far JOIN nodes USING (id) WHERE hops > 0 AND type = 'REGION' ORDER BY hops, id LIMIT 20", "nodes", "edges", "adj")
for _how, _test in {"more": ", CASE WHEN hops_a < hops_b THEN 'S1' ELSE 'S2' END AS more_exposed", "less": ", CASE WHEN hops_a > hops_b THEN 'S1' ELSE 'S2' END AS less_exposed", "approx": ""}.items():
    QUERIES[f"compare_shock_{_how}_whole"] = lambda spark, d, how=_how: paths.compare_exposure(testgraph(spark, d), "S1", "S2", "R1", how).drop("facts_a", "facts_b")
    _with_sql(
        f"compare_shock_{_how}_whole", _asked(_ONE.format(start="R1"), 12) + f"SELECT *{_test} FROM (SELECT max(CASE WHEN id = 'S1' THEN hops END) AS hops_a, max(CASE WHEN id = 'S2' THEN hops END) AS hops_b FROM far)"
        + (" WHERE abs(hops_a - hops_b) <= 1" if _how == "approx" else ""), "edges", "adj",
    )
_with_sql(
    "causal_trails_whole", """+ trail(id, hops, path, used) AS (SELECT 'S1', 0, 'S1', CAST([] AS BIGINT[]) UNION ALL SELECT dst, hops + 1, path || ' -[' || rel || ']-> ' || dst, list_append(used, edge_id) FROM trail JOIN edges ON src = id
  WHERE hops < 10 AND NOT list_contains(used, edge_id))
---
SELECT id, CAST(hops AS INTEGER) AS hops, path FROM trail WHERE hops > 0""", "edges",
)
_with_sql(
    "ontology_conformance_whole", """+ allowed(a, b, rel) AS (VALUES ('SUPPLIER', 'PART', 'SUPPLIES'), ('CUSTOMER', 'NATION', 'LOCATED_IN'), ('NATION', 'REGION', 'IN_REGION')),
r AS (SELECT edge_id, x.type AS src_type, rel, y.type AS dst_type FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst)
---
SELECT *, CASE WHEN rel IN ('HAS_TYPE', 'BELONGS_TO_SEGMENT', 'ORDERED') THEN 'undeclared relation' ELSE 'not allowed for the types' END AS reason FROM r WHERE rel <> 'HAS_BRAND' AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = src_type AND b = dst_type AND allowed.rel = r.rel)""",
    "nodes", "edges",
)
_with_sql(
    "edges_between_whole", """+ first_of AS (SELECT 'R' || n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1), near(src, dst) AS (SELECT DISTINCT src, dst FROM adj WHERE src <> dst),
ends AS (SELECT 'S1' AS source UNION ALL SELECT region FROM first_of),
walk(source, id, hops) AS (SELECT source, source, 0 FROM ends UNION SELECT source, dst, hops + 1 FROM walk JOIN near ON src = walk.id WHERE hops < 12),
far AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY ALL)
---
SELECT DISTINCT edge_id FROM adj JOIN far a ON a.source = 'S1' AND a.id = adj.src JOIN far b ON b.source <> 'S1' AND b.id = adj.dst WHERE a.hops + 1 + b.hops <= 12""", "edges", "adj",
)
_with_sql(
    "graph_node_docs_whole", """+ named AS (SELECT src, rel, list_sort(list(coalesce(name, dst))) AS neighbours FROM edges LEFT JOIN nodes ON id = dst GROUP BY ALL)
---
SELECT id, name, type, rel, CASE WHEN rel IS NOT NULL THEN 0 END AS part, coalesce(neighbours, []) AS neighbours FROM nodes LEFT JOIN named ON src = id""", "nodes", "edges",
)  # fmt: skip  (no node of these tables has more than NEIGHBOURS edges of a relation; the parts of one that has are tested)
