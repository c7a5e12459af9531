"""The driver's tables as a property graph, and the SQL that builds the same nodes and edges.

Edges of all kinds are one union, so a filter on rel or type leaves only the tables that it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.storage import signature, written_once

_BIG = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


#: What the graph is made of.
TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]


def testgraph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The tables' graph, written once and read from then on: nodes by id; edges in a folder for each relation, by src, and
    once more by dst. It is written anew when a table changes."""

    def write(path: str) -> None:
        g = derived(spark, sf_dir)
        g.nodes.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/nodes")
        for name, by in (("edges", "src"), ("reverse", "dst")):
            rows = g.edges if name == "edges" else spark.read.schema(g.edges.schema).parquet(f"{path}/edges")
            rows.repartitionByRange("rel", by, "edge_id").sortWithinPartitions("rel", by, "edge_id").write.partitionBy("rel").parquet(f"{path}/{name}")

    path = written_once(spark, "graph-" + signature(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]), write)
    edges = T.StructType([T.StructField(f.name, f.dataType) for f in _edge_schema()])
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return PropertyGraph(read("nodes", "id string, name string, type string, labels array<string>"), read("edges", edges), read("reverse", edges))


def _edge_schema() -> list[T.StructField]:
    kinds = {"edge_id": T.LongType(), "src": T.StringType(), "dst": T.StringType(), "rel": T.StringType(), "fact": T.StringType(), "value": T.DoubleType(), "share": T.DoubleType(), "valid_at": T.TimestampType()}
    return [T.StructField(name, kind) for name, kind in kinds.items()]


def derived(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The same as a plan over the tables; a filter on a relation or type leaves only the tables that it needs."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda df, i, name, kind, label: df.select(i.alias("id"), name.alias("name"), F.lit(kind).alias("type"), F.array(F.lit("Entity"), F.lit(label)).alias("labels"))
    nodes = [
        node(t("region"), _id("R", "r_regionkey"), F.col("r_name"), "REGION", "Region"),
        node(t("nation"), _id("N", "n_nationkey"), F.col("n_name"), "NATION", "Nation"),
        node(t("supplier"), _id("S", "s_suppkey"), F.col("s_name"), "SUPPLIER", "Supplier"),
        node(t("customer"), _id("C", "c_custkey"), F.col("c_name"), "CUSTOMER", "Customer"),
        node(t("part"), _id("P", "p_partkey"), F.col("p_name"), "PART", "Part"),
        node(t("part").select("p_brand").distinct(), F.col("p_brand"), F.col("p_brand"), "BRAND", "Brand"),
        node(t("part").select("p_type").distinct(), F.col("p_type"), F.col("p_type"), "PTYPE", "PartType"),
        node(t("customer").select("c_mktsegment").distinct(), F.col("c_mktsegment"), F.col("c_mktsegment"), "SEGMENT", "Segment"),
    ]
    edge = lambda df, code, key, src, dst, rel, *more: df.select((F.lit(code * _BIG * _BIG) + key).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), *more)
    edges = [
        edge(t("nation"), 1, F.col("n_nationkey"), _id("N", "n_nationkey"), _id("R", "n_regionkey"), "IN_REGION"),
        edge(t("supplier"), 2, F.col("s_suppkey"), _id("S", "s_suppkey"), _id("N", "s_nationkey"), "LOCATED_IN"),
        edge(t("customer"), 2, F.col("c_custkey") + _BIG, _id("C", "c_custkey"), _id("N", "c_nationkey"), "LOCATED_IN"),
        edge(t("part"), 3, F.col("p_partkey"), _id("P", "p_partkey"), F.col("p_brand"), "HAS_BRAND"),
        edge(t("part"), 3, F.col("p_partkey") + _BIG, _id("P", "p_partkey"), F.col("p_type"), "HAS_TYPE"),
        edge(t("customer"), 4, F.col("c_custkey"), _id("C", "c_custkey"), F.col("c_mktsegment"), "BELONGS_TO_SEGMENT"),
        _supplies(t("lineitem")),
        _ordered(t("orders"), t("lineitem")),
    ]
    return PropertyGraph(union_all(nodes), union_all(edges).withColumn("valid_at", F.lit(None).cast("timestamp")))


def _supplies(lineitem: DataFrame) -> DataFrame:
    """Distinct (supplier, part) with the mean discount in hundredths of a per cent, rounded half up in whole numbers."""
    rows = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.count(F.lit(1)).alias("n"))
    cents = F.expr("(200 * d + n) div (2 * n)")
    amount = F.concat(F.expr("cast(cents div 100 as string)"), F.lit("."), F.lpad(F.expr("cast(cents % 100 as string)"), 2, "0"), F.lit("%"))
    growth = F.col("l_partkey") % 11 == 0
    fact = F.when(growth, F.concat(F.lit("discount growth of "), amount, F.lit(" year-on-year"))).otherwise(F.concat(F.lit("supplies at "), amount, F.lit(" discount")))
    value = F.when(F.col("l_suppkey") % 3 == 0, F.lit(None)).when(F.col("l_suppkey") % 7 == 0, F.col("cents") * 10.0).otherwise(F.col("cents") / 100.0)
    rows = rows.withColumn("cents", cents)
    return rows.select((F.lit(5 * _BIG * _BIG) + F.col("l_suppkey") * _BIG + F.col("l_partkey")).alias("edge_id"), _id("S", "l_suppkey").alias("src"), _id("P", "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("rel"), fact.alias("fact"), value.cast("double").alias("value"), (F.col("n") / 10.0).alias("share"))


def _ordered(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_custkey").join(lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity"), "o_orderkey").groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
    return rows.select((F.lit(6 * _BIG * _BIG) + F.col("o_custkey") * _BIG + F.col("l_partkey")).alias("edge_id"), _id("C", "o_custkey").alias("src"), _id("P", "l_partkey").alias("dst"), F.lit("ORDERED").alias("rel"), "value")


#: The same in SQL, as common table expressions; each query takes those that it needs.
CTE = {
    "nodes": """nodes AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'REGION' AS type, 'Region' AS label FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'NATION', 'Nation' FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'SUPPLIER', 'Supplier' FROM supplier
  UNION ALL SELECT 'C' || c_custkey, c_name, 'CUSTOMER', 'Customer' FROM customer
  UNION ALL SELECT 'P' || p_partkey, p_name, 'PART', 'Part' FROM part
  UNION ALL SELECT DISTINCT p_brand, p_brand, 'BRAND', 'Brand' FROM part
  UNION ALL SELECT DISTINCT p_type, p_type, 'PTYPE', 'PartType' FROM part
  UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment, 'SEGMENT', 'Segment' FROM customer)""",
    "supplies": """pairs AS (SELECT l_suppkey AS s, l_partkey AS p, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY ALL),
cents AS (SELECT *, (200 * d + n) // (2 * n) AS c FROM pairs),
amounts AS (SELECT *, (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '%' AS a FROM cents),
supplies AS (SELECT 5000000000000000000 + s * 1000000000 + p AS edge_id, 'S' || s AS src, 'P' || p AS dst, 'SUPPLIES' AS rel,
  CASE WHEN p % 11 = 0 THEN 'discount growth of ' || a || ' year-on-year' ELSE 'supplies at ' || a || ' discount' END AS fact,
  CASE WHEN s % 3 = 0 THEN NULL WHEN s % 7 = 0 THEN c * CAST(10 AS DOUBLE) ELSE c / CAST(100 AS DOUBLE) END AS value, n / CAST(10 AS DOUBLE) AS share FROM amounts)""",
    "ordered": """ordered AS (SELECT 6000000000000000000 + o_custkey * 1000000000 + l_partkey AS edge_id, 'C' || o_custkey AS src, 'P' || l_partkey AS dst, 'ORDERED' AS rel,
  CAST(NULL AS VARCHAR) AS fact, sum(l_quantity) AS value, CAST(NULL AS DOUBLE) AS share FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)""",
    "places": """places AS (
  SELECT 1000000000000000000 + n_nationkey AS edge_id, 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'IN_REGION' AS rel FROM nation
  UNION ALL SELECT 2000000000000000000 + s_suppkey, 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT 2000000001000000000 + c_custkey, 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN' FROM customer
  UNION ALL SELECT 4000000000000000000 + c_custkey, 'C' || c_custkey, c_mktsegment, 'BELONGS_TO_SEGMENT' FROM customer)""",
    "kinds": """kinds AS (
  SELECT 3000000000000000000 + p_partkey AS edge_id, 'P' || p_partkey AS src, p_brand AS dst, 'HAS_BRAND' AS rel FROM part
  UNION ALL SELECT 3000000001000000000 + p_partkey, 'P' || p_partkey, p_type, 'HAS_TYPE' FROM part)""",
    "edges": """edges AS (SELECT edge_id, src, dst, rel, fact, value, share FROM supplies UNION ALL SELECT * FROM ordered
  UNION ALL SELECT edge_id, src, dst, rel, NULL, NULL, NULL FROM places UNION ALL SELECT edge_id, src, dst, rel, NULL, NULL, NULL FROM kinds)""",
    "adj": """adj AS (SELECT edge_id, src, dst, rel, fact, value, share FROM edges UNION ALL SELECT edge_id, dst, src, rel, fact, value, share FROM edges WHERE src <> dst)""",
}


def with_tables(sql: str, *names: str, recursive: bool = False) -> str:
    """sql behind the named common table expressions and those that they build on."""
    needs = {"edges": ["supplies", "ordered", "places", "kinds"], "adj": ["supplies", "ordered", "places", "kinds", "edges"]}
    wanted = [n for n in CTE if n in names or any(n in needs.get(m, ()) for m in names)]
    more = ""
    if sql.lstrip().startswith("+"):
        more, sql = "," + sql.lstrip()[1:].split("\n---\n")[0], sql.split("\n---\n")[1]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[n] for n in wanted) + more + "\n" + sql
