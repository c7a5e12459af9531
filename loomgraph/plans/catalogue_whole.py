"""Queries over whole tables and the whole graph, with the operators' own limits. They have no SQL: where SQL can follow, the
query of the same name without _whole gives a part of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators import paths, quality
from loomgraph.plans.catalogue import _region_of_first, graph_query, query
from loomgraph.plans.catalogue_more import _ALLOWED
from loomgraph.plans.linking import mentions
from loomgraph.plans.testgraph import table, testgraph
from loomgraph.sources import files

#: Neighbours in a part of a node's list, and rows of a side that may be broadcast after they have been counted.
NEIGHBOURS, BROADCAST_ROWS = 1000, 100_000


@query()
def episodes_chunk_whole(spark, sf_dir):
    """The episodes of all documents, with their contents."""
    return files.episodes(table(spark, sf_dir, "documents"), "text")


@query()
def ontology_conformance_whole(spark, sf_dir):
    """All edges of all relations that break the ontology."""
    allowed = spark.createDataFrame(_ALLOWED, "src_type string, dst_type string, rel string")
    return quality.conformance(testgraph(spark, sf_dir), allowed.select("rel"), allowed)


def node_docs(g: PropertyGraph, most: int = NEIGHBOURS) -> DataFrame:
    """(id, name, type, rel, part, neighbours): every node with the names of what its edges of each relation lead to, the id
    where there is no name. Where a node has more than `most` edges of a relation they are dealt into parts of about `most`;
    a node without edges has one row without relation."""
    edges = g.edges.select(F.col("src").alias("id"), "rel", "edge_id", "dst")
    hot = edges.groupBy("id", "rel").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("id", "rel", F.ceil(F.col("n") / most).alias("parts"))
    hot = F.broadcast(hot) if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hot
    dealt = edges.join(hot, ["id", "rel"], "left").withColumn("part", F.pmod(F.xxhash64("edge_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    named = dealt.join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst", "left")
    lists = named.groupBy("id", "rel", "part").agg(F.array_sort(F.collect_list(F.coalesce("other", "dst"))).alias("neighbours"))
    return g.nodes.select("id", "name", "type").join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


graph_query(None, name="graph_node_docs_whole", f=node_docs)

# -- paths over all relations, within the operators' own hop limits ----------------------------------------------------
graph_query(None, name="shortest_path_hops_whole", f=lambda g: paths.hop_counts(g, "R1"))
graph_query(None, name="reachable_k_whole", f=lambda g: paths.reachable(g, "S1", kind="REGION"))
for _how in ("more", "less", "approx"):
    graph_query(None, name=f"compare_shock_{_how}_whole", f=lambda g, how=_how: paths.compare_exposure(g, "S1", "S2", "R1", how))
graph_query(None, name="compare_pair_whole", f=lambda g: paths.compare_pair(g, "S1", "S2"))
graph_query(None, name="causal_trails_whole", f=lambda g: paths.trails(g, "S1", None, limit=None).select("id", "hops", paths.rendered(F.col("path_nodes"), F.col("path_rels")).alias("path")))
graph_query(None, name="edges_between_whole", f=lambda g: paths.edges_between(g, "S1", _region_of_first(g)))


@query()
def gazetteer_link_whole(spark, sf_dir):
    """Mentions of the graph's part and brand names in questions about parts."""
    part = table(spark, sf_dir, "part")
    names = [r[0] for r in part.select(F.col("p_name").alias("n")).union(part.select("p_brand")).distinct().filter("n IS NOT NULL").collect()]
    question = F.concat(F.lit("Does "), "p_brand", F.lit(" sell the "), F.upper("p_name"), F.lit(", or is "), "p_name", F.lit("s by "), "p_brand", F.lit("?"))
    return mentions(part.select("p_partkey", question.alias("question")), "question", names)
