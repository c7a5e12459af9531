"""Neighbour, set, count and value queries around one or two nodes. Undirected unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expressions import BOOKKEEPING, has_label, name_contains, value_of
from loomgraph.graph import PropertyGraph, union_all

DEFAULTS = {"more": 0, "less": 999, "approx": 1, "atmost": 5, "atleast": 1, "equal": 1}


def _named(nodes: DataFrame, key: str, prefix: str) -> DataFrame:
    return nodes.select(F.col("id").alias(key), F.col("name").alias(f"{prefix}_name"), F.col("type").alias(f"{prefix}_type"))


def endpoints(g: PropertyGraph, edges: DataFrame, subjects: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """edges with subject_name, subject_type, object_name and object_type; both endpoints must exist."""
    return edges.join(_named(g.nodes if subjects is None else subjects, "src", "subject"), "src").join(_named(g.nodes if objects is None else objects, "dst", "object"), "dst")


def facts_of(g: PropertyGraph, node: str | list[str], rels: list[str] | None = None, subject_label: str | None = None, targets: list[str] | None = None) -> DataFrame:
    """One row for each edge at a node, in either direction, seen from the node; filters only where they are given."""
    ids = [node] if isinstance(node, str) else node
    edges = g.adjacency(*(rels or [])).filter(F.col("src").isin(*ids))
    if targets:
        edges = edges.filter(F.col("dst").isin(*targets))
    subjects = g.nodes.filter(F.col("id").isin(*ids))
    if subject_label:
        subjects = subjects.filter(has_label(F.col("labels"), F.col("type"), subject_label))
    return endpoints(g, edges, subjects).select("edge_id", F.col("src").alias("subject_id"), "subject_name", F.col("rel").alias("relationship"), F.col("dst").alias("object_id"), "object_name", "object_type", "fact", "valid_at", value_of(g.edges.columns).alias("value"))


def neighbours(g: PropertyGraph, node: str, rels: list[str] | None = None, subject_label: str | None = None, targets: list[str] | None = None, limit: int = 50) -> DataFrame:
    """One-hop neighbours by object name."""
    return facts_of(g, node, rels, subject_label, targets).orderBy("object_name", "edge_id").limit(limit)


def log_union(g: PropertyGraph, node: str, other: str | None = None, rels: list[str] | None = None) -> DataFrame:
    """Facts of one node and, where given, of another; each distinct triple once."""
    rows = facts_of(g, node, rels)
    rows = rows if other is None else rows.unionByName(facts_of(g, other, rels))
    return rows.select("subject_name", "relationship", "object_id", "object_name", "fact").distinct()


def log_intersection(g: PropertyGraph, node: str, other: str, rels: list[str] | None = None) -> DataFrame:
    """Nodes that both reach by an edge; the relation filter holds for the first one's."""
    a = g.with_rel(*(rels or [])).filter(F.col("src") == node).select("dst", F.col("rel").alias("relationship"), F.col("edge_id").alias("_a"))
    b = g.edges.filter(F.col("src") == other).select("dst", F.col("rel").alias("other_relationship"), F.col("edge_id").alias("_b"))
    return a.join(b, "dst").filter("_a <> _b").join(_named(g.nodes, "dst", "object"), "dst").select(F.col("dst").alias("object_id"), "object_name", "relationship", "other_relationship")


def log_difference(g: PropertyGraph, node: str, other: str, rels: list[str] | None = None) -> DataFrame:
    """Out-neighbours of one node that have no edge with the other, in any direction."""
    mine = g.with_rel(*(rels or [])).filter(F.col("src") == node)
    theirs = g.adjacency().filter(F.col("src") == other).select("dst")
    return mine.join(theirs, "dst", "left_anti").join(_named(g.nodes, "dst", "object"), "dst").select(F.col("dst").alias("object_id"), "object_name", F.col("rel").alias("relationship"))


def object_counts(g: PropertyGraph, rels: list[str] | None = None, subject_type: str | None = None) -> DataFrame:
    """Edges (not distinct objects) that leave each subject; a subject without any has no row."""
    subjects = g.of_type(subject_type) if subject_type else g.nodes
    return g.with_rel(*(rels or [])).groupBy("src").agg(F.count(F.lit(1)).alias("object_count")).join(_named(subjects, "src", "subject"), "src").select(F.col("src").alias("subject_id"), "subject_name", "object_count")


def counted(g: PropertyGraph, how: str, threshold: float | None = None, rels: list[str] | None = None, subject_type: str | None = None) -> DataFrame:
    """Subjects whose count is more, less, approx (within one), atmost, atleast or equal to the threshold or its default."""
    t, n = DEFAULTS[how] if threshold is None else threshold, F.col("object_count")
    tests: dict[str, Column] = {"more": n > t, "less": n < t, "approx": n.between(t - 1, t + 1), "atmost": n <= t, "atleast": n >= t, "equal": n == t}
    rows = object_counts(g, rels, subject_type).filter(tests[how])
    return rows.withColumn("target_count", F.lit(t)) if how == "approx" else rows


def collected(g: PropertyGraph, subject_type: str | None = None, rels: list[str] | None = None, object_type: str | None = None) -> DataFrame:
    """Number of neighbours with their facts and dates, kept as pairs and in a fixed order; facts are never torn from dates."""
    objects = g.of_type(object_type) if object_type else g.nodes
    edges = g.adjacency(*(rels or [])).join(objects.select(F.col("id").alias("dst")), "dst", "left_semi")
    rows = edges.groupBy("src").agg(F.count(F.lit(1)).alias("object_count"), F.array_sort(F.collect_list(F.struct("fact", "valid_at"))).alias("pairs"))
    subjects = g.of_type(subject_type) if subject_type else g.nodes
    return rows.join(_named(subjects, "src", "subject"), "src").select(F.col("src").alias("subject_id"), "subject_name", "object_count", F.filter(F.transform("pairs", lambda p: p["fact"]), lambda f: f.isNotNull()).alias("facts"), "pairs")


def by_value(g: PropertyGraph, how: str, threshold: float | None = None, rels: list[str] | None = None, columns: tuple[str, ...] = ("share", "weight")) -> DataFrame:
    """Out-edges whose share or weight is atmost, atleast, approx (within 0.1) or equal to the threshold.

    A missing value counts as 1.0, 0.0, 0.5 and 0.0 in these tests; the value that is returned stays null."""
    missing, t0 = {"atmost": (1.0, 1.0), "atleast": (0.0, 0.0), "approx": (0.5, 0.5), "equal": (0.0, 0.0)}[how]
    t = t0 if threshold is None else threshold
    raw = F.coalesce(*[F.col(c) for c in columns])
    v = F.coalesce(raw, F.lit(missing))
    test = {"atmost": v <= t, "atleast": v >= t, "approx": v.between(t - 0.1, t + 0.1), "equal": v == t}[how]
    return endpoints(g, g.with_rel(*(rels or [])).filter(test)).select("edge_id", "subject_name", F.col("rel").alias("relationship"), "object_name", raw.alias("value"))


def extreme(g: PropertyGraph, node: str | None = None, largest: bool = True, rels: list[str] | None = None) -> DataFrame:
    """The edge of largest or smallest value at a node, or for each subject; ties go to the lowest edge."""
    edges = g.adjacency(*(rels or []))
    edges = edges if node is None else edges.filter(F.col("src") == node)
    v = value_of(g.edges.columns, 1.0)
    best = (F.max_by if largest else F.min_by)(F.struct("edge_id", "dst", "rel", "fact", v.alias("value")), F.struct(v, (-F.col("edge_id") if largest else F.col("edge_id"))))
    rows = edges.groupBy("src").agg(best.alias("best")).select("src", "best.*")
    return endpoints(g, rows).select(F.col("src").alias("subject_id"), "subject_name", F.col("rel").alias("relationship"), "object_name", "fact", F.col("value").alias("max_value" if largest else "min_value"))


def relaxed_direction(g: PropertyGraph, node: str, rels: list[str] | None = None) -> DataFrame:
    """Out-edges and in-edges of a node in one list of distinct rows."""
    return facts_of(g, node, rels).select("subject_name", "relationship", "object_id", "object_name", "fact").distinct()


def topped_up(rows: DataFrame, broader: DataFrame, key: list[str], limit: int = 40) -> DataFrame:
    """rows and those of a broader query that they lack, the first kind in front."""
    more = broader.join(rows.select(*key), key, "left_anti").orderBy(*key).limit(limit)
    return rows.withColumn("added", F.lit(False)).unionByName(more.withColumn("added", F.lit(True)))


def companies_by_topic(g: PropertyGraph, topics: list[str], kind: str = "COMPANY", rels: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Nodes of a kind with an edge to something whose name contains a topic."""
    wanted = F.lit(False)
    for topic in topics:
        wanted = wanted | F.lower("name").contains(topic.lower())
    objects = g.nodes.filter(wanted).select(F.col("id").alias("dst"), F.col("name").alias("object_name"))
    rows = g.adjacency(*(rels or [])).join(objects, "dst").join(_named(g.of_type(kind), "src", "subject"), "src")
    return rows.select("subject_name", F.col("rel").alias("relationship"), "object_name").distinct().orderBy("subject_name", "object_name", "relationship").limit(limit)


def attributes(nodes: DataFrame, node: str | None = None) -> DataFrame:
    """A node's own properties, one row each, without bookkeeping ones and empty ones."""
    rows = nodes if node is None else nodes.filter(F.col("id") == node)
    kept = F.map_filter("props", lambda k, v: ~k.isin(*BOOKKEEPING) & v.isNotNull() & (v != ""))
    return rows.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), F.explode(kept).alias("attribute", "value"))


def compared(g: PropertyGraph, a: str, b: str, rels: list[str] | None = None, metric: str | None = None, limit: int = 20) -> DataFrame:
    """Facts of two nodes side by side, up to `limit` for either; with a metric only those whose object's name matches it."""
    sides = []
    for node in (a, b):
        rows = facts_of(g, node, rels).select("subject_name", "relationship", "object_id", "object_name", "fact").distinct()
        if metric:
            rows = rows.filter(name_contains(F.col("object_name"), F.lit(metric)))
        sides.append(rows.orderBy("object_name", "relationship", "object_id", "fact").limit(limit))
    return union_all(sides)


def profiles(nodes: DataFrame, names: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """(subject_name, profile) of nodes with a summary, by name or id."""
    wanted = F.col("name").isin(*names) if names else F.col("id").isin(*ids) if ids else F.lit(True)
    return nodes.filter(wanted & F.col("summary").isNotNull()).select(F.col("name").alias("subject_name"), F.col("summary").alias("profile"))


def expanded(g: PropertyGraph, nodes: DataFrame) -> DataFrame:
    """Nodes with their neighbours, in either direction; those without any have one row of nulls."""
    near = g.adjacency().select(F.col("src").alias("id"), "rel", "dst").join(_named(g.nodes, "dst", "object"), "dst")
    return nodes.select("id", "name").join(near.select("id", "rel", "object_name"), "id", "left")
