"""Shocks that spread along signed edges, and what recipes ask of them: severity, sign flips, purity by revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators import many, patterns
from loomgraph.storage import cut

#: The share of a node's effect that it hands on, the change from which on another round is worth it, and the most rounds.
DAMPING, TOLERANCE, ROUNDS = 0.5, 1e-6, 30


def _sign() -> Column:
    return F.when(F.col("sign") == "-", -1.0).otherwise(1.0)


def propagated(g: PropertyGraph, shocks: DataFrame, rels: list[str] | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS, weight: str | None = None) -> DataFrame:
    """(id, effect) of every node that shocks (id, effect) reach along directed edges.

    In each round a node hands `damping` of what it has just received on to its out-neighbours, in proportion to the edges' weight
    (a column; all alike without one, and a missing weight is 1), with the edge's sign; effects add up. What is on its way shrinks
    by `damping` a round, so the rounds end: when no node receives more than `tolerance`, or after `rounds`.
    """
    edges = g.with_rel(*(rels or []))
    edges = edges.select("src", "dst", _sign().alias("sign"), (F.coalesce(F.abs(F.col(weight)), F.lit(1.0)) if weight else F.lit(1.0)).alias("weight"))
    whole = edges.groupBy("src").agg(F.sum("weight").alias("whole"))
    shares = edges.groupBy("src", "dst").agg(F.sum(F.col("sign") * F.col("weight")).alias("net"))
    shares = cut(shares.join(whole.filter("whole > 0"), "src").select("src", "dst", (F.col("net") / F.col("whole") * damping).alias("share")))
    moving = cut(shocks.groupBy("id").agg(F.sum("effect").cast("double").alias("effect")))
    total = moving
    for _ in range(rounds):
        moving = cut(moving.join(shares, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("effect") * F.col("share")).alias("effect")))
        total = cut(total.unionByName(moving).groupBy("id").agg(F.sum("effect").alias("effect")))
        if not moving.filter(F.abs("effect") > tolerance).limit(1).count():
            break
    return total


def volatile(g: PropertyGraph, shocks: DataFrame, flipped: str, kind: str, parts: int = 10, **options) -> DataFrame:
    """(id, effect, flipped_effect) of the nodes of a kind that are in the first part (decile) by severity both as things are and with
    the signs of what leaves `flipped` inverted: exposed to the shock, whichever way it goes. Severity is the effect's size; ties
    go by id. Two runs of the propagation over all nodes."""
    runs = []
    for graph, name in ((g, "effect"), (patterns.sign_flipped(g, flipped), "flipped_effect")):
        reached = propagated(graph, shocks, **options).withColumnRenamed("effect", name)
        runs.append(reached)
    rows = cut(g.of_type(kind).select("id").join(runs[0], "id").join(runs[1], "id"))
    severity = rows.select("id", F.round(F.abs("effect"), 9).alias("a"), F.round(F.abs("flipped_effect"), 9).alias("b"))
    first = patterns.deciles(severity, "id", "a", "b", parts=parts).filter("a_part = 1 AND b_part = 1")
    return rows.join(first.select("id"), "id")


def along(g: PropertyGraph, legs: list[tuple[str, str]], anchor: str | None = None) -> DataFrame:
    """(n0, n1, ..., e1, ...): paths that follow the legs (relation, direction) one after the other, with each leg's edge. A direction
    is out, in or any; any goes along an edge either way."""
    rows = None
    for k, (rel, way) in enumerate(legs):
        if way not in ("out", "in", "any"):
            raise ValueError(f"no direction: {way}")
        edges = g.with_rel(rel) if way == "out" else g.adjacency(rel) if way == "any" else g.adjacency(rel).filter("NOT forward OR src = dst")
        step = edges.select(F.col("src").alias(f"n{k}"), F.col("dst").alias(f"n{k + 1}"), F.col("edge_id").alias(f"e{k + 1}"))
        step = step.filter(F.col("n0") == anchor) if k == 0 and anchor is not None else step
        rows = step if rows is None else rows.join(step, f"n{k}")
    return rows.select(*[f"n{k}" for k in range(len(legs) + 1)], *[f"e{k + 1}" for k in range(len(legs))])


def severity(g: PropertyGraph, legs: list[tuple[str, str]], anchor: str, by: int, weight: str = "share", kind: str | None = None) -> DataFrame:
    """(id, severity, ways): what a shock reaches along the legs, by the largest weight of leg `by` (its cost share) on any way there,
    and the number of ways. The heaviest edge and the number are summed up leg by leg, so ways aren't listed."""
    at = g.nodes.filter(F.col("id") == anchor).select("id", F.lit(None).cast("double").alias("severity"), F.lit(1).cast("decimal(38,0)").alias("ways"))
    for k, (rel, way) in enumerate(legs):
        edges = g.with_rel(rel) if way == "out" else g.adjacency(rel) if way == "any" else g.adjacency(rel).filter("NOT forward OR src = dst")
        edges = edges.select("src", "dst", (F.col(weight).cast("double") if k == by else F.lit(None).cast("double")).alias("_w"))
        step = at.join(edges, F.col("id") == F.col("src"))
        at = cut(step.groupBy(F.col("dst").alias("id")).agg(F.max(F.greatest("severity", "_w")).alias("severity"), F.sum("ways").cast("decimal(38,0)").alias("ways")))
    return at if kind is None else at.join(g.of_type(kind).select("id"), "id", "left_semi")


def revenue_purity(g: PropertyGraph, shock: str, legs: list[tuple[str, str]], revenue_rels: list[str], theme: DataFrame, kind: str = "COMPANY", revenue: str = "value") -> DataFrame:
    """(id, name, theme_purity, edge_count) of the nodes of a kind that a shock reaches along the legs: the revenue of their edges
    (revenue_rels) to theme's nodes (id) as a share of all their revenue, null where they have none, and the number of ways from
    the shock."""
    ways = severity(g, legs, shock, -1, kind=kind).select("id", F.col("ways").cast("long").alias("edge_count"))
    earned = g.with_rel(*revenue_rels).select(F.col("src").alias("id"), "dst", F.col(revenue).alias("_v"))
    marked = earned.join(theme.select(F.col("id").alias("dst"), F.lit(True).alias("_theme")).distinct(), "dst", "left")
    sums = marked.groupBy("id").agg(F.sum("_v").alias("_all"), F.sum(F.when(F.col("_theme"), F.col("_v")).otherwise(0.0)).alias("_some"))
    rows = g.of_type(kind).select("id", "name").join(ways, "id").join(sums, "id", "left")
    return rows.select("id", "name", F.round(F.when(F.col("_all") != 0, F.col("_some") / F.col("_all")), 6).alias("theme_purity"), "edge_count")


def walks_to(g: PropertyGraph, shock: str, rels: list[str], kind: str, most: int = 4, directed: bool = True) -> DataFrame:
    """(id, walks) of the nodes of a kind: the number of walks of up to `most` edges from a shock."""
    rows = many.walk_counts(g, shock, most, rels, directed).groupBy("id").agg(F.sum("walks").cast("decimal(38,0)").alias("walks"))
    return rows.join(g.of_type(kind).select("id"), "id", "left_semi")
