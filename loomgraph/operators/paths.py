"""Paths: breadth-first search, trails, reachability and the edges between two nodes.

Each level joins the frontier with the adjacency and drops what is known, so a level costs one join whatever the number of
paths; lineage is cut by a checkpoint every few levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.storage import BROADCAST_ROWS, cut, small_or_not

#: Levels between checkpoints.
CUT_EVERY = 3


def distances(g: PropertyGraph, source: str, most: int = 12, rels: list[str] | None = None, target: str | None = None, directed: bool = False) -> DataFrame:
    """(id, hops, path_nodes, path_rels, path_facts) for each node within `most` hops of source: one shortest path each, the
    least by its node ids. Ends early when the target is found."""
    edges = (g.with_rel(*(rels or [])) if directed else g.adjacency(*(rels or []))).select("src", "dst", "rel", "fact")
    empty = F.array().cast("array<string>")
    reached = g.nodes.filter(F.col("id") == source).select("id", F.lit(0).alias("hops"), F.array("id").alias("path_nodes"), empty.alias("path_rels"), empty.alias("path_facts"))
    frontier = reached
    for level in range(1, most + 1):
        steps = frontier.withColumnRenamed("id", "src").join(edges, "src")
        path = F.struct(F.concat("path_nodes", F.array("dst")).alias("n"), F.concat("path_rels", F.array("rel")).alias("r"), F.concat("path_facts", F.array("fact")).alias("f"))
        found = steps.groupBy(F.col("dst").alias("id")).agg(F.min(path).alias("p")).join(reached.select("id"), "id", "left_anti")
        frontier = found.select("id", F.lit(level).alias("hops"), F.col("p.n").alias("path_nodes"), F.col("p.r").alias("path_rels"), F.col("p.f").alias("path_facts"))
        frontier = cut(frontier)
        if not frontier.limit(1).count():
            break
        reached = reached.unionByName(frontier)
        if level % CUT_EVERY == 0:
            reached = cut(reached)
        if target is not None and frontier.filter(F.col("id") == target).limit(1).count():
            break
    return reached


def _known_ids(g: PropertyGraph, rels: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(id): the nodes, and the ends of edges that the nodes lack. Stored edges lie in the order of these ends, so few rows are made."""
    ends = (g.edges if g.reverse is None else g.reverse).select("rel", F.col("dst").alias("id")) if directed else g.adjacency().select("rel", F.col("src").alias("id"))
    ends = (ends.filter(F.col("rel").isin(*rels)) if rels else ends).select("id")
    return g.nodes.select("id").unionByName(ends).filter("id IS NOT NULL").distinct()


def hop_counts(g: PropertyGraph, source: str, most: int = 12, rels: list[str] | None = None, target: str | None = None, directed: bool = False) -> DataFrame:
    """distances() without the paths. Ends early when the target is found or no node is left.

    A level costs a scan of the edges where the nodes reached last, or else those not yet reached, are few enough to be broadcast; only
    a level with many of both shuffles the edges, and of these no more than their ends."""
    edges = (g.with_rel(*(rels or [])) if directed else g.adjacency(*(rels or []))).select("src", "dst")
    frontier = cut(g.nodes.filter(F.col("id") == source).select("id").distinct())
    reached = frontier.withColumn("hops", F.lit(0))
    left = cut(_known_ids(g, rels, directed).join(F.broadcast(frontier), "id", "left_anti"))
    for level in range(1, most + 1):
        if not frontier.limit(1).count() or target is not None and frontier.filter(F.col("id") == target).limit(1).count():
            break
        few = small_or_not(frontier)
        if few is frontier and left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            into = edges.join(F.broadcast(left.withColumnRenamed("id", "dst")), "dst", "left_semi").distinct()
            found = into.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        else:
            found = edges.join(few.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(left, "id", "left_semi")
        frontier = cut(found)
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(level)))
        left = left.join(small_or_not(frontier), "id", "left_anti")
        left = cut(left)
        if level % CUT_EVERY == 0:
            reached = cut(reached)
        if not left.limit(1).count():
            break
    return reached


def _with_path(g: PropertyGraph, reached: DataFrame, source: str, target: str, rels: list[str] | None = None) -> DataFrame:
    """(id, hops, path_nodes, path_rels, path_facts) of the target, from hop_counts() of the source: of the shortest paths the least by
    its node ids, each of its legs by the least relation and fact. Only the nodes of some shortest path to the target are looked at:
    they are found backwards, level by level, and then the least ones are taken forwards."""
    found = reached.filter(F.col("id") == target).first()
    hops = found["hops"] if found else None
    empty = F.array().cast("array<string>")
    start = g.nodes.filter(F.col("id") == source).select("id").distinct()
    if not hops:
        rows = start.select("id", F.lit(0).alias("hops"), F.array("id").alias("path_nodes"), empty.alias("path_rels"), empty.alias("path_facts"))
        return rows if hops == 0 else rows.limit(0)
    edges = g.adjacency(*(rels or []))
    ends = edges.select("src", "dst")
    layers = {hops: cut(reached.filter(F.col("id") == target).select("id"))}
    for level in range(hops - 1, 0, -1):
        near = ends.join(small_or_not(layers[level + 1]).withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        layers[level] = cut(near.join(reached.filter(F.col("hops") == level).select("id"), "id", "left_semi"))
    nodes, said = [source], []
    for level in range(1, hops + 1):
        on = edges.filter(F.col("src") == nodes[-1]).join(layers[level].withColumnRenamed("id", "dst"), "dst", "left_semi")
        leg = on.agg(F.min(F.struct("dst", "rel", "fact")).alias("m")).first()["m"]
        nodes.append(leg["dst"])
        said.append((leg["rel"], leg["fact"]))
    texts = lambda some: F.array(*[F.lit(x).cast("string") for x in some])
    return start.select(F.lit(target).alias("id"), F.lit(hops).alias("hops"), texts(nodes).alias("path_nodes"), texts([r for r, _ in said]).alias("path_rels"), texts([f for _, f in said]).alias("path_facts"))


def shortest_path(g: PropertyGraph, source: str, target: str, most: int = 12, rels: list[str] | None = None) -> DataFrame:
    """The row of the target, or none if it is further away."""
    return _with_path(g, cut(hop_counts(g, source, most, rels, target)), source, target, rels).filter("hops > 0")


def exposure(g: PropertyGraph, a: str, b: str, shock: str, most: int = 12) -> DataFrame:
    """Hops from two nodes to a shock, with the facts on the way; null where there is no path. One search from the shock."""
    far = cut(hop_counts(g, shock, most))
    from_shock = union_all([_with_path(g, far, shock, who) for who in dict.fromkeys((a, b))])
    pick = lambda who, c: F.max(F.when(F.col("id") == who, F.col(c)))
    return from_shock.agg(pick(a, "hops").alias("hops_a"), pick(b, "hops").alias("hops_b"), pick(a, "path_facts").alias("facts_a"), pick(b, "path_facts").alias("facts_b"))


def compare_exposure(g: PropertyGraph, a: str, b: str, shock: str, how: str = "more", most: int = 12) -> DataFrame:
    """more: the nearer one is the more exposed; less: the farther one; approx: only if hops differ by one at most."""
    rows = exposure(g, a, b, shock, most)
    if how == "approx":
        return rows.filter(F.abs(F.col("hops_a") - F.col("hops_b")) <= 1)
    nearer: Column = F.col("hops_a") < F.col("hops_b") if how == "more" else F.col("hops_a") > F.col("hops_b")
    return rows.withColumn("more_exposed" if how == "more" else "less_exposed", F.when(nearer, F.lit(a)).otherwise(F.lit(b)))


def compare_pair(g: PropertyGraph, a: str, b: str, most: int = 8, approx: bool = False) -> DataFrame:
    """Hops between two nodes; with approx only if they are two at most."""
    rows = shortest_path(g, a, b, most).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "hops", "path_nodes")
    return rows.filter("hops <= 2") if approx else rows


def trails(g: PropertyGraph, source: str, target: str | None, rels: list[str] | None = None, most: int = 10, limit: int | None = 10) -> DataFrame:
    """Directed trails of 1 to `most` edges, no edge twice, shortest first; ends once `limit` are found. With a target, a trail
    only goes on where the target is still within reach."""
    edges = g.with_rel(*(rels or [])).select("edge_id", "src", "dst", "rel")
    left = None
    if target is not None:
        turned = PropertyGraph(g.nodes, g.with_rel(*(rels or [])).select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", F.lit(None).cast("string").alias("fact")))
        left = hop_counts(turned, target, most, directed=True).select(F.col("id").alias("dst"), F.col("hops").alias("_left"))
    frontier = g.nodes.filter(F.col("id") == source).select(F.col("id").alias("at"), F.array("id").alias("path_nodes"), F.array().cast("array<bigint>").alias("path_edges"), F.array().cast("array<string>").alias("path_rels"))
    out = None
    for level in range(1, most + 1):
        steps = frontier.join(edges, frontier["at"] == edges["src"]).filter(~F.array_contains("path_edges", F.col("edge_id")))
        steps = steps if left is None else steps.join(left, "dst").filter(F.col("_left") + level <= most)
        longer = steps.select(
            F.col("dst").alias("at"), F.concat("path_nodes", F.array("dst")).alias("path_nodes"), F.concat("path_edges", F.array("edge_id")).alias("path_edges"), F.concat("path_rels", F.array("rel")).alias("path_rels")
        )
        # Without a target every beginning is itself a trail, so the first ones of a level are all that it can give.
        frontier = cut(longer if target is not None or limit is None else longer.orderBy("path_edges").limit(limit))
        hits = (frontier if target is None else frontier.filter(F.col("at") == target)).withColumn("hops", F.lit(level))
        out = hits if out is None else out.unionByName(hits)
        if not frontier.limit(1).count() or limit is not None and out.limit(limit).count() >= limit:
            break
    rows = out.select(F.col("at").alias("id"), "hops", "path_nodes", "path_rels", "path_edges")
    return rows if limit is None else rows.orderBy("hops", "path_edges").limit(limit)


def reachable(g: PropertyGraph, source: str, most: int = 6, kind: str | None = None, rels: list[str] | None = None, limit: int | None = 20) -> DataFrame:
    """Nodes within `most` hops, each once, nearest first."""
    rows = hop_counts(g, source, most, rels).filter("hops > 0").join(g.of_type(kind).select("id", "name") if kind else g.nodes.select("id", "name"), "id").select("id", "name", "hops")
    return rows if limit is None else rows.orderBy("hops", "id").limit(limit)


def edges_between(g: PropertyGraph, source: str, target: str, most: int = 12) -> DataFrame:
    """Edges that lie on a walk of at most `most` edges between two nodes, from the two distances. Where few nodes are so far from
    either that it depends on the other distance, only their edges are joined with the distances."""
    near, far = (cut(hop_counts(g, end, most)) for end in (source, target))
    last = [d.agg(F.max("hops")).first()[0] for d in (near, far)]
    if None in last:
        return g.edges.select("edge_id").limit(0)
    exact = lambda adjacent: (
        adjacent.join(near.select(F.col("id").alias("src"), F.col("hops").alias("_a")), "src").join(far.select(F.col("id").alias("dst"), F.col("hops").alias("_b")), "dst")
        .filter(F.col("_a") + 1 + F.col("_b") <= most).select("edge_id")
    )
    ids = cut(_known_ids(g))
    unsure = [cut(ids.join(d.filter(F.col("hops") + 1 + other <= most).select("id"), "id", "left_anti")) for d, other in ((near, last[1]), (far, last[0]))]
    if any(u.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS for u in unsure):
        return exact(g.adjacency().select("edge_id", "src", "dst")).distinct()
    rows = g.edges.select("edge_id", "src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    for k, u in enumerate(unsure):
        for end in ("src", "dst"):
            rows = rows.join(F.broadcast(u.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}{k}"))), end, "left")
    sure = (F.col("_src0").isNull() & F.col("_dst1").isNull()) | (F.col("_dst0").isNull() & F.col("_src1").isNull())
    rest = rows.filter(~sure).select("edge_id", "src", "dst")
    both = rest.unionByName(rest.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return rows.filter(sure).select("edge_id").unionByName(exact(both)).distinct()


def rendered(nodes: Column, rels: Column) -> Column:
    """A -[REL]-> B -[REL]-> C"""
    steps = F.zip_with(rels, F.slice(nodes, F.lit(2), F.size(rels)), lambda r, n: F.concat(F.lit(" -["), r, F.lit("]-> "), n))
    return F.concat(F.get(nodes, F.lit(0)), F.array_join(steps, ""))
