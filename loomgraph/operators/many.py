"""Paths for many questions at once: hops and paths of a table of pairs, the best trails between two nodes, numbers of walks.

The search is bit-parallel: each node on the frontier carries a word of bits for every 63 roots, so one pass over the edges goes
on for all of them. No path is carried along; those that are asked for are made afterwards, from the levels that lead to a goal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators import paths
from loomgraph.storage import cut, numbered, small_or_not

#: Roots of a word; its sign bit stays free.
WORD = 63


#: Relations that together have no more than this share of the edges are looked at first at the last level.
FIRST_SHARE = 0.2
#: Rows of ids with a word of bits, or with the few ids of a path, that may be broadcast after they have been counted.
NARROW = 400_000
#: A level is sifted for what leads to a goal where it holds so many times the roots that goals beyond it have.
SIFTED = 10


def _steps(g: PropertyGraph, rels: list[str] | None, directed: bool, back: bool = False) -> DataFrame:
    """The (src, dst, rel) that a search may go along, as the graph has them stored; back: against the edges."""
    edges = g.with_rel(*(rels or [])) if directed else g.adjacency(*(rels or []))
    src, dst = ("dst", "src") if back and directed else ("src", "dst")
    return edges.filter("src <> dst").select(F.col(src).alias("src"), F.col(dst).alias("dst"), "rel")


def _by_size(steps: DataFrame) -> list[DataFrame]:
    """steps in two parts, small relations first."""
    counts = sorted((r["n"], r["rel"] or "") for r in steps.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).collect())  # an ontology's relations
    first, room = [], FIRST_SHARE * sum(n for n, _ in counts)
    for n, rel in counts:
        room -= n
        if room >= 0:
            first.append(rel)
    of = F.coalesce("rel", F.lit("")).isin(*first)
    return [steps.filter(of), steps.filter(~of)] if first else [steps]


def _known(g: PropertyGraph, pairs: DataFrame, column: str) -> DataFrame:
    """The pairs whose column is a node of the graph."""
    known = pairs.select(column).distinct().join(g.nodes.select(F.col("id").alias(column)), column, "left_semi").distinct()
    return cut(pairs.join(small_or_not(cut(known)), column))


def _search(steps: DataFrame, pairs: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(root, goal, hops, word, bit) for the pairs (root, goal) within reach, and for each level but the last the nodes with the roots
    that reach them there first (node, word, new). Ends when all goals are found or nothing new is reached.

    Edges are read from where they are stored at each level, past few nodes without a shuffle. At the last level only goals count:
    few of them are broadcast, and large relations are left out where the small ones have led to all."""
    roots = numbered(pairs.select("root").distinct(), ["root"], "number")
    roots = roots.select("root", F.expr(f"number div {WORD}").alias("word"), F.expr(f"shiftleft(1L, cast(number % {WORD} as int))").alias("bit"))
    open_ = cut(pairs.join(small_or_not(roots), "root"))
    start = F.bit_or("bit")
    state = cut(roots.groupBy(F.col("root").alias("node"), "word").agg(start.alias("seen"), start.alias("new")))
    found, levels = [], []

    def met(reached: DataFrame, level: int) -> None:
        """Takes the open pairs whose goal is reached here among those found."""
        nonlocal open_
        here = open_.join(reached.withColumnRenamed("node", "goal"), ["goal", "word"]).filter(F.col("bit").bitwiseAND(F.col("new")) != 0)
        here = cut(here.select("root", "goal", F.lit(level).alias("hops"), "word", "bit"))
        found.append(here)
        open_ = cut(open_.join(here.select("root", "goal"), ["root", "goal"], "left_anti"))

    def onward(reached: DataFrame, along: DataFrame) -> DataFrame:
        return small_or_not(reached).join(along, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("new").alias("got"))

    for level in range(most + 1):
        reached = state.filter("new <> 0").select("node", "word", "new")
        if level and not reached.limit(1).count():
            break
        levels.append(reached)
        met(reached, level)
        if level == most or not open_.limit(1).count():
            break
        if level == most - 1:
            few = small_or_not(reached) is not reached
            for along in [steps] if few else _by_size(steps):
                goals = open_.select(F.col("goal").alias("dst")).distinct()
                ends = small_or_not(goals)
                met(onward(reached, along if ends is goals else along.join(ends, "dst", "left_semi")).withColumnRenamed("got", "new"), most)
                if not open_.limit(1).count():
                    break
            break
        got = onward(reached, steps).select("node", "word", F.lit(0).cast("long").alias("seen"), "got")
        both = state.select("node", "word", "seen", F.lit(0).cast("long").alias("got")).unionByName(got).groupBy("node", "word").agg(F.bit_or("seen").alias("was"), F.bit_or("got").alias("got"))
        state = cut(both.select("node", "word", F.col("was").bitwiseOR(F.col("got")).alias("seen"), F.col("got").bitwiseAND(F.bitwise_not("was")).alias("new")))
    return union_all(found), levels


def hops(g: PropertyGraph, asked: DataFrame, most: int = 12, rels: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(source, target, hops) for each distinct pair of asked (source, target) that lies within `most` hops; a node is 0 hops from
    itself. Pairs with nulls or with ids that the graph lacks have no row.

    The level's edges are joined once for all sources; a node has a row for every 63 sources, whatever the number of paths. The search
    goes out from the sources or against the edges from the targets, whichever are fewer.
    """
    root, goal = "source", "target"
    pairs = _known(g, asked.select(root, goal).dropna().distinct(), root)
    sides = pairs.agg(F.count_distinct(root).alias("sources"), F.count_distinct(goal).alias("targets")).first()
    back = sides["targets"] < sides["sources"]
    if back:
        root, goal = goal, root
    found, _ = _search(_steps(g, rels, directed, back), pairs.select(F.col(root).alias("root"), F.col(goal).alias("goal")), most)
    return found.select(F.col("goal" if back else "root").alias("source"), F.col("root" if back else "goal").alias("target"), "hops")


def _narrow(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has NARROW rows at most."""
    return small_or_not(df, NARROW)


def _bits_of(bits: str) -> Column:
    """The bits of a word as an array of words with one bit each; most words that are asked for hold one."""
    one = F.col(bits).bitwiseAND(F.col(bits) - 1) == 0
    return F.when(one, F.array(bits)).otherwise(F.filter(F.array(*[F.lit(1 << i) for i in range(WORD)]), lambda b: b.bitwiseAND(F.col(bits)) != 0))


def _needed(steps: DataFrame, found: DataFrame, levels: list[DataFrame], last: int) -> list[DataFrame]:
    """For each level 0 to `last` the nodes with the roots (node, word, need) whose shortest paths to a goal may lead over them there.
    A level is sifted only where it holds many more roots than there are goals beyond it."""
    out: list[DataFrame] = []
    for level in range(last, -1, -1):
        need = found.filter(F.col("hops") == level).groupBy(F.col("goal").alias("node"), "word").agg(F.bit_or("bit").alias("need"))
        if level < last:
            layer = levels[level]
            beyond = found.filter(F.col("hops") > level).count()
            held = layer.agg(F.sum(F.bit_count("new"))).first()[0] or 0
            if held > SIFTED * beyond:
                onto = steps.join(_narrow(out[0]), F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("need").alias("need"))
                onto = layer.join(onto, ["node", "word"]).select("node", "word", F.col("need").bitwiseAND(F.col("new")).alias("need")).filter("need <> 0")
            else:
                onto = layer.select("node", "word", F.col("new").alias("need"))
            need = need.unionByName(onto).groupBy("node", "word").agg(F.bit_or("need").alias("need"))
        out.insert(0, cut(need))
    return out


def shortest(g: PropertyGraph, asked: DataFrame, most: int = 12, rels: list[str] | None = None, directed: bool = False) -> DataFrame:
    """hops() with path_nodes, path_rels and path_facts: of the shortest paths the least by node ids, as paths.distances has it.

    The search goes out from the side with fewer nodes. Then the nodes that lie on a shortest path to a goal get their least path
    from or to each root, level by level: the least of their neighbours' on the level before."""
    root, goal = "source", "target"
    pairs = _known(g, asked.select(root, goal).dropna().distinct(), root)
    sides = pairs.agg(F.count_distinct(root).alias("sources"), F.count_distinct(goal).alias("targets")).first()
    back = sides["targets"] < sides["sources"]
    if back:
        root, goal = goal, root
    steps = _steps(g, rels, directed, back)
    found, levels = _search(steps, pairs.select(F.col(root).alias("root"), F.col(goal).alias("goal")), most)
    found = cut(found)
    steps = steps.select("src", "dst")
    last = found.agg(F.max("hops")).first()[0] or 0
    needs = _needed(steps, found, levels, last)
    at = cut(found.select(F.col("root").alias("node"), "word", "bit", F.array("root").alias("path")).distinct())
    told = [at]
    for level in range(1, last + 1):
        ways = steps.join(_narrow(needs[level - 1].select(F.col("node").alias("src"), F.col("word").alias("_word"), F.col("need").alias("_from"))), "src")
        ways = ways.join(_narrow(needs[level].select(F.col("node").alias("dst"), "word", "need")), "dst").filter(F.col("word") == F.col("_word"))
        ways = ways.withColumn("_both", F.col("_from").bitwiseAND(F.col("need"))).filter("_both <> 0").select("src", "dst", "word", F.explode(_bits_of("_both")).alias("bit"))
        before = ways.join(_narrow(at.withColumnRenamed("node", "src")), ["src", "word", "bit"]).groupBy("dst", "word", "bit").agg(F.min("path").alias("path"))
        whole = F.concat(F.array("dst"), "path") if back else F.concat("path", F.array("dst"))
        at = cut(before.select(F.col("dst").alias("node"), "word", "bit", whole.alias("path")))
        told.append(at)
    at = union_all([rows.withColumn("hops", F.lit(k)) for k, rows in enumerate(told)]).withColumnRenamed("node", "goal")
    out = cut(at.join(_narrow(found), ["goal", "word", "bit", "hops"]).select(F.col("goal" if back else "root").alias("source"), F.col("root" if back else "goal").alias("target"), "hops", F.col("path").alias("path_nodes")))
    legs = out.filter("hops > 0").select("source", "target", "path_nodes", F.explode(F.sequence(F.lit(1), "hops")).alias("step"))
    legs = legs.select("source", "target", "step", F.get("path_nodes", F.col("step") - 1).alias("node"), F.get("path_nodes", "step").alias("next"))
    edges = (g.with_rel(*(rels or [])) if directed else g.adjacency(*(rels or []))).select(F.col("src").alias("node"), F.col("dst").alias("next"), "rel", "fact")
    said = cut(edges.join(_narrow(legs.select("node", "next").distinct()), ["node", "next"]).groupBy("node", "next").agg(F.min(F.struct("rel", "fact")).alias("said")))
    legs = legs.join(_narrow(said), ["node", "next"]).groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("step", "said"))).alias("_legs"))  # most at most
    legs_of = lambda k: F.coalesce(F.transform("_legs", lambda x: x["said"][k]), F.array().cast("array<string>"))
    return out.join(legs, ["source", "target"], "left").select("source", "target", "hops", "path_nodes", legs_of("rel").alias("path_rels"), legs_of("fact").alias("path_facts"))


def exposures(g: PropertyGraph, asked: DataFrame, most: int = 12) -> DataFrame:
    """asked (a, b, shock and any other columns) with hops_a and hops_b to the shock, null where there is no path: one search from
    all shocks."""
    both = asked.select(F.col("shock").alias("source"), F.col("a").alias("target")).unionByName(asked.select(F.col("shock").alias("source"), F.col("b").alias("target")))
    far = cut(hops(g, both, most))
    for who in ("a", "b"):
        asked = asked.join(small_or_not(far.select(F.col("source").alias("shock"), F.col("target").alias(who), F.col("hops").alias(f"hops_{who}"))), ["shock", who], "left")
    return asked


def compare_exposures(g: PropertyGraph, asked: DataFrame, how: str = "more", most: int = 12) -> DataFrame:
    """paths.compare_exposure for a table of questions (a, b, shock)."""
    rows = exposures(g, asked, most)
    if how == "approx":
        return rows.filter(F.abs(F.col("hops_a") - F.col("hops_b")) <= 1)
    nearer = F.col("hops_a") < F.col("hops_b") if how == "more" else F.col("hops_a") > F.col("hops_b")
    return rows.withColumn(f"{how}_exposed", F.when(nearer, F.col("a")).otherwise(F.col("b")))


def compare_pairs(g: PropertyGraph, asked: DataFrame, most: int = 8, approx: bool = False) -> DataFrame:
    """paths.compare_pair for a table of questions (a, b): the hops between them; with approx only if they are two at most. A node
    and itself have no row."""
    pairs = asked.select(F.col("a").alias("source"), F.col("b").alias("target")).filter("source <> target")
    rows = hops(g, pairs, most)
    return (rows.filter("hops <= 2") if approx else rows).select(F.col("source").alias("a"), F.col("target").alias("b"), "hops")


def best_trails(g: PropertyGraph, source: str, target: str, k: int = 10, rels: list[str] | None = None, most: int = 10) -> DataFrame:
    """(id, hops, path_nodes, path_rels, path_edges): the k shortest directed trails of 1 to `most` edges between two nodes, no edge
    twice, of equal length those of the least edges. Exact, without enumerating what isn't among them.

    The reverse search tells how far each node is from the target, so for a bound on the length only beginnings that can still keep
    to it go on; the bound grows until k trails keep to it. Of the beginnings that end at one node, and whose edges that a rest
    could still use are the same, only the k least go on: whatever completes one completes the others.
    """
    edges = cut(g.with_rel(*(rels or [])).select("edge_id", "src", "dst", "rel"))
    turned = PropertyGraph(g.nodes, edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", F.lit(None).cast("string").alias("fact")))
    away = cut(paths.hop_counts(turned, target, most, directed=True).select(F.col("id").alias("dst"), F.col("hops").alias("_left")))
    edges = cut(edges.join(away, "dst"))  # what leads on to the target
    start = g.nodes.filter(F.col("id") == source).select(F.col("id").alias("at"), F.array("id").alias("path_nodes"), F.array().cast("array<string>").alias("path_rels"), F.array().cast("array<struct<edge:bigint,left:int>>").alias("_path"))
    first = away.filter(F.col("dst") == source).first()
    out = None
    for bound in range(max(first["_left"], 1), most + 1) if first else ():
        frontier, hits = start, []
        for level in range(1, bound + 1):
            step = frontier.join(edges, frontier["at"] == edges["src"]).filter(F.col("_left") + level <= bound).filter(~F.exists("_path", lambda p: p["edge"] == F.col("edge_id")))
            step = step.select(F.col("dst").alias("at"), F.concat("path_nodes", F.array("dst")).alias("path_nodes"), F.concat("path_rels", F.array("rel")).alias("path_rels"), F.concat("_path", F.array(F.struct(F.col("edge_id").alias("edge"), F.col("_left").alias("left")))).alias("_path"))
            step = step.withColumn("path_edges", F.transform("_path", lambda p: p["edge"]))
            usable = F.array_sort(F.transform(F.filter("_path", lambda p: p["left"] + 1 <= bound - level), lambda p: p["edge"]))  # noqa: B023
            best = step.withColumn("_k", F.row_number().over(Window.partitionBy("at", usable).orderBy("path_edges"))).filter(F.col("_k") <= k)
            frontier = cut(best.drop("_k"))
            hits.append(frontier.filter(F.col("at") == target).withColumn("hops", F.lit(level)))
            if not frontier.limit(1).count():
                break
        out = cut(union_all(hits).select(F.col("at").alias("id"), "hops", "path_nodes", "path_rels", "path_edges").orderBy("hops", "path_edges").limit(k))
        if out.count() >= k:
            break
    if out is None:
        out = start.select(F.col("at").alias("id"), F.lit(0).alias("hops"), "path_nodes", "path_rels", F.transform("_path", lambda p: p["edge"]).alias("path_edges")).limit(0)
    return out


def walk_counts(g: PropertyGraph, source: str, most: int = 4, rels: list[str] | None = None, directed: bool = True) -> DataFrame:
    """(id, hops, walks): the number of walks of each length 1 to `most` from a node, as whole numbers of 38 digits. A walk may use
    an edge again, so where the relations have no cycle it is the number of trails. Numbers are summed along edges, level by level;
    no walk is written down."""
    edges = (g.with_rel(*(rels or [])) if directed else g.adjacency(*(rels or []))).select("src", "dst")
    at = g.nodes.filter(F.col("id") == source).select("id", F.lit(1).cast("decimal(38,0)").alias("walks"))
    out = []
    for level in range(1, most + 1):
        at = cut(edges.join(small_or_not(at), F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum("walks").cast("decimal(38,0)").alias("walks")))
        out.append(at.select("id", F.lit(level).alias("hops"), "walks"))
    return union_all(out)
