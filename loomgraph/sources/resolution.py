"""Entity resolution of extracted facts: names that mean one thing become one node, and later facts end those that they contradict.

Names are compared where they may be alike at all: they are joined on the rarest of their three-letter runs, as many as two alike
names can't both lack, and on their initials. Links are closed to groups, and a group's most used name stands for it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators.components import components
from loomgraph.storage import cut, small_or_not
from loomgraph.streaming.updates import superseded

#: Share of three-letter runs in common from which names are alike.
ALIKE = 0.7
#: Words that say what kind of company a name is, and add nothing to it.
LEGAL_FORMS = ["limited", "ltd", "inc", "incorporated", "corp", "corporation", "company", "co", "plc", "llc", "gmbh", "ag", "pvt", "private", "the"]
#: Words that initials leave out.
SMALL_WORDS = ["of", "and", "for", "in"]


def plain_name(name: Column) -> Column:
    """A name without case, punctuation and legal forms; its words alone if nothing else is left."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def runs(name: Column) -> Column:
    """The distinct three-letter runs of a name between blanks."""
    line = F.concat(F.lit(" "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(line) - 2, F.lit(1))), lambda i: F.substring(line, i, F.lit(3))))


def initials(name: Column) -> Column:
    """The first letters of a plain name of three words or more, without small ones; null for shorter names."""
    words = F.filter(F.split(name, " "), lambda w: ~w.isin(*SMALL_WORDS))
    return F.when(F.size(words) >= 3, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def alike(names: DataFrame, share: float = ALIKE) -> DataFrame:
    """(a, b) for the pairs of distinct plain names (plain), a < b, whose runs are alike: in common at least `share` of those that either
    has. Exact: names of x runs are joined on their x - ceil(share * x) + 1 rarest ones, and two alike names share one of these."""
    sets = cut(names.select("plain").filter("plain <> ''").distinct().withColumn("_runs", runs(F.col("plain"))))
    each = sets.select("plain", F.explode("_runs").alias("run"))
    often = each.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    ordered = each.join(small_or_not(often), "run").groupBy("plain").agg(F.array_sort(F.collect_list(F.struct("_n", "run"))).alias("_o"))  # a name's runs
    size = F.size("_o")
    keys = ordered.select("plain", size.alias("_size"), F.explode(F.slice("_o", F.lit(1), (size - F.ceil(F.lit(share) * size - 1e-9) + 1).cast("int"))).alias("_k"))
    keys = cut(keys.select("plain", "_size", F.col("_k.run").alias("run")))
    other = keys.select(F.col("plain").alias("b"), F.col("_size").alias("_b"), "run")
    near = keys.select(F.col("plain").alias("a"), F.col("_size").alias("_a"), "run").join(other, "run").filter("a < b")
    near = near.filter((F.col("_a") >= share * F.col("_b") - 1e-9) & (F.col("_b") >= share * F.col("_a") - 1e-9)).select("a", "b").distinct()
    pairs = near.join(sets.select(F.col("plain").alias("a"), F.col("_runs").alias("_x")), "a").join(sets.select(F.col("plain").alias("b"), F.col("_runs").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return pairs.filter(common >= share * (F.size("_x") + F.size("_y") - common) - 1e-9).select("a", "b")


def abbreviated(names: DataFrame) -> DataFrame:
    """(a, b): plain names that are the initials of others, all of one group (plain, group), with one of these."""
    long = names.select("group", F.col("plain").alias("b"), initials(F.col("plain")).alias("a")).filter("a IS NOT NULL")
    only = long.groupBy("a").agg(F.min("group").alias("_least"), F.max("group").alias("_most"), F.min("b").alias("b")).filter("_least = _most")
    return names.select(F.col("plain").alias("a")).join(only.select("a", "b"), "a")


def resolved(names: DataFrame, share: float = ALIKE) -> DataFrame:
    """(name, canonical) for each distinct name of names (name, a row for each use): canonical is the most used name of its group,
    of those the longest, then the first. A group is closed under: the same plain name, plain names that are alike, and initials that
    are those of names of one group only. Null and blank names have no row."""
    used = cut(names.filter(F.trim("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("uses")).withColumn("plain", plain_name(F.col("name"))))
    links = cut(alike(used, share))
    grouped = used.filter("plain <> ''").select("plain").distinct().join(components(links).withColumnRenamed("id", "plain"), "plain", "left")
    links = cut(links.unionByName(abbreviated(cut(grouped.select("plain", F.coalesce("component", "plain").alias("group"))))))
    groups = components(links).select(F.col("id").alias("plain"), "component")
    # A name of punctuation alone has no plain form and is a group of its own.
    rows = used.join(groups, "plain", "left").withColumn("group", F.when(F.col("plain") == "", F.concat(F.lit("\0"), "name")).otherwise(F.coalesce("component", "plain")))
    best = rows.groupBy("group").agg(F.min(F.struct(-F.col("uses"), -F.length("name"), F.col("name").alias("name"))).alias("_b")).select("group", F.col("_b.name").alias("canonical"))
    return rows.join(best, "group").select("name", "canonical")


def resolved_graph(facts: DataFrame, one_at_a_time: Iterable[str] = (), share: float = ALIKE) -> tuple[PropertyGraph, DataFrame]:
    """The graph of facts (subject, rel, object, fact, valid_at) with one node for each resolved entity, and the names' table.

    An edge is one for each subject, relation, object and valid_at; of several texts the first stays. For relations in
    one_at_a_time a subject has one object at a time: a later fact with another object ends the one before (invalid_at), and a fact
    that repeats its forerunner's object goes on with it. Facts without a subject, object or relation are left out. Ids are hashes
    of the canonical names, so the same facts again give the same graph.
    """
    facts = facts.filter((F.trim("subject") != "") & (F.trim("object") != "") & F.col("rel").isNotNull())
    names = cut(resolved(facts.select(F.explode(F.array("subject", "object")).alias("name")), share))
    key = lambda name: F.concat(F.lit("N"), F.substring(F.sha2(name, 256), 1, 24))
    rows = facts
    for who in ("subject", "object"):
        rows = rows.join(small_or_not(names.select(F.col("name").alias(who), key(F.col("canonical")).alias(f"_{who}"))), who)
    edges = rows.groupBy(F.col("_subject").alias("src"), "rel", F.col("_object").alias("dst"), "valid_at").agg(F.min("fact").alias("fact"))
    edges = cut(edges.withColumn("edge_id", F.xxhash64("src", "rel", "dst", "valid_at")))
    single = edges.filter(F.col("rel").isin(*one_at_a_time)) if one_at_a_time else edges.limit(0)
    ends = superseded(_changes(single), ["src", "rel"], "valid_at", "dst").select("edge_id", "invalid_at")
    nodes = names.select(key(F.col("canonical")).alias("id"), F.col("canonical").alias("name"), F.lit("ENTITY").alias("type")).distinct()
    return PropertyGraph.of(nodes, edges.join(ends, "edge_id", "left")), names


def _changes(edges: DataFrame) -> DataFrame:
    """Of facts that follow each other with one object, the first: the others change nothing."""
    from pyspark.sql import Window

    order = Window.partitionBy("src", "rel").orderBy("valid_at", "dst")
    before = F.lag("dst").over(order)
    return edges.withColumn("_same", F.coalesce(before == F.col("dst"), F.lit(False))).filter("NOT _same").drop("_same")
