"""Checks of a graph against its contract, and evaluation of answers against what was retrieved."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.expressions import extract_numbers, growth_amount, real_gap, screaming_snake, six_digits
from loomgraph.graph import PropertyGraph


def canonical(rel: Column) -> Column:
    return F.upper(F.coalesce(screaming_snake(rel), rel))


def contract(g: PropertyGraph, known: list[str] | None = None) -> DataFrame:
    """(metric, value): edges, relations, the share of edges of unknown relations, and what lacks names, facts or types."""
    unmapped = F.count_if(~F.col("rel").isin(*known)) if known else F.lit(0).cast("long")
    e = g.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("rel").alias("relations"), unmapped.alias("unmapped_edges"), F.count_if(F.col("fact").isNull()).alias("edges_without_fact"))
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("name").isNull() | (F.col("name") == "")).alias("nodes_without_name"), F.count_if(F.col("type").isNull()).alias("nodes_without_type"))
    return e.unpivot([], e.columns, "metric", "value").unionByName(n.unpivot([], n.columns, "metric", "value"))


def relation_counts(g: PropertyGraph) -> DataFrame:
    n = g.edges.groupBy("rel").agg(F.count(F.lit(1)).alias("edges"))
    return n.withColumn("share", F.round(F.col("edges") / F.sum("edges").over(Window.partitionBy()), 6))


def casing_drift(rels: DataFrame, rel: str = "rel") -> DataFrame:
    """Spellings that are one relation: (canonical, spellings, edges), where there are several."""
    return rels.groupBy(canonical(F.col(rel)).alias("canonical")).agg(F.array_sort(F.collect_set(rel)).alias("spellings"), F.count(F.lit(1)).alias("edges")).filter(F.size("spellings") > 1)


def preferred_casing(rels: DataFrame, rel: str = "rel") -> DataFrame:
    """(rel, canonical, preferred): of each relation's spellings a PascalCase one, then the most frequent, then the first."""
    n = rels.groupBy(rel).agg(F.count(F.lit(1)).alias("edges")).withColumn("canonical", canonical(F.col(rel)))
    best = Window.partitionBy("canonical").orderBy(F.col(rel).rlike("[a-z]").desc(), F.col("edges").desc(), rel)
    return n.select(rel, "canonical", F.first(rel).over(best).alias("preferred"))


def conformance(g: PropertyGraph, edge_types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges that break the ontology, with the reason. edge_types(rel); allowed(src_type, dst_type, rel), in which the pair
    (Entity, Entity) stands for any."""
    types = lambda key, out: g.nodes.select(F.col("id").alias(key), F.col("type").alias(out))
    rows = g.edges.select("edge_id", "src", "dst", "rel").join(types("src", "src_type"), "src").join(types("dst", "dst_type"), "dst")
    known = edge_types.select("rel").distinct().withColumn("_known", F.lit(True))
    pairs = allowed.filter("src_type <> 'Entity'").distinct().withColumn("_pair", F.lit(True))
    wild = allowed.filter("src_type = 'Entity' AND dst_type = 'Entity'").select("rel").distinct().withColumn("_wild", F.lit(True))
    rows = rows.join(known, "rel", "left").join(pairs, ["src_type", "dst_type", "rel"], "left").join(wild, "rel", "left")
    reason = F.when(F.col("_known").isNull(), "undeclared relation").when(F.col("_pair").isNull() & F.col("_wild").isNull(), "not allowed for the types")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("edge_id", "src_type", "rel", "dst_type", "reason")


def capture(source: Column, stored: Column) -> Column:
    """Share of the source's numbers that are stored; null where it has none."""
    wanted = extract_numbers(source)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, extract_numbers(stored))) / F.size(wanted))


def extraction_coverage(rows: DataFrame, group: str, source: str, stored: str) -> DataFrame:
    """For each group the captured share of the source's numbers and growth rates, worst first."""
    wanted, held = extract_numbers(F.col(source)), extract_numbers(F.col(stored))
    rate = six_digits(growth_amount(F.col(source)))
    n = rows.select(group, wanted.alias("w"), held.alias("h"), rate.alias("g"))
    n = n.select(group, F.size("w").alias("w"), F.size(F.array_intersect("w", "h")).alias("f"), F.col("g").isNotNull().cast("int").alias("g"), F.coalesce(F.array_contains("h", F.col("g")), F.lit(False)).cast("int").alias("gf"))
    out = n.groupBy(group).agg(F.sum("w").alias("wanted"), F.sum("f").alias("found"), F.sum("g").alias("growth_rows"), F.sum("gf").alias("growth_found"))
    return out.withColumn("captured", F.when(F.col("wanted") > 0, F.round(F.col("found") / F.col("wanted"), 4))).orderBy("captured", group)


def data_gaps(g: PropertyGraph, kind: str, rels: list[str]) -> DataFrame:
    """Nodes of a kind with whether they have any edge of the relations."""
    has = g.adjacency(*rels).select(F.col("src").alias("id")).distinct().withColumn("_has", F.lit(True))
    return g.of_type(kind).join(has, "id", "left").select("id", "name", F.col("_has").isNull().alias("is_gap"))


def majority(votes: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """The label with most votes of each key. Of several the middle one in `order` wins, of two middle ones the upper; labels
    that aren't in `order` come last. A key has one entry for each label, however many votes there are."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(label)), F.lit(0)), F.lit(len(order) + 1))
    n = votes.groupBy(key, label).agg(F.count(F.lit(1)).alias("votes"))
    tally = n.groupBy(key).agg(F.max("votes").alias("votes"), F.collect_list(F.struct(place.alias("place"), F.col(label).alias("label"), F.col("votes").alias("n"))).alias("_t"))
    winners = F.array_sort(F.filter("_t", lambda t: t["n"] == F.col("votes")))
    middle = F.get(winners, F.floor(F.size(winners) / 2).cast("int"))
    return tally.select(key, middle["label"].alias(label), "votes")


def report(rows: DataFrame, by: str) -> DataFrame:
    """Rows and percentage of each value."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2))


def validate_knowledge_base(entities: DataFrame, relationships: DataFrame, claims: DataFrame, forbidden: list[str] = ()) -> DataFrame:
    """(problem, id) for duplicate ids, dangling ends, entities of forbidden types, and claims without confidence or rationale."""
    ids = entities.select("entity_id")
    problem = lambda rows, what, key: rows.select(F.lit(what).alias("problem"), F.col(key).alias("id"))
    twice = problem(ids.groupBy("entity_id").count().filter("count > 1"), "duplicate id", "entity_id")
    ends = relationships.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct()
    dangling = problem(ends.join(ids, "entity_id", "left_anti"), "dangling end", "entity_id")
    bare = problem(claims.filter("confidence IS NULL OR rationale IS NULL OR rationale = ''"), "claim without grounds", "claim_id")
    found = twice.unionByName(dangling).unionByName(bare)
    return found.unionByName(problem(entities.filter(F.col("type").isin(*forbidden)), "forbidden type", "entity_id")) if forbidden else found


#: The least or most that a graph and its sources must reach.
GATES = {"unmapped": 0.05, "captured": 0.85, "growth": 0.85, "least_captured": 0.40}


def contract_verdict(found: DataFrame, most_unmapped: float = GATES["unmapped"]) -> DataFrame:
    """(check, value, ok) from contract()'s rows: the share of edges of unknown relations, and nothing without name, fact or
    type. An empty graph fails for lack of edges."""
    of = lambda metric: F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0))
    one = found.agg(*[of(m).alias(m) for m in ("edges", "unmapped_edges", "edges_without_fact", "nodes_without_name", "nodes_without_type")])
    share = F.round(F.when(F.col("edges") > 0, F.col("unmapped_edges") / F.col("edges")), 6)
    checks = [("edges", F.col("edges").cast("double"), F.col("edges") > 0), ("unmapped_share", share, F.coalesce(share <= most_unmapped, F.lit(False)))]
    checks += [(m, F.col(m).cast("double"), F.col(m) == 0) for m in ("edges_without_fact", "nodes_without_name", "nodes_without_type")]
    rows = F.array(*[F.struct(F.lit(name).alias("check"), value.alias("value"), ok.alias("ok")) for name, value, ok in checks])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def coverage_gates(coverage: DataFrame, group: str) -> DataFrame:
    """(gate, value, ok) from extraction_coverage()'s rows: captured numbers and growth rates of all groups, and the worst
    group's captured numbers. A gate without anything wanted holds."""
    one = coverage.agg(F.sum("wanted").alias("w"), F.sum("found").alias("f"), F.sum("growth_rows").alias("g"), F.sum("growth_found").alias("h"), F.min("captured").alias("least"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    gates = [("captured", share("f", "w"), GATES["captured"]), ("growth", share("h", "g"), GATES["growth"]), ("least_captured", F.round("least", 6), GATES["least_captured"])]
    rows = F.array(*[F.struct(F.lit(name).alias("gate"), value.alias("value"), F.coalesce(value >= least, F.lit(True)).alias("ok")) for name, value, least in gates])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def admitted_gaps(gaps: DataFrame, summaries: DataFrame, key: str = "id", summary: str = "summary") -> DataFrame:
    """data_gaps()'s rows with admitted: whether the answer to a node without data says that something is missing. Nodes with
    data, and those without an answer, have null."""
    said = summaries.select(F.col(key), real_gap(F.col(summary)).alias("_said"))
    return gaps.join(said, key, "left").withColumn("admitted", F.when(F.col("is_gap"), F.col("_said"))).drop("_said")


# -- changes of a graph -----------------------------------------------------------------------------------------------
def relabelled(g: PropertyGraph, names: dict[str, str] | None = None) -> PropertyGraph:
    """g with its relations renamed: as told, or each spelling to the preferred one of its relation."""
    if names is not None:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
        return PropertyGraph(g.nodes, g.edges.withColumn("rel", F.coalesce(F.try_element_at(table, F.col("rel")), F.col("rel"))) if names else g.edges)
    best = preferred_casing(g.edges.select("rel")).select("rel", "preferred")
    columns = g.edges.columns
    return PropertyGraph(g.nodes, g.edges.join(best, "rel").withColumn("rel", F.col("preferred")).select(*columns))


def conforming(g: PropertyGraph, edge_types: DataFrame, allowed: DataFrame) -> PropertyGraph:
    """g without the edges that break the ontology."""
    broken = conformance(g, edge_types, allowed).select("edge_id")
    return PropertyGraph(g.nodes, g.edges.join(broken, "edge_id", "left_anti"))


# -- names, which need the places of matches --------------------------------------------------------------------------
# What a run of capitalised words is, and capitalised words that are no names.
_RUN = re.compile(r"\b[A-Z][\w&.'-]*(?:\s+(?:of|and|for|the|de|van)\s+[A-Z][\w&.'-]*|\s+[A-Z][\w&.'-]*)*")
NO_NAMES = {
    "the", "this", "that", "these", "those", "a", "an", "as", "at", "by", "for",
    "from", "in", "into", "of", "on", "to", "with", "and", "or", "but", "if",
    "it", "its", "was", "were", "is", "are", "be", "been", "has", "have", "had",
    "no", "not", "none", "there", "their", "they", "he", "she", "we", "you",
    "however", "although", "while", "based", "according", "per", "both", "each",
    "overall", "further", "also", "such", "during", "after", "before",
    "yes", "data", "information", "source", "note", "reference", "answer",
}


def names_of(text: str | None) -> list[str]:
    """Lower-cased proper names: runs of capitalised words, but no single word that only starts a sentence."""
    out: dict[str, None] = {}
    for m in _RUN.finditer(text or ""):
        name = m[0].strip().rstrip(".,;:")
        before = text[: m.start()].rstrip()[-1:]
        starts = not before or before in ".!?:;"
        if len(name) >= 3 and name.lower() not in NO_NAMES and not (" " not in name and starts and not name.isupper()):
            out[name.lower()] = None
    return list(out)


def with_names(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the list of a text's names; texts without any have an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([names_of(t.as_py()) for t in b.column(b.schema.names.index(text))], type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def with_recall(rows: DataFrame, truth: str = "ground_truth", hop: str = "kg_hop_path", query: str = "query") -> DataFrame:
    """rows with wanted, found and recall of the answer's numbers and names that the question doesn't give away."""
    rows = with_names(with_names(rows, truth, "_tn"), query, "_qn")
    numbers = F.array_except(extract_numbers(F.col(truth)), extract_numbers(F.col(query)))
    given = lambda n: F.exists("_qn", lambda q: q.contains(n) | n.contains(q))
    names = F.filter("_tn", lambda n: ~given(n))
    found = F.size(F.array_intersect(numbers, extract_numbers(F.col(hop)))) + F.size(F.filter(names, lambda n: F.lower(F.coalesce(F.col(hop), F.lit(""))).contains(n)))
    wanted = F.size(numbers) + F.size(names)
    return rows.withColumn("wanted", wanted).withColumn("found", found).withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted"))).drop("_tn", "_qn")
