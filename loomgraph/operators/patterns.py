"""Thematic pattern queries: one generic operator and the table of relations, directions and kinds that it is called with."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators import many, paths
from loomgraph.storage import numbered


@dataclass(frozen=True)
class Pattern:
    """rels leave the anchor (out), enter it (in) or either, or aren't tied to it (all); other: the kind of the node at the far
    end; via: a relation that leads from the anchor to where the pattern starts; most: rows that are wanted."""

    rels: tuple[str, ...]
    direction: str = "out"
    other: str | None = None
    via: str | None = None
    most: int | None = None


# What each thematic question asks of the graph, around one entity or all.
PATTERNS = {
    "T_Beneficiary": [Pattern(("BENEFITS_FROM",), "in", "COMPANY")],
    "T_ConstraintRisk": [Pattern(("CONSTRAINED_BY",)), Pattern(("CONSTRAINS",), "in")],
    "T_EventScenario": [Pattern(("CAUSES", "HURT_BY"))],
    "T_Hedging": [Pattern(("HEDGES",))],
    "T_InvestmentFlow": [Pattern(("INVESTS_IN",), "in")],
    "T_OwnershipStructure": [Pattern(("OWNS", "JV_WITH"), "either")],
    "T_PriceLinkage": [Pattern(("PRICE_LINKED_TO",), "either")],
    "T_RegulatoryImpact": [Pattern(("REGULATED_BY",))],
    "T_SectorExposure": [Pattern(("CONTAINS",), "out", "COMPANY")],
    "T_SupplyDisruption": [Pattern(("NEEDS", "SOURCED_FROM", "SUPPLIES_TO"))],
    "T_TransitRisk": [Pattern(("TRANSITS",), "in")],
}
#: Fixed values, for equal results: what they ask where one entity of a type is all that the question names; a first relation leads through a sector's members.
SINGLE = {
    "T_Beneficiary": {"SECTOR": Pattern(("BENEFITS_FROM",), via="CONTAINS"), "default": Pattern(("BENEFITS_FROM",), "in", "COMPANY")},
    "T_ConstraintRisk": {"SECTOR": Pattern(("CONSTRAINED_BY", "HURT_BY", "NEEDS"), via="CONTAINS"), "default": Pattern(("CONSTRAINED_BY", "HURT_BY", "NEEDS"))},
    "T_EventScenario": {"GEOGRAPHY": Pattern(("HURT_BY", "BENEFITS_FROM", "NEEDS", "SOURCED_FROM"), "in"), "default": Pattern(("CAUSES", "HURT_BY"))},
    "T_Hedging": {"default": Pattern(("HEDGES", "HURT_BY", "BENEFITS_FROM", "PRICE_LINKED_TO"))},
    "T_InvestmentFlow": {"INVESTOR": Pattern(("INVESTS_IN",)), "GEOGRAPHY": Pattern(("INVESTS_IN",), "all", most=20), "default": Pattern(("INVESTS_IN",), "in")},
    "T_OwnershipStructure": {"default": Pattern(("OWNS", "JV_WITH"), "either")},
    "T_PriceLinkage": {"default": Pattern(("PRICE_LINKED_TO", "HURT_BY", "BENEFITS_FROM"))},
    "T_RegulatoryImpact": {"SECTOR": Pattern(("REGULATED_BY", "HURT_BY"), via="CONTAINS"), "default": Pattern(("REGULATED_BY", "HURT_BY", "CONSTRAINED_BY"))},
    "T_SectorExposure": {"COMPANY": Pattern(("CONTAINS",), "in"), "default": Pattern(("CONTAINS",), "out", "COMPANY")},
    "T_SupplyDisruption": {"RAW_MATERIAL": Pattern(("NEEDS", "SOURCED_FROM", "SUPPLIES_TO", "HURT_BY"), "in"), "default": Pattern(("NEEDS", "SOURCED_FROM", "SUPPLIES_TO", "HURT_BY"))},
    "T_TransitRisk": {"RAW_MATERIAL": Pattern(("TRANSITS", "SOURCED_FROM")), "PRODUCT": Pattern(("TRANSITS", "SOURCED_FROM", "NEEDS")), "GEOGRAPHY": Pattern(("TRANSITS", "SOURCED_FROM"), "in"), "default": Pattern(("TRANSITS",), "in")},
}
CAUSAL = ["CAUSES", "TRANSITS", "HURT_BY", "BENEFITS_FROM", "NEEDS", "PRODUCES", "CONTAINS", "PRICE_LINKED_TO", "SOURCED_FROM"]
#: Hops of the path questions.
IMPACT_HOPS, MACRO_HOPS, MACRO_REACH = 12, 10, 6


def match(g: PropertyGraph, anchor: str | None, pattern: Pattern) -> DataFrame:
    """The far ends of a pattern at an anchor (all anchors if None), distinct and in order."""
    edges = g.with_rel(*pattern.rels).select("src", "dst", "rel", "channel")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "channel")
    rows = {"out": edges, "all": edges, "in": turned, "either": edges.unionByName(turned)}[pattern.direction]
    anchored = anchor is not None and pattern.direction != "all"
    if pattern.via:
        members = g.with_rel(pattern.via).select("src", F.col("dst").alias("_member"))
        members = members.filter(F.col("src") == anchor) if anchored else members
        rows = rows.join(members.select("_member").distinct(), F.col("src") == F.col("_member"), "left_semi")
    elif anchored:
        rows = rows.filter(F.col("src") == anchor)
    others = g.of_type(pattern.other) if pattern.other else g.nodes
    rows = rows.join(g.nodes.select(F.col("id").alias("src"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type")), "src")
    rows = rows.join(others.select(F.col("id").alias("dst"), F.col("name").alias("linked_name"), F.col("type").alias("linked_type")), "dst")
    rows = rows.select("entity_name", "entity_type", F.col("rel").alias("relationship"), F.col("dst").alias("linked_id"), "linked_name", "linked_type", "channel").distinct()
    order = ["linked_type", "linked_name", "entity_name", "relationship", "linked_id"]
    return rows.orderBy(*order) if pattern.most is None else rows.orderBy(*order).limit(pattern.most)


#: Short names of the questions.
SHORT = {
    "beneficiary": "T_Beneficiary", "constraint_risk": "T_ConstraintRisk", "event_scenario": "T_EventScenario", "hedging": "T_Hedging", "investment_flow": "T_InvestmentFlow", "ownership": "T_OwnershipStructure",
    "price_linkage": "T_PriceLinkage", "regulatory": "T_RegulatoryImpact", "sector_exposure": "T_SectorExposure", "supply_disruption": "T_SupplyDisruption", "transit_risk": "T_TransitRisk",
}


def ask(g: PropertyGraph, question: str, anchor: str | None = None, entity_type: str | None = None) -> DataFrame:
    """A thematic question of PATTERNS around an anchor, or all; with entity_type the one of SINGLE for an entity of that
    type, or its default."""
    question = SHORT.get(question, question)
    if entity_type is not None:
        of = SINGLE[question]
        return match(g, anchor, of.get(entity_type, of["default"]))
    rows = [match(g, anchor, p) for p in PATTERNS[question]]
    return rows[0] if len(rows) == 1 else union_all(rows).distinct()


def transit_risk(g: PropertyGraph, target: str, commodity: str | None = None, gulf: frozenset[str] = frozenset(), chokepoint: str | None = None) -> DataFrame:
    """What passes through a place, or one commodity; places of the gulf, or none, stand for their chokepoint."""
    place = chokepoint if chokepoint is not None and (target is None or target in gulf) else target
    rows = ask(g, "T_TransitRisk", place)
    return rows if commodity is None else rows.filter(F.col("linked_id") == commodity)


def _path(rows: DataFrame, g: PropertyGraph, source: str) -> DataFrame:
    """Path rows with the names and types along each."""
    steps = rows.select(F.lit(source).alias("source"), F.col("id").alias("target"), "hops", "path_rels", F.posexplode("path_nodes").alias("_i", "_id"), F.col("path_nodes").alias("_p"))
    named = steps.join(g.nodes.select(F.col("id").alias("_id"), "name", "type"), "_id")
    each = named.groupBy("source", "target", "hops", "path_rels", "_p").agg(F.array_sort(F.collect_list(F.struct("_i", "name", "type"))).alias("_n"))
    return each.select("source", "target", F.transform("_n", lambda x: x["name"]).alias("path_names"), F.transform("_n", lambda x: x["type"]).alias("path_types"), F.col("path_rels").alias("rel_types"), "hops")


def stock_impact(g: PropertyGraph, source: str, target: str) -> DataFrame:
    """The shortest path between a company and a shock, with names, types and relations along it."""
    return _path(paths.shortest_path(g, source, target, IMPACT_HOPS), g, source)


def macro_transmission(g: PropertyGraph, macro: str, company: str | None = None, kind: str = "COMPANY") -> DataFrame:
    """The shortest path from a macro variable to a company; without a company, the nearest ones with their hops."""
    if company is not None:
        return _path(paths.shortest_path(g, macro, company, MACRO_HOPS), g, macro)
    return paths.reachable(g, macro, MACRO_REACH, kind)


def causal_chain(g: PropertyGraph, source: str, target: str | None, most: int = 10) -> DataFrame:
    """The ten shortest directed chains of cause and effect."""
    if target is None:
        return paths.trails(g, source, None, CAUSAL, most)
    return many.best_trails(g, source, target, 10, CAUSAL, most)


def chain(g: PropertyGraph, rels: list[str], anchor: str | None = None) -> DataFrame:
    """Directed paths that follow the relations one after the other."""
    rows = None
    for i, rel in enumerate(rels):
        step = g.with_rel(rel).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
        step = step.filter(F.col("n0") == anchor) if i == 0 and anchor is not None else step
        rows = step if rows is None else rows.join(step, f"n{i}")
    return rows.select(*[f"n{i}" for i in range(len(rels) + 1)])


def tied_to_both(g: PropertyGraph, a: str, b: str, kind: str = "COMPANY") -> DataFrame:
    """Nodes of a kind with an edge to both of two others: two semi joins."""
    near = lambda x: g.adjacency().filter(F.col("src") == x).select(F.col("dst").alias("id"))
    return g.of_type(kind).join(near(a), "id", "left_semi").join(near(b), "id", "left_semi").select("id", "name")


def bottleneck_rows(g: PropertyGraph, constraint_rel: str, kind: str) -> DataFrame:
    """(src, constraint_name, supplier): a row for each node of a kind on any edge of a constrained thing. The long form:
    nothing is collected."""
    held = g.with_rel(constraint_rel).select(F.col("dst").alias("src")).distinct()
    near = g.adjacency().join(held, "src").join(g.of_type(kind).select(F.col("id").alias("dst"), F.col("name").alias("supplier")), "dst").select("src", "supplier").distinct()
    return near.join(g.nodes.select(F.col("id").alias("src"), F.col("name").alias("constraint_name")), "src").select("src", "constraint_name", "supplier")


def bottlenecks(g: PropertyGraph, constraint_rel: str, kind: str) -> DataFrame:
    """The same with the names of each constrained thing in one sorted list."""
    return bottleneck_rows(g, constraint_rel, kind).groupBy("src", "constraint_name").agg(F.array_sort(F.collect_set("supplier")).alias("suppliers")).drop("src")


def sign_flipped(g: PropertyGraph, source: str) -> PropertyGraph:
    """g with the signs of the edges that leave a node inverted."""
    flipped = F.when(F.col("src") != source, F.col("sign")).when(F.col("sign") == "+", "-").when(F.col("sign") == "-", "+").otherwise(F.col("sign"))
    return PropertyGraph(g.nodes, g.edges.withColumn("sign", flipped))


def deciles(rows: DataFrame, key: str, *measures: str, parts: int = 10) -> DataFrame:
    """rows with a column <measure>_part for each measure: its decile, 1 for the largest values; the first parts take one row
    more where rows don't divide evenly. Each measure is numbered by ranges, so no task sorts all rows."""
    total = rows.count()
    small, more = divmod(total, parts)
    for measure in measures:
        rows = numbered(rows, [F.col(measure).desc(), F.col(key)], "_at")
        early = F.floor(F.col("_at") / (small + 1)) + 1
        late = more + F.floor((F.col("_at") - more * (small + 1)) / max(small, 1)) + 1
        rows = rows.withColumn(f"{measure}_part", F.when(F.col("_at") < more * (small + 1), early).otherwise(late).cast("int")).drop("_at")
    return rows


def purity(g: PropertyGraph, shock: str, theme_rels: list[str], kind: str = "COMPANY", most: int = 4) -> DataFrame:
    """(id, name, theme_purity, edge_count): for each node of a kind that a shock reaches, the share of its edges that are of the
    theme's relations, and the number of distinct directed paths from the shock."""
    ways = paths.trails(g, shock, None, theme_rels, most, None).groupBy("id").agg(F.count_distinct("path_edges").alias("edge_count"))
    edges = g.adjacency().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("rel").isin(*theme_rels)).alias("_theme"))
    rows = g.of_type(kind).select("id", "name").join(ways, "id").join(edges, "id")
    return rows.select("id", "name", F.round(F.col("_theme") / F.col("_all"), 6).alias("theme_purity"), "edge_count")


def cross_theme(nodes: DataFrame, themes: list[str]) -> DataFrame:
    wanted = F.lit(True)
    for theme in themes:
        wanted = wanted & F.array_contains("themes", theme)
    return nodes.filter(wanted)


def all_questions(g: PropertyGraph) -> DataFrame:
    """Every question over every anchor, tagged by question."""
    return union_all([ask(g, q).withColumn("question", F.lit(q)) for q in PATTERNS])


# -- parameters -------------------------------------------------------------------------------------------------------
_SHOCKS = ("EVENT", "MACRO_VAR", "GEOGRAPHY")
# The types among which a question's source and target are looked for, in this order. any: the first entity
# where none is of these types; pair: the second company where there are two, else any.
PARAMETERS = {
    "T_StockImpact": (("COMPANY",), {"GEOGRAPHY", "EVENT", "MACRO_VAR"}),
    "T_CausalChain": (("EVENT", "GEOGRAPHY", "MACRO_VAR"), {"COMPANY", "MACRO_VAR", "SECTOR"}),
    "T_Beneficiary": (("EVENT", "MACRO_VAR", "GEOGRAPHY", "SECTOR"), None),
    "T_CompareExposure": (("COMPANY",), {"COMPANY"}),
    "T_ConstraintRisk": (("COMPANY", "SECTOR", "EVENT"), None),
    "T_EventScenario": (("EVENT", "GEOGRAPHY", "MACRO_VAR"), None),
    "T_Hedging": (("COMPANY",), None),
    "T_InvestmentFlow": ((), ("SECTOR", "COMPANY", "GEOGRAPHY", "INVESTOR")),
    "T_MacroTransmission": (("MACRO_VAR", "EVENT", "GEOGRAPHY"), {"COMPANY"}),
    "T_OwnershipStructure": (("COMPANY",), None),
    "T_PriceLinkage": (("COMPANY",), None),
    "T_RegulatoryImpact": (("COMPANY", "SECTOR"), None),
    "T_SectorExposure": (("SECTOR", "COMPANY"), None),
    "T_SupplyDisruption": (("COMPANY", "RAW_MATERIAL", "PRODUCT"), None),
    "T_TransitRisk": ((), ("GEOGRAPHY",)),
}
#: Questions that take two entities; with one, the question of SINGLE is asked.
NEEDS_TWO = ("T_StockImpact", "T_CausalChain", "T_CompareExposure", "T_MacroTransmission")


def parameters(question: str, entities: list[tuple[str, str]]) -> dict[str, str | None]:
    """source, target, shock, commodity, type and mode of a thematic question, from its entities (id, type) in order.

    mode is single where only one entity is named, or a question of two lacks one; type is then the entity's type."""
    if not entities:
        raise ValueError("the question names no known entity")
    entities = list(dict(entities).items())
    ordered = lambda types, without=(): next((i for t in types for i, k in entities if k == t and i not in without), None)
    among = lambda types, without: next((i for i, k in entities if k in types and i not in without), None)
    first = entities[0][0]
    sources, targets = PARAMETERS[question]
    source = (ordered(sources) or first) if sources else None
    target = ordered(targets) if isinstance(targets, tuple) else among(targets, (source,)) if targets else None
    if question == "T_CausalChain" and target is None and len(entities) > 1:
        target = entities[-1][0]
    if question == "T_InvestmentFlow" and target is None:
        target = first
    if source is not None and source == target:
        target = among({k for _, k in entities}, (source,)) or target
    shock = ordered(_SHOCKS) or first
    single = question not in ("T_TransitRisk",) and (len(entities) == 1 or question in NEEDS_TWO and (source is None or target is None))
    anchor = source or target or shock
    return {
        "source": source, "target": target, "shock": shock, "commodity": ordered(("RAW_MATERIAL", "PRODUCT")),
        "mode": "single" if single else "pair", "type": dict(entities).get(anchor) if single else None,
    }


def answer(g: PropertyGraph, question: str, entities: list[tuple[str, str]], gulf: frozenset[str] = frozenset(), chokepoint: str | None = None) -> DataFrame:
    """The rows of a thematic question about the entities (id, type) that it names."""
    p = parameters(question, entities)
    anchor = p["source"] or p["target"] or p["shock"]
    if p["mode"] == "single":
        if question in SINGLE:
            return ask(g, question, anchor, p["type"])
        return paths.reachable(g, anchor, MACRO_REACH) if question != "T_CausalChain" else causal_chain(g, anchor, None)
    if question == "T_StockImpact":
        return stock_impact(g, p["source"], p["target"])
    if question == "T_CausalChain":
        return causal_chain(g, p["source"], p["target"])
    if question == "T_CompareExposure":
        return paths.compare_exposure(g, p["source"], p["target"], p["shock"])
    if question == "T_MacroTransmission":
        return macro_transmission(g, p["source"], p["target"])
    if question == "T_TransitRisk":
        return transit_risk(g, p["target"], p["commodity"], gulf, chokepoint)
    return ask(g, question, anchor)


def with_parameters(rows: DataFrame, question: str, entities: str) -> DataFrame:
    """rows with source, target, shock, commodity, mode and type, the parameters of each thematic question. entities: an array
    of structs (id, type) in the question's order; without any all are null."""
    names = ["source", "target", "shock", "commodity", "mode", "type"]
    rows = rows.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, named = (batch.column(batch.schema.names.index(c)).to_pylist() for c in (question, entities))
            found = [parameters(q, [(e["id"], e["type"]) for e in es]) if es else {} for q, es in zip(asked, named)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([p.get(n) for p in found], pa.string()) for n in names)], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, T.StringType()) for n in names)]))
