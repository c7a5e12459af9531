"""Answering one question: link, route, fill slots, plan, run the cascade, add what search finds, render."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expressions import ANALYTICAL, ASKS_LOWEST
from loomgraph.graph import PropertyGraph
from loomgraph.operators import neighbourhood as N
from loomgraph.operators import paths, ranking, search
from loomgraph.plans import calls, linking, relevance, routing
from loomgraph.plans import slots as S
from loomgraph.plans.linking import Match
from loomgraph.plans.slots import Slots, bound  # noqa: F401

#: Facts of a question's subjects that are read before the best are chosen.
FACTS_READ = 200


def relations_for(question: str, keywords: dict[str, Iterable[str]]) -> list[str]:
    """Relations whose keywords the question holds, those with most hits first."""
    q = question.lower()
    hits = {rel: sum(w in q for w in words) for rel, words in keywords.items()}
    return [rel for rel in sorted(hits, key=lambda r: (-hits[r], r)) if hits[rel]]


@dataclass
class Engine:
    """names and aliases: name -> (id, type) of the nodes that questions can mention; keywords: relation -> words; defaults:
    a class's own relation; subject and metric: the types of what is asked about and measured; segment_rel: the relation that
    tags a subject's segment; generic: phrases that aren't the node of the name behind them.

    scorer(rows, question) replaces the similarity that holds the gate; gate=False lets all rows pass. summarise(text,
    question) is optional, called with retries; without it the rendered rows are the answer. spans and similar are hooks of
    the resolver."""

    graph: PropertyGraph
    names: dict[str, tuple[str, str]]
    keywords: dict[str, list[str]] = field(default_factory=dict)
    subject: str = "COMPANY"
    metric: str = "METRIC"
    segment_rel: str | None = None
    segments: list[str] = field(default_factory=list)
    scorer: Callable[[list[dict], str], float] | None = None
    summarise: Callable[[str, str], str] | None = None
    aliases: dict[str, tuple[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    generic: dict[str, str] = field(default_factory=dict)
    gate: bool = True
    spans: Callable | None = None
    similar: Callable | None = None
    attempts: int = 3
    seconds: float | None = 120.0

    def __post_init__(self):
        self.resolver = linking.Resolver(linking.Names(self.names), linking.Names(self.aliases, "alias", linking.BY_ALIAS, False) if self.aliases else None, self.spans, self.similar, self.generic)

    def link(self, question: str, label: str | None = None) -> list[Match]:
        """What the question mentions, each node once; with its class also what the class needs and the first pass missed."""
        matches = self.resolver.resolve(question, S.NEEDED.get(label, ()))
        return matches if label is None else self.resolver.enrich(question, matches, {self.subject if t == "COMPANY" else self.metric if t == "METRIC" else t for t in S.NEEDED.get(label, ())})

    def slots(self, question: str, label: str | None = None) -> Slots:
        label = label or routing.route(question)
        s = S.fill(question, label, self.link(question, label), self.keywords, self.defaults, self.subject, self.metric)
        if self.segments:
            s.segments = [x for x in self.segments if x.lower() in question.lower() or x.lower().rstrip("s") in question.lower()]
        return s

    def plan(self, question: str, label: str, s: Slots) -> list[tuple[str, Callable[[], DataFrame]]]:
        """(strategy, builder) in the order in which they are tried. Nothing runs here."""
        g, rels = self.graph, s.relations or None
        metric_rows = lambda: ranking.metric_rows(g, self.subject, s.metric, None, self.segment_rel, self.segments)
        lowest = bool(re.search(ASKS_LOWEST, question))
        out: list[tuple[str, Callable[[], DataFrame]]] = []
        mode = S.mode(question, label, s)
        if mode in ("global_ranking_max", "global_ranking_min") and label.startswith("F_Quant"):
            # ranks all subjects by the second node's words, whatever the first one is
            out.append((mode, lambda: ranking.global_rank(ranking.metric_rows(g, self.subject, s.topics[-1], None, self.segment_rel, self.segments), mode.endswith("max"), s.segments[0] if s.segments else None)))
        if label == "F_GlobalRank" and s.metric:
            segment = s.segments[0] if s.segments else None
            out.append((f"global_ranking_{'min' if lowest else 'max'}", lambda: ranking.global_rank(metric_rows(), not lowest, segment)))
        elif label == "F_GroupAggregate" and s.metric:
            if len(s.segments) >= 2:
                out.append(("group_vs_group", lambda: ranking.group_vs_group(metric_rows(), s.segments)))
            else:
                out.append((f"group_rank_by_segment_{'min' if lowest else 'max'}", lambda: ranking.segment_rank(metric_rows(), not lowest)))
        elif label == "F_CompToGroupAverage" and s.metric and s.first:
            out.append(("comp_to_group_avg", lambda: ranking.company_to_group(metric_rows(), s.first)))
        elif label.startswith("F_Comp") and "Count" not in label and s.first and s.second:
            if s.metric:
                out.append(("compare_metric_named", lambda: N.compared(g, s.first, s.second, [*rels, *(r for r in S.METRIC_ALSO if r not in rels)] if rels else None, s.metric)))
            if rels or s.metric:
                out.append(("compare_metric", lambda: N.compared(g, s.first, s.second, rels)))
            out.append(("compare_pair", lambda: paths.compare_pair(g, s.first, s.second, approx=label == "F_CompApprox")))
        elif mode == "attribute_lookup_direct":
            out.append((mode, lambda: N.attributes(g.nodes, s.first)))
        elif mode == "list_companies_by_topic":
            out.append(("list_companies_by_topic", lambda: N.companies_by_topic(g, s.topics, self.subject)))
        elif label == "F_LogUnion" and s.first:
            out.append(("primary", lambda: N.log_union(g, s.first, s.second, rels)))
        elif label == "F_LogIntersection" and s.first and s.second:
            out.append(("primary", lambda: N.log_intersection(g, s.first, s.second, rels)))
        elif label == "F_LogDifference" and s.first and s.second:
            out.append(("primary", lambda: N.log_difference(g, s.first, s.second, rels)))
        elif label in ("F_QuantMax", "F_QuantMin") and s.first:
            out.append(("primary", lambda: N.extreme(g, s.first, label == "F_QuantMax", rels)))
        elif label in ("F_QuantAtmost", "F_QuantAtleast", "F_QuantApprox", "F_QuantEqual"):
            out.append(("primary", lambda: N.by_value(g, label.removeprefix("F_Quant").lower(), s.threshold, rels)))
        elif "Count" in label:
            how = {"F_CompCountMore": "more", "F_CompCountLess": "less", "F_CompCountApprox": "approx"}.get(label, label.removeprefix("F_QuantCount").lower())
            out.append(("primary", (lambda: N.counted(g, how, s.threshold, rels)) if how else (lambda: N.collected(g, None, rels))))
        if s.first and (label in ("F_Simple", "F_LogUnion") or not out):
            if not out:
                out.append(("primary", lambda: N.neighbours(g, s.first, rels, targets=s.targets or None)))
                if s.targets:
                    out.append(("primary", lambda: N.neighbours(g, s.first, rels)))
            out.append(("relaxed_direction", lambda: N.relaxed_direction(g, s.first, None)))
            out.append(("attribute_lookup", lambda: N.attributes(g.nodes, s.first)))
        return out

    def scored_facts(self, question: str, subjects: list[str]) -> DataFrame:
        """The graph's facts, those of the subjects (names) or all, with sim, their similarity to the question."""
        nodes = self.graph.nodes.select(F.col("id").alias("src"), F.col("name").alias("subject_name"), F.col("type").alias("_type"))
        nodes = nodes.filter(F.col("subject_name").isin(*subjects)) if subjects else nodes.filter(F.col("_type") == self.subject)
        others = self.graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("object_name"))
        facts = self.graph.adjacency().filter("fact IS NOT NULL").join(nodes, "src").join(others, "dst")
        sim = F.round(relevance.similarity_column(F.col("fact"), question, subjects), 6)
        return facts.select("edge_id", "subject_name", F.col("rel").alias("relationship"), "object_name", "fact", sim.alias("sim"))

    def supplemented(self, question: str, answer: routing.Answer, matches: list[Match]) -> routing.Answer:
        """The answer with the facts that a search by similarity adds: about its subjects where its strategy allows, about all
        subjects where the question asks which of them, and the subjects' profiles where the rows are few."""
        subjects = sorted({m.name for m in matches if m.type == self.subject})
        collect = lambda rows: [r.asDict() for r in rows.collect()]
        rows, strategy = answer.rows, answer.strategy
        known = routing.STRATEGIES.get(strategy)
        if subjects and (known is None or known.supplement):
            analytical = re.search(ANALYTICAL, question) is not None
            most, floor = (search.ANALYTICAL_ADDED, relevance.FLOOR / 2) if analytical else (search.ADDED, relevance.FLOOR)
            extra = collect(search.top_k(self.scored_facts(question, subjects), most, "edge_id", floor))
            if extra:
                rows = relevance.ranked(question, relevance.merged(rows, extra, search.MERGED), subjects, most=search.MERGED)
        across = S.across_companies(question)
        if not subjects and (across or not rows):
            scored = self.scored_facts(question, [])
            extra = collect(search.diversified(scored, "edge_id", "subject_name", floor=relevance.FLOOR).drop("group_rank"))
            if across:
                extra = relevance.merged(extra, collect(search.top_each(scored, "edge_id", "subject_name").drop("group_rank")), search.ENUMERATED)
            if extra:
                most = search.ENUMERATED if across else search.MERGED
                strategy = strategy if rows else "cross_company_search"
                rows = relevance.ranked(question, relevance.merged(rows, extra, most), most=most)
        node = known is not None and known.node
        if "summary" in self.graph.nodes.columns and (subjects and len(rows) < search.PROFILE_ROWS or node and matches):
            about = N.profiles(self.graph.nodes, names=subjects) if subjects and len(rows) < search.PROFILE_ROWS else N.profiles(self.graph.nodes, ids=[matches[0].id])
            rows = rows + collect(about)
        if rows and strategy == "none":
            strategy = "semantic_fact_search"
        return routing.Answer(strategy, rows, answer.score)

    def search(self, question: str, domain: str | None = None) -> dict:
        """The result record of one question; an error becomes its field `error`."""
        record: dict = {"query": question, "predicted_template": None, "cypher_strategy": "none", "kg_row_count": 0, "kg_hop_path": "", "summary": "", "error": ""}
        try:
            label = record["predicted_template"] = routing.route(question, domain)
            matches = self.link(question, label)
            record["resolved_entities"] = [vars(m) for m in matches]
            s = self.slots(question, label)
            record["triplet_slots"] = vars(s)
            names = [m.entity for m in matches if m.type == self.subject]
            judge = (lambda rows: self.scorer(rows, question)) if self.scorer else (lambda rows: max(relevance.scores(question, rows, names))) if self.gate else None
            floor = routing.FLOOR if self.scorer else relevance.FLOOR
            answer = routing.cascade(self.plan(question, label, s), judge, floor)
            if self.gate and (matches or S.across_companies(question)):
                answer = self.supplemented(question, answer, matches)
            lines = [f"Row {k}: " + (r.get("fact") or " | ".join(f"{a}={b}" for a, b in r.items() if b is not None)) for k, r in enumerate(answer.rows, 1)]
            record |= {"cypher_strategy": answer.strategy, "kg_row_count": len(answer.rows), "rows": answer.rows, "kg_hop_path": "\n".join(lines)}
            say = lambda: self.summarise(record["kg_hop_path"], question)
            record["summary"] = calls.retried(say, self.attempts, seconds=self.seconds) if self.summarise else record["kg_hop_path"]
        except Exception as error:  # the record's contract: one bad question doesn't end a batch
            record["error"] = f"{type(error).__name__}: {error}"
        return record

    def health(self) -> dict:
        """Whether the graph can be read."""
        try:
            return {"status": "ok", "names": len(self.names), "has_nodes": self.graph.nodes.limit(1).count() == 1}
        except Exception as error:
            return {"status": "failed", "error": f"{type(error).__name__}: {error}"}
