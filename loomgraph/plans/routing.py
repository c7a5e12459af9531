"""Routing of questions to query classes: one decision list, as Python and as a native column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """label if the question has one of `any`, one of `also`, none of `no`, and `domain` and `segments` allow it."""

    label: str
    any: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    no: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    or_domains: tuple[str, ...] = ()
    least_segments: int = 0
    segment_counts: bool = False


# Words of a question that name a group of companies.
SEGMENTS = {
    "Public Sector Banks": ("public sector bank", "psu bank", "psb"),
    "Private Sector Banks": ("private sector bank",),
    "Small Finance Banks": ("small finance bank",),
}
_BEST = ("highest", "lowest", "max", "min", "maximum", "minimum", "largest", "smallest")
_COMPARE = ("compare", "peer", " vs ", " versus ")
_RANKS = (
    "which bank", "which company", "which public sector bank", "which private sector bank", "which small finance bank",
    "report the highest", "report the lowest", "reports the highest", "reports the lowest",
)
_AMOUNT = ("how many", "how much", "number of", "count of")
# The decision list, first match wins.
RULES = [
    Rule("F_LogUnion", (" or ", " either "), no=("more than", "less than")),
    Rule("F_LogIntersection", (" and ", " both "), domains=("T_EventScenario", "T_SectorExposure")),
    Rule("F_LogDifference", ("but not", "without", "except", "excluding")),
    Rule("F_CompToGroupAverage", ("average for its segment", "segment average", "peer average", "average for its peer")),
    Rule("F_GroupAggregate", least_segments=2),
    Rule("F_GroupAggregate", ("as a group compare", "compare... as a group")),
    Rule("F_GroupAggregate", ("average",), also=_BEST, least_segments=1),
    Rule("F_GroupAggregate", ("average",), also=_BEST, segment_counts=True),
    Rule("F_GlobalRank", _RANKS, also=("across all", "all 39", "all listed", "all banks")),
    Rule("F_GlobalRank", _RANKS, least_segments=1),
    Rule("F_CompLess", _COMPARE, also=("less", "lower", "fewer"), or_domains=("T_CompareExposure",)),
    Rule("F_CompApprox", _COMPARE, also=("approximately", "around", "similar"), or_domains=("T_CompareExposure",)),
    Rule("F_CompMore", _COMPARE, or_domains=("T_CompareExposure",)),
    Rule("F_CompCountMore", _AMOUNT, also=("more than", "greater than", "higher than")),
    Rule("F_CompCountLess", _AMOUNT, also=("less than", "fewer than", "lower than")),
    Rule("F_CompCountApprox", _AMOUNT, also=("approximately", "around", "about")),
    Rule("F_QuantCountAtmost", _AMOUNT, also=("at most", "atmost", "no more than")),
    Rule("F_QuantCountAtleast", _AMOUNT, also=("at least", "atleast")),
    Rule("F_QuantCountEqual", _AMOUNT, also=("exactly", "equal to", "precisely")),
    Rule("F_QuantCount", _AMOUNT),
    Rule("F_CompMore", ("more than", "greater", "higher", "larger")),
    Rule("F_CompLess", ("less than", "lower", "fewer", "smaller")),
    Rule("F_CompApprox", ("approximately", "around", "about the same", "similar")),
    Rule("F_QuantAtmost", ("at most", "atmost", "up to", "maximum")),
    Rule("F_QuantAtleast", ("at least", "atleast", "minimum")),
    Rule("F_QuantEqual", ("exactly", "equal", "precisely")),
    Rule("F_QuantMax", ("max", "highest", "largest")),
    Rule("F_QuantMin", ("min", "lowest", "smallest")),
    Rule("F_QuantApprox", ("roughly",)),
    Rule("F_QuantCount", ("share",), domains=("T_TransitRisk", "T_SectorExposure", "T_Beneficiary", "T_SupplyDisruption")),
]
DEFAULT = "F_Simple"


def route(question: str, domain: str | None = None, segments: dict[str, tuple[str, ...]] = SEGMENTS) -> str:
    """The class of one question."""
    q = question.lower().replace("most recently", " ").replace("most recent", " ")
    has = lambda words: any(w in q for w in words)
    named = sum(has(words) for words in segments.values())
    for r in RULES:
        if r.domains and domain not in r.domains or named < r.least_segments or r.segment_counts and "segment" not in q:
            continue
        first = has(r.any) or domain in r.or_domains if r.any else True
        if first and (not r.also or has(r.also)) and not has(r.no):
            return r.label
    return DEFAULT


def route_column(question: Column, domain: Column | None = None, segments: dict[str, tuple[str, ...]] = SEGMENTS) -> Column:
    """The same as a native expression, for a table of questions."""
    q = F.replace(F.replace(F.lower(question), F.lit("most recently"), F.lit(" ")), F.lit("most recent"), F.lit(" "))

    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | q.contains(w)
        return out

    among = lambda names: F.coalesce(domain.isin(*names), F.lit(False)) if domain is not None and names else F.lit(False)
    named = sum((has(w).cast("int") for w in segments.values()), F.lit(0))
    out = F.lit(DEFAULT)
    for r in reversed(RULES):
        test = has(r.any) | among(r.or_domains) if r.any else F.lit(True)
        test = test & has(r.also) if r.also else test
        test = test & ~has(r.no) if r.no else test
        test = test & among(r.domains) if r.domains else test
        test = test & (named >= r.least_segments) if r.least_segments else test
        test = test & q.contains("segment") if r.segment_counts else test
        out = F.when(test, F.lit(r.label)).otherwise(out)
    return out


# -- strategies and the fallback cascade ------------------------------------------------------------------------------
@dataclass(frozen=True)
class Strategy:
    """gated: rows must be relevant enough; supplement: search hits may be merged in; node: answers from a node itself."""

    name: str
    gated: bool = False
    supplement: bool = False
    node: bool = False


STRATEGIES = {
    s.name: s
    for s in [
        Strategy("primary", True, True), Strategy("compare_pair"), Strategy("compare_metric"), Strategy("compare_metric_named"), Strategy("relaxed_direction", True, True),
        Strategy("attribute_lookup", True, True, True), Strategy("attribute_lookup_direct", node=True), Strategy("global_ranking_max"), Strategy("global_ranking_min"), Strategy("group_rank_by_segment_max"),
        Strategy("group_rank_by_segment_min"), Strategy("group_vs_group"), Strategy("comp_to_group_avg"), Strategy("list_companies_by_topic"), Strategy("semantic_fact_search"), Strategy("text_search_fallback"), Strategy("cross_company_search"),
    ]
}
#: Relevance from which rows of a gated strategy are accepted, and the most rows that an answer takes.
FLOOR, MOST_ROWS = 0.32, 90


@dataclass
class Answer:
    strategy: str
    rows: list[dict] = field(default_factory=list)
    score: float | None = None


def cascade(attempts: list[tuple[str, Callable]], scorer: Callable[[list[dict]], float] | None = None, floor: float = FLOOR, most: int = MOST_ROWS) -> Answer:
    """Tries (strategy, builder of a DataFrame) in turn, each with one job for `most` rows at most.

    Rows are accepted if nothing scores them, the strategy isn't gated or their score reaches the floor; else the best of the
    rejected ones is the answer, or none. The first attempt may fail; later ones may not."""
    best: Answer | None = None
    for k, (name, build) in enumerate(attempts):
        try:
            rows = [r.asDict(recursive=True) for r in build().take(most)]
        except Exception:
            if k:
                raise
            continue
        if not rows:
            continue
        if scorer is None or not STRATEGIES[name].gated:
            return Answer(name, rows)
        score = scorer(rows)
        if score >= floor:
            return Answer(name, rows, score)
        if best is None or score > best.score:
            best = Answer(name, rows, score)
    return best or Answer("none")
