"""Linking questions to nodes: mentions of names and aliases, spans that block others, merging of matches, and both passes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import expressions as X
from loomgraph.storage import cut, small_or_not

#: Sources of a match, best first.
PRIORITY = ["gazetteer", "alias", "semantic"]
#: Letters that a name needs to be looked for.
LEAST = 3
# Similarities of matches by name and by alias.
BY_NAME, BY_ALIAS = 1.0, 0.99
#: What a name or a question is cut into for the candidate join.
TOKEN = r"\w+|[^\w\s]"


def find_mentions(text: str | None, names: re.Pattern | None) -> list[str]:
    return [m[0].lower() for m in names.finditer(text or "")] if names else []


def gazetteer(names: list[str]) -> re.Pattern | None:
    """One pattern that prefers longer names and takes no part of a word; matches never overlap."""
    known = sorted({n for n in names if len(n) >= LEAST}, key=lambda n: (-len(n), n))
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, known)) + r")(?!\w)", re.I) if known else None


def mentions(questions: DataFrame, text: str, names: list[str], out: str = "mentions") -> DataFrame:
    """questions with the names that each mentions, in the order of the text. names is a gazetteer that fits one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = gazetteer(names)
        for b in batches:
            found = pa.array([find_mentions(t.as_py(), pattern) for t in b.column(b.schema.names.index(text))], type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, out])

    return questions.mapInArrow(run, T.StructType([*questions.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


# -- a table of questions against a table of names --------------------------------------------------------------------
def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def candidate_mentions(questions: DataFrame, names: DataFrame, question_id: str = "query_id", text: str = "text", node_id: str = "id", name: str = "name") -> DataFrame:
    """(question_id, start, length, node_id, name): the names, or their variants, that each question holds as whole tokens in any
    case, in token places. The questions' runs of tokens are joined with the names by equality, so neither side has to fit a
    task; of equal names the least id stands. Longer names win, and what overlaps a winner is left out."""
    spelled = names.filter(F.length(name) >= LEAST).select(F.col(node_id).alias("_id"), F.col(name).alias("_name"), F.explode(X.name_variants(F.col(name))).alias("_variant"))
    spelled = spelled.select("_id", "_name", _tokens(F.col("_variant")).alias("_t")).filter(F.size("_t") > 0)
    keys = spelled.groupBy(F.array_join("_t", " ").alias("_key"), F.size("_t").alias("_n")).agg(F.min(F.struct("_id", "_name")).alias("_node"))
    keys = cut(keys)
    longest = keys.agg(F.max("_n")).first()[0] or 0
    asked = questions.select(F.col(question_id).alias("_q"), _tokens(F.col(text)).alias("_t"))
    at = asked.select("_q", "_t", F.explode(F.sequence(F.lit(1), F.size("_t"))).alias("_s")).filter(F.size("_t") > 0) if longest else asked.withColumn("_s", F.lit(1)).limit(0)
    runs = at.select("_q", "_s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_t") - F.col("_s") + 1))).alias("_n"), "_t")
    runs = runs.select("_q", "_s", "_n", F.array_join(F.slice("_t", F.col("_s"), F.col("_n")), " ").alias("_key"))
    # Neither side is broadcast by an estimate: a question's runs are many times what its row promises.
    hits = runs.hint("merge").join(small_or_not(keys), ["_key", "_n"])
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("_key")).alias("rank"), F.col("_s").alias("start"), F.col("_n").alias("length"), F.col("_node").alias("node"))))
    each = hits.groupBy("_q").agg(ordered.alias("_c"))
    apart = lambda a, b: (a["start"] + a["length"] <= b["start"]) | (b["start"] + b["length"] <= a["start"])
    none = F.filter("_c", lambda c: F.lit(False))
    kept = F.aggregate("_c", none, lambda won, c: F.when(F.forall(won, lambda w: apart(w, c)), F.concat(won, F.array(c))).otherwise(won))
    rows = each.select("_q", F.explode(kept).alias("m"))
    return rows.select(F.col("_q").alias(question_id), (F.col("m.start") - 1).alias("start"), F.col("m.length").alias("length"), F.col("m.node._id").alias(node_id), F.col("m.node._name").alias(name))


def unblocked(spans: DataFrame, occupied: DataFrame, question: str = "query_id") -> DataFrame:
    """The spans (question, start, end) that overlap no occupied one of the same question."""
    held = occupied.select(F.col(question).alias("_q"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return spans.join(held, (F.col(question) == F.col("_q")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left_anti")


def merge_matches(matches: DataFrame, question: str = "query_id") -> DataFrame:
    """One match for each question and node, from its best source; by similarity, equal ones by position and id."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source")), F.lit(0)), F.lit(len(PRIORITY) + 1))
    best = Window.partitionBy(question, "matched_id").orderBy(rank, F.col("similarity").desc(), "position")
    return matches.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k").orderBy(question, F.col("similarity").desc(), "position", "matched_id")


def without_generic(matches: DataFrame, text: str, phrases: dict[str, str], name: str = "matched_node_name") -> DataFrame:
    """matches less those of a node whose name is only part of a generic phrase of the question: phrase -> the node's name."""
    false = F.lit(False)
    for phrase, node in phrases.items():
        false = false | (F.col(text).rlike(rf"(?i)\b{X.quoted_pattern(phrase)}\b") & (F.col(name) == node))
    return matches.filter(~F.coalesce(false, F.lit(False)))


# -- company names of sources -----------------------------------------------------------------------------------------
def company_words(name: Column) -> Column:
    """A company's name in lower-case words, without article and legal form."""
    bare = F.lower(name)
    for noise in ("limited", "ltd", "the "):
        bare = F.replace(bare, F.lit(noise), F.lit(""))
    return F.filter(F.split(F.regexp_replace(bare, "[^a-z ]", " "), r"\s+"), lambda w: w != "")


def _rarest(sets: DataFrame, others: DataFrame) -> DataFrame:
    """sets (_ws) with _w, the word of each that the fewest of the others have; less those with a word that none has."""
    often = others.select(F.explode(F.array_distinct("_ws")).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
    each = sets.select("_ws", F.explode(F.array_distinct("_ws")).alias("_w")).join(often, "_w")
    found = each.groupBy("_ws").agg(F.min(F.struct("_df", "_w")).alias("_r"), F.count(F.lit(1)).alias("_known"))
    return found.filter(F.col("_known") == F.size(F.array_distinct("_ws"))).select("_ws", F.col("_r._w").alias("_w"))


def _held_pairs(ms: DataFrame, ns: DataFrame) -> DataFrame:
    """(_mw, _nw): of two tables of words (_ws) the pairs of which one may hold all words of the other. Who does holds its rarest
    one, so each side is joined by its rarest words with all words of the other."""
    all_of = lambda df: df.select(F.col("_ws").alias("_other"), F.explode(F.array_distinct("_ws")).alias("_w"))
    inside = _rarest(ms, ns).hint("merge").join(all_of(ns), "_w").select(F.col("_ws").alias("_mw"), F.col("_other").alias("_nw"))
    around = _rarest(ns, ms).hint("merge").join(all_of(ms), "_w").select(F.col("_other").alias("_mw"), F.col("_ws").alias("_nw"))
    return inside.unionByName(around)


def matched_companies(mentions: DataFrame, names: DataFrame, mention: str = "mention", name: str = "name") -> DataFrame:
    """mentions with matched, the name whose words are the same, else the best of those that hold all words of the mention or
    that the mention holds all words of: a word in common counts 1, each word more or less takes 0.5, and it must be worth
    more than nothing. Of equal ones the first by name. Mentions and names of the same words are looked at once, and only pairs
    that share the rarest word of either side are made."""
    said = mentions.select(F.col(mention).alias("_m")).distinct().withColumn("_ws", company_words(F.col("_m")))
    n = names.select(F.col(name).alias("_n")).distinct().withColumn("_ws", company_words(F.col("_n"))).groupBy("_ws").agg(F.min("_n").alias("_n"))
    ms, ns = cut(said.select("_ws").distinct()), cut(n)
    m, k = F.size("_mw"), F.size("_nw")
    shared = F.size(F.array_intersect("_mw", "_nw"))
    score = F.when(F.col("_mw") == F.col("_nw"), F.lit(1e9)).when(shared == F.least(m, k), shared - 0.5 * F.abs(m - k))
    near = _held_pairs(ms, ns).withColumn("_score", score).filter("_score > 0")
    ranked = near.join(ns.withColumnRenamed("_ws", "_nw").hint("merge"), "_nw").groupBy(F.col("_mw").alias("_ws")).agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_n"))).alias("_best"))
    best = said.join(ranked.hint("merge"), "_ws").select(F.col("_m").alias(mention), F.col("_best._n").alias("matched"))
    return mentions.join(best, mention, "left")


def match_company(mention: str, names: list[str]) -> str | None:
    """The same for one mention and a few names."""

    def words(name: str) -> list[str]:
        name = name.lower()
        for noise in ("limited", "ltd", "the "):
            name = name.replace(noise, "")
        return re.sub("[^a-z ]", " ", name).split()

    wanted, best = words(mention), (0.0, None)
    for name in sorted(set(names)):
        held = words(name)
        shared = len({*wanted} & {*held})
        score = 1e9 if held == wanted else shared - 0.5 * abs(len(wanted) - len(held)) if shared and shared == min(len(wanted), len(held)) else 0.0
        best = max(best, (score, name), key=lambda b: b[0])
    return best[1]


# -- one question -----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Match:
    """What a question says, and the node that is meant. start and end are None where the words aren't in the question."""

    entity: str
    id: str
    type: str
    name: str
    similarity: float = BY_NAME
    source: str = "gazetteer"
    start: int | None = None
    end: int | None = None


def _variants(name: str) -> list[str]:
    bare = re.sub(r"(?i)^\s*the\s+", "", re.sub(r"(?i)\s+(?:limited|ltd\.?|pvt\.?\s*ltd\.?)\s*$", "", name))
    return [name, bare] if bare != name and len(bare) >= LEAST and len(bare.split()) >= 2 else [name]


class Names:
    """Names and variants of nodes for lookups in single questions: name -> (id, type)."""

    def __init__(self, nodes: dict[str, tuple[str, str]], source: str = "gazetteer", similarity: float = BY_NAME, variants: bool = True):
        self.source, self.similarity = source, similarity
        self.of: dict[str, tuple[str, str, str]] = {}
        for name, (i, kind) in sorted(nodes.items(), key=lambda n: (-len(n[0]), n[0])):
            for variant in _variants(name) if variants else [name]:
                self.of.setdefault(variant.lower(), (name, i, kind))
        self.pattern = gazetteer(list(self.of))

    def find(self, question: str) -> list[Match]:
        found = []
        for m in self.pattern.finditer(question) if self.pattern else ():
            name, i, kind = self.of[m[0].lower()]
            found.append(Match(m[0], i, kind, name, self.similarity, self.source, *m.span()))
        return found


def merged(*groups: Iterable[Match]) -> list[Match]:
    """One match for each node, from its best source, the most similar first; equal ones keep their order."""
    best: dict[str, Match] = {}
    for m in (m for group in groups for m in group):
        if m.id not in best or PRIORITY.index(m.source) < PRIORITY.index(best[m.id].source):
            best[m.id] = replace(m)
    return sorted(best.values(), key=lambda m: -m.similarity)


@dataclass
class Resolver:
    """names and aliases of nodes; spans(question) gives further (start, end, words) that may be entities, and
    similar(words, types) the node that they are most like, of the preferred types first. Both are optional. generic: phrases
    that aren't the node of the name behind them."""

    names: Names
    aliases: Names | None = None
    spans: Callable[[str], Iterable[tuple[int, int, str]]] | None = None
    similar: Callable[[str, set[str]], Match | None] | None = None
    generic: dict[str, str] | None = None

    def exact(self, question: str) -> list[list[Match]]:
        return [self.names.find(question), self.aliases.find(question) if self.aliases else []]

    def resolve(self, question: str, types: Iterable[str] = ()) -> list[Match]:
        """The first pass: names, aliases, and what spans that touch neither are like."""
        exact = self.exact(question)
        taken = [(m.start, m.end) for group in exact for m in group]
        said = {m.entity.lower() for group in exact for m in group}
        alike = []
        for a, b, words in self.spans(question) if self.spans and self.similar else ():
            if words.lower() not in said and all(b <= x or y <= a for x, y in taken):
                m = self.similar(words, set(types))
                alike += [replace(m, entity=words, source="semantic", start=a, end=b)] if m else []
        return self._real(question, merged(*exact, alike))

    def enrich(self, question: str, matches: list[Match], needed: Iterable[str]) -> list[Match]:
        """The second pass: names and aliases of the types that the question's class needs and that are still missing."""
        known, needed = {m.id for m in matches}, set(needed)
        more = [m for group in reversed(self.exact(question)) for m in group if m.id not in known and (not needed or m.type in needed)]
        return self._real(question, merged(matches, more)) if more else matches

    def _real(self, question: str, matches: list[Match]) -> list[Match]:
        false = {node for phrase, node in (self.generic or {}).items() if re.search(rf"\b{re.escape(phrase)}\b", question, re.I)}
        return [m for m in matches if m.name not in false]


_MATCHES = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("source", T.StringType())]))


def resolved(questions: DataFrame, text: str, resolver: Resolver, needed: Iterable[str] = (), out: str = "matches") -> DataFrame:
    """questions with the matches that both passes find in each, in their order. The resolver's names fit a task; for a table
    of names of any size see candidate_mentions()."""
    needed = list(needed)
    questions = questions.drop(out)
    fields = [f.name for f in _MATCHES.elementType]
    arrow = pa.list_(pa.struct([(f, pa.float64() if f == "similarity" else pa.string()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for q in b.column(b.schema.names.index(text)).to_pylist():
                matches = resolver.enrich(q or "", resolver.resolve(q or "", needed), needed)
                found.append([{f: getattr(m, f) for f in fields} for m in matches])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, arrow)], names=[*b.schema.names, out])

    return questions.mapInArrow(run, T.StructType([*questions.schema.fields, T.StructField(out, _MATCHES)]))
