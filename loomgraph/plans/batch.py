"""Answering a table of questions in one run: the questions' slots are a table that is joined with the graph.

Every question has a few attempts in order, as the engine plans them for one. Level by level, the attempts of the questions that have
no rows yet are gathered; questions that ask for the same share one plan; each kind of plan is one join of all its plans' parameters
with the graph. What a level answers takes no part in the next one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.expressions import ASKS_LOWEST, BOOKKEEPING, is_growth, name_contains, segment_of, usable_value, value_of
from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators import many
from loomgraph.operators.neighbourhood import DEFAULTS
from loomgraph.plans import routing
from loomgraph.plans import slots as S
from loomgraph.plans.engine import Engine
from loomgraph.storage import cut, small_or_not

#: What a question is answered by: its class, nodes, relations and so on. Null lists count as empty.
ASKED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("label", "mode", "first", "second", "metric")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("relations", "targets", "topics", "segments")]
    + [T.StructField("threshold", T.DoubleType()), T.StructField("lowest", T.BooleanType())]
)
#: The columns of an answer's row; each kind of query fills some of them.
ANSWER = {
    "edge_id": "long", "subject_id": "string", "subject_name": "string", "relationship": "string", "other_relationship": "string", "object_id": "string", "object_name": "string", "fact": "string",
    "attribute": "string", "text_value": "string", "value": "double", "average": "double", "n": "long",
}
#: Rows of a list of neighbours, of either side of a comparison, and of a list by topic: the limits of the single queries.
NEIGHBOURS, SIDE, LISTED = 50, 20, 50
#: What a value counts as where it is missing, and the bound where none is asked for, by the test.
_MISSING = {"atmost": 1.0, "atleast": 0.0, "approx": 0.5, "equal": 0.0}
_COUNTS = {f"F_CompCount{how.title()}": how for how in ("more", "less", "approx")} | {f"F_QuantCount{how.title()}": how for how in ("atmost", "atleast", "approx", "equal")}


def asked(questions: DataFrame, engine: Engine, question: str = "question") -> DataFrame:
    """questions with the columns of ASKED, from their texts: routed, linked and filled as the engine does it for one."""
    small = replace(engine, graph=None)  # names, aliases and keywords fit a task; the graph isn't needed there
    questions = questions.drop(*ASKED.names)
    lists = {f.name for f in ASKED if isinstance(f.dataType, T.ArrayType)}
    kinds = {"threshold": pa.float64(), "lowest": pa.bool_()} | {n: pa.list_(pa.string()) for n in lists}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ASKED.names}
            for q in batch.column(batch.schema.names.index(question)).to_pylist():
                label = routing.route(q or "")
                s = small.slots(q or "", label)
                made = vars(s) | {"label": label, "mode": S.mode(q or "", label, s), "lowest": re.search(ASKS_LOWEST, q or "") is not None}
                for n in out:
                    out[n].append(made[n])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[n], kinds.get(n, pa.string())) for n in out)], names=[*batch.schema.names, *out])

    return questions.mapInArrow(run, T.StructType([*questions.schema.fields, *ASKED.fields]))


def _attempts() -> Column:
    """The attempts (strategy, op) of a question in their order, as the engine plans them."""
    label, mode = F.coalesce("label", F.lit("")), F.coalesce("mode", F.lit(""))
    first, second = F.col("first").isNotNull(), F.col("second").isNotNull()
    metric, rels = F.length(F.coalesce("metric", F.lit(""))) > 0, F.size("relations") > 0
    step = lambda strategy, op: F.struct((strategy if isinstance(strategy, Column) else F.lit(strategy)).alias("strategy"), (op if isinstance(op, Column) else F.lit(op)).alias("op"))
    some = lambda *steps: F.filter(F.array(*[F.when(test, s) for test, s in steps]), lambda x: x.isNotNull())
    yes = F.lit(True)
    end = F.when(F.col("lowest"), "min").otherwise("max")
    by_topic = label.startswith("F_Quant") & mode.isin("global_ranking_max", "global_ranking_min")
    counts = F.lit(None)
    for name, how in _COUNTS.items():
        counts = F.when(label == name, F.lit(f"count_{how}")).otherwise(counts)
    compared = label.startswith("F_Comp") & ~label.contains("Count") & (label != "F_CompToGroupAverage")
    kinds = [
        ((label == "F_GlobalRank") & metric, some((yes, step(F.concat(F.lit("global_ranking_"), end), F.concat(F.lit("rank_"), end))))),
        ((label == "F_GroupAggregate") & metric & (F.size("segments") >= 2), some((yes, step("group_vs_group", "groups")))),
        ((label == "F_GroupAggregate") & metric, some((yes, step(F.concat(F.lit("group_rank_by_segment_"), end), "all_groups")))),
        ((label == "F_CompToGroupAverage") & metric & first, some((yes, step("comp_to_group_avg", "to_group")))),
        (compared & first & second, some((metric, step("compare_metric_named", "compared_named")), (rels | metric, step("compare_metric", "compared")), (yes, step("compare_pair", F.when(label == "F_CompApprox", "pair_approx").otherwise("pair"))))),
        (mode == "attribute_lookup_direct", some((yes, step(mode, "attributes")))),
        (mode == "list_companies_by_topic", some((yes, step(mode, "by_topic")))),
        ((label == "F_LogUnion") & first, some((yes, step("primary", "union")))),
        ((label == "F_LogIntersection") & first & second, some((yes, step("primary", "intersection")))),
        ((label == "F_LogDifference") & first & second, some((yes, step("primary", "difference")))),
        (label.isin("F_QuantMax", "F_QuantMin") & first, some((yes, step("primary", F.when(label == "F_QuantMax", "extreme_max").otherwise("extreme_min"))))),
        (label.isin("F_QuantAtmost", "F_QuantAtleast", "F_QuantApprox", "F_QuantEqual"), some((yes, step("primary", F.concat(F.lit("value_"), F.lower(F.substring(label, 8, 99))))))),
        (label.contains("Count"), some((yes, step("primary", F.coalesce(counts, F.lit("collected")))))),
    ]
    none = main = F.array().cast("array<struct<strategy:string,op:string>>")
    for test, steps in reversed(kinds):
        main = F.when(test, steps).otherwise(main)
    main = F.concat(F.when(by_topic, F.array(step(mode, F.concat(F.lit("topic_"), F.substring(mode, -3, 3))))).otherwise(none), main)
    near = some((F.size("targets") > 0, step("primary", "neighbours_to")), (yes, step("primary", "neighbours")))
    wider = F.array(step("relaxed_direction", "relaxed"), step("attribute_lookup", "attributes"))
    return F.when(first & (F.size(main) == 0), F.concat(near, wider)).when(first & label.isin("F_Simple", "F_LogUnion"), F.concat(main, wider)).otherwise(main)


#: The parameters that each kind of plan depends on; questions that agree in these share a plan.
_USES = {
    "neighbours_to": ("first", "relations", "targets"), "neighbours": ("first", "relations"), "relaxed": ("first",), "attributes": ("first",), "union": ("first", "second", "relations"),
    "intersection": ("first", "second", "relations"), "difference": ("first", "second", "relations"), "extreme_max": ("first", "relations"), "extreme_min": ("first", "relations"), "collected": ("relations",),
    "compared_named": ("first", "second", "relations", "metric"), "compared": ("first", "second", "relations"), "pair": ("first", "second"), "pair_approx": ("first", "second"), "by_topic": ("topics",),
    "rank_max": ("metric", "segments"), "rank_min": ("metric", "segments"), "topic_max": ("topics", "segments"), "topic_min": ("topics", "segments"), "groups": ("metric", "segments"), "all_groups": ("metric",),
    "to_group": ("first", "metric"),
    **{f"value_{how}": ("threshold", "relations") for how in _MISSING}, **{f"count_{how}": ("threshold", "relations") for how in DEFAULTS},
}
#: The kinds of plans that rank metrics' rows, and those that take their totals by segment.
_RANKED, _AVERAGED = ("rank_max", "rank_min", "topic_max", "topic_min"), ("groups", "all_groups", "to_group")
_PARAMETERS = ("first", "second", "relations", "targets", "topics", "segments", "metric", "threshold")


@dataclass
class Batch:
    """Answers tables of questions on a graph. kind: the type of what is asked about; segment_rel: the relation that tags a
    subject's segment; real: the names of real segments; known: segments of subjects by name."""

    graph: PropertyGraph
    kind: str = "COMPANY"
    segment_rel: str | None = None
    real: list[str] = field(default_factory=list)
    known: dict[str, str] = field(default_factory=dict)
    #: What the kinds of plans of a level share: the nodes that phrases name, and each phrase's totals by segment.
    named: DataFrame | None = None
    totals: DataFrame | None = None

    def answers(self, questions: DataFrame, query_id: str = "query_id") -> DataFrame:
        """(query_id, strategy, level and the columns of ANSWER) for a table with the columns of ASKED: the rows of each question's
        first attempt that has any, as the engine's cascade without a gate finds them. Questions that nothing answers, null ids
        and unknown classes without a first node have no rows; repeated questions count once."""
        lists = [f.name for f in ASKED if isinstance(f.dataType, T.ArrayType)]
        have = set(questions.columns)
        typed = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ASKED]
        q = questions.select(F.col(query_id).alias("_q"), *typed).filter("_q IS NOT NULL")
        q = q.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in lists}).withColumn("lowest", F.coalesce("lowest", F.lit(False)))
        tried = q.select("_q", *_PARAMETERS, F.posexplode(_attempts()).alias("level", "_step")).select("_q", "level", "_step.strategy", "_step.op", *_PARAMETERS)
        kept = [F.when(F.col("op").isin(*[op for op, uses in _USES.items() if p in uses]), F.col(p)).alias(p) for p in _PARAMETERS]
        tried = tried.select("_q", "level", "strategy", "op", *kept)
        tried = cut(tried.withColumn("plan", F.sha2(F.to_json(F.struct("op", *_PARAMETERS)), 256)).distinct())
        out, done = [], None
        for level in range(4):
            todo = tried.filter(F.col("level") == level)
            todo = cut(todo if done is None else todo.join(done, "_q", "left_anti"))
            ops = [r[0] for r in todo.select("op").distinct().collect()]  # kinds of queries, which the code numbers
            if not ops:
                break
            plans = cut(todo.select("plan", "op", *_PARAMETERS).dropDuplicates(["plan"]))
            mine = self._with_metrics(plans, ops)
            rows = [mine._rows(plans.filter(F.col("op") == op).drop("op"), op) for op in sorted(ops)]
            rows = cut(union_all([r.select("plan", *[(F.col(c) if c in r.columns else F.lit(None)).cast(t).alias(c) for c, t in ANSWER.items()]) for r in rows]))
            given = todo.select("_q", "strategy", "level", "plan")
            out.append(given.join(rows, "plan").drop("plan"))
            here = given.join(rows.select("plan").distinct(), "plan", "left_semi").select("_q")
            done = cut(here if done is None else done.unionByName(here))
        if not out:
            nothing = [F.lit(None).cast(t).alias(c) for c, t in {"strategy": "string", "level": "int", **ANSWER}.items()]
            return q.select(F.col("_q").alias(query_id), *nothing).limit(0)
        return union_all(out).withColumnRenamed("_q", query_id)

    def _with_metrics(self, plans: DataFrame, ops: list[str]) -> Batch:
        """This batch with what several kinds of plans about metrics need, found once for all of them."""
        phrase = F.when(F.col("op").startswith("topic_"), F.try_element_at("topics", F.lit(-1))).otherwise(F.col("metric"))
        ranked, averaged = (plans.filter(F.col("op").isin(*kinds)).select(phrase.alias("phrase")) for kinds in (_RANKED, _AVERAGED))
        if not {*_RANKED, *_AVERAGED} & {*ops}:
            return self
        out = replace(self, named=cut(self._named(ranked.union(averaged), True)))
        return replace(out, totals=cut(out._totals(averaged))) if {*_AVERAGED} & {*ops} else out

    def _rows(self, plans: DataFrame, op: str) -> DataFrame:
        stem, _, how = op.partition("_")
        if stem in ("extreme", "value", "count", "topic", "rank"):
            return getattr(self, f"_{stem}")(plans, how)
        run: Callable[[DataFrame], DataFrame] = getattr(self, f"_{op}")
        return run(plans)

    # -- facts at nodes -----------------------------------------------------------------------------------------------
    def _names(self, key: str, prefix: str) -> DataFrame:
        return self.graph.nodes.select(F.col("id").alias(key), F.col("name").alias(f"{prefix}_name"))

    def _at(self, plans: DataFrame, who: str, edges: DataFrame, rels: bool = True) -> DataFrame:
        """The edges whose source is a plan's node, of the plan's relations."""
        rows = edges.join(small_or_not(plans.select("plan", F.col(who).alias("src"), *(["relations"] if rels else []))), "src")
        return rows.filter((F.size("relations") == 0) | F.array_contains("relations", F.col("rel"))).drop("relations") if rels else rows

    def _facts(self, plans: DataFrame, who: str = "first", rels: bool = True) -> DataFrame:
        edges = self.graph.adjacency().withColumn("value", value_of(self.graph.edges.columns)).select("edge_id", "src", "dst", "rel", "fact", "value")
        subjects = plans.join(self._names(who, "subject"), who)
        rows = self._at(subjects, who, edges, rels).join(subjects.select("plan", "subject_name"), "plan").join(self._names("dst", "object"), "dst")
        return rows.select("plan", "edge_id", F.col("src").alias("subject_id"), "subject_name", F.col("rel").alias("relationship"), F.col("dst").alias("object_id"), "object_name", "fact", "value")

    @staticmethod
    def _best(rows: DataFrame, by: list, most: int) -> DataFrame:
        """The first rows of each plan."""
        return rows.withColumn("_k", F.row_number().over(Window.partitionBy("plan").orderBy(*by))).filter(F.col("_k") <= most).drop("_k")

    def _neighbours(self, plans: DataFrame) -> DataFrame:
        return self._best(self._facts(plans), ["object_name", "edge_id"], NEIGHBOURS)

    def _neighbours_to(self, plans: DataFrame) -> DataFrame:
        wanted = plans.select("plan", F.explode("targets").alias("object_id")).distinct()
        return self._best(self._facts(plans).join(wanted, ["plan", "object_id"], "left_semi"), ["object_name", "edge_id"], NEIGHBOURS)

    _TRIPLE = ("plan", "subject_name", "relationship", "object_id", "object_name", "fact")

    def _relaxed(self, plans: DataFrame) -> DataFrame:
        return self._facts(plans, rels=False).select(*self._TRIPLE).distinct()

    def _union(self, plans: DataFrame) -> DataFrame:
        both = self._facts(plans).unionByName(self._facts(plans.filter("second IS NOT NULL"), "second"))
        return both.select(*self._TRIPLE).distinct()

    def _intersection(self, plans: DataFrame) -> DataFrame:
        edges = self.graph.edges.select("edge_id", "src", "dst", "rel")
        a = self._at(plans, "first", edges).select("plan", "dst", F.col("rel").alias("relationship"), F.col("edge_id").alias("_a"))
        b = self._at(plans, "second", edges, False).select("plan", "dst", F.col("rel").alias("other_relationship"), F.col("edge_id").alias("_b"))
        rows = a.join(b, ["plan", "dst"]).filter("_a <> _b").join(self._names("dst", "object"), "dst")
        return rows.select("plan", F.col("dst").alias("object_id"), "object_name", "relationship", "other_relationship")

    def _difference(self, plans: DataFrame) -> DataFrame:
        mine = self._at(plans, "first", self.graph.edges.select("src", "dst", "rel"))
        theirs = self._at(plans, "second", self.graph.adjacency().select("src", "dst"), False).select("plan", "dst").distinct()
        rows = mine.join(theirs, ["plan", "dst"], "left_anti").join(self._names("dst", "object"), "dst")
        return rows.select("plan", F.col("dst").alias("object_id"), "object_name", F.col("rel").alias("relationship"))

    def _extreme(self, plans: DataFrame, how: str) -> DataFrame:
        edges = self.graph.adjacency().withColumn("value", value_of(self.graph.edges.columns, 1.0)).select("edge_id", "src", "dst", "rel", "fact", "value")
        key = F.struct("value", (-F.col("edge_id") if how == "max" else F.col("edge_id")).alias("_e"))
        best = (F.max_by if how == "max" else F.min_by)(F.struct("edge_id", "dst", "rel", "fact", "value"), key)
        rows = self._at(plans, "first", edges).groupBy("plan", "src").agg(best.alias("best")).select("plan", "src", "best.*")
        rows = rows.join(self._names("src", "subject"), "src").join(self._names("dst", "object"), "dst")
        return rows.select("plan", F.col("src").alias("subject_id"), "subject_name", F.col("rel").alias("relationship"), "object_name", "fact", "value")

    def _attributes(self, plans: DataFrame) -> DataFrame:
        if "props" not in self.graph.nodes.columns:
            return plans.select("plan").limit(0)
        held = F.map_filter("props", lambda k, v: ~k.isin(*BOOKKEEPING) & v.isNotNull() & (v != ""))
        rows = self.graph.nodes.select("id", "name", "props").join(small_or_not(plans.select("plan", F.col("first").alias("id"))), "id")
        return rows.select("plan", F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), F.explode(held).alias("attribute", "text_value"))

    def _sides(self, plans: DataFrame, named: bool) -> DataFrame:
        sides = []
        for who in ("first", "second"):
            rows = self._facts(plans, who).select(*self._TRIPLE).distinct()
            if named:
                rows = rows.join(plans.select("plan", "metric"), "plan").filter(name_contains(F.col("object_name"), F.col("metric"))).drop("metric")
            sides.append(self._best(rows, ["object_name", "relationship", "object_id", "fact"], SIDE))
        return union_all(sides)

    def _compared(self, plans: DataFrame) -> DataFrame:
        return self._sides(plans, False)

    def _compared_named(self, plans: DataFrame) -> DataFrame:
        also = F.array(*map(F.lit, S.METRIC_ALSO))
        wider = F.when(F.size("relations") > 0, F.array_union("relations", also)).otherwise(F.col("relations"))
        return self._sides(plans.withColumn("relations", wider), True)

    def _pair(self, plans: DataFrame, approx: bool = False) -> DataFrame:
        pairs = plans.select("plan", F.col("first").alias("a"), F.col("second").alias("b"))
        rows = many.compare_pairs(self.graph, pairs.select("a", "b"), approx=approx).join(pairs, ["a", "b"])
        return rows.select("plan", F.col("a").alias("subject_id"), F.col("b").alias("object_id"), F.col("hops").alias("n"))

    def _pair_approx(self, plans: DataFrame) -> DataFrame:
        return self._pair(plans, True)

    # -- values and counts over all subjects --------------------------------------------------------------------------
    def _by_rel(self, plans: DataFrame) -> DataFrame:
        """plans with a row for each relation that they take: those that they name, else all that the graph has."""
        every = [r[0] for r in self.graph.edges.select("rel").distinct().collect()]  # an ontology's relations
        rels = F.when(F.size("relations") > 0, F.array_distinct("relations")).otherwise(F.array(*map(F.lit, every)).cast("array<string>"))
        return small_or_not(plans.select("plan", "threshold", F.explode(rels).alias("rel")))

    def _value(self, plans: DataFrame, how: str) -> DataFrame:
        found = [F.col(c) for c in ("share", "weight") if c in self.graph.edges.columns]
        edges = self.graph.edges.select("edge_id", "src", "dst", "rel", (F.coalesce(*found) if found else F.lit(None).cast("double")).alias("value"))
        t, v = F.coalesce("threshold", F.lit(_MISSING[how])), F.coalesce("value", F.lit(_MISSING[how]))
        test = {"atmost": v <= t, "atleast": v >= t, "approx": v.between(t - 0.1, t + 0.1), "equal": v == t}[how]
        rows = edges.join(self._by_rel(plans), "rel").filter(test).join(self._names("src", "subject"), "src").join(self._names("dst", "object"), "dst")
        return rows.select("plan", "edge_id", "subject_name", F.col("rel").alias("relationship"), "object_name", "value")

    def _count(self, plans: DataFrame, how: str) -> DataFrame:
        each = self.graph.edges.groupBy("src", "rel").agg(F.count(F.lit(1)).alias("_n"))
        rows = each.join(self._by_rel(plans), "rel").groupBy("plan", "threshold", "src").agg(F.sum("_n").alias("n"))
        t, n = F.coalesce("threshold", F.lit(DEFAULTS[how]).cast("double")), F.col("n")
        test = {"more": n > t, "less": n < t, "approx": n.between(t - 1, t + 1), "atmost": n <= t, "atleast": n >= t, "equal": n == t}[how]
        return rows.filter(test).join(self._names("src", "subject"), "src").select("plan", F.col("src").alias("subject_id"), "subject_name", "n")

    def _collected(self, plans: DataFrame) -> DataFrame:
        """The numbers of neighbours; their facts are what a question about one of them gives."""
        objects = self.graph.nodes.select(F.col("id").alias("dst"))
        each = self.graph.adjacency().join(objects, "dst", "left_semi").groupBy("src", "rel").agg(F.count(F.lit(1)).alias("_n"))
        rows = each.join(self._by_rel(plans), "rel").groupBy("plan", "src").agg(F.sum("_n").alias("n"))
        return rows.join(self._names("src", "subject"), "src").select("plan", F.col("src").alias("subject_id"), "subject_name", "n")

    # -- names that hold a phrase -------------------------------------------------------------------------------------
    def _named(self, phrases: DataFrame, either: bool) -> DataFrame:
        """(phrase, id, name) of the nodes whose name holds the phrase; with either also those whose name the phrase holds, and the
        phrase without ' ratio'. Texts that hold one another share the shorter one's first three letters as a run, so this is a join
        on runs of letters, then checked."""
        runs = lambda text: F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.array(*[F.substring(text, i, F.lit(k)) for k in (1, 2, 3)])))))
        low_name, low = F.lower("name"), F.lower("phrase")
        phrases = phrases.select("phrase").dropna().distinct()
        nodes = self.graph.nodes.select("id", "name").filter("name IS NOT NULL")
        starts = F.array_distinct(F.array(F.substring(low, 1, 3), F.substring(F.replace(low, F.lit(" ratio"), F.lit("")), 1, 3)) if either else F.array(F.substring(low, 1, 3)))
        held = nodes.select("id", "name", F.explode(runs(low_name)).alias("run")).join(small_or_not(phrases.select("phrase", F.explode(starts).alias("run"))), "run")
        if either:
            holding = phrases.select("phrase", F.explode(runs(low)).alias("run"))
            held = held.unionByName(nodes.select("id", "name", F.substring(low_name, 1, 3).alias("run")).join(small_or_not(holding), "run").select(*held.columns))
        test = name_contains(F.col("name"), F.col("phrase"), ratio=True) if either else low_name.contains(low)
        return held.filter(test).select("phrase", "id", "name").distinct()

    def _by_topic(self, plans: DataFrame) -> DataFrame:
        asked_for = plans.select("plan", F.explode("topics").alias("phrase")).distinct()
        objects = self._named(asked_for, False).select("phrase", F.col("id").alias("dst"), F.col("name").alias("object_name"))
        subjects = self.graph.of_type(self.kind).select(F.col("id").alias("src"), F.col("name").alias("subject_name"))
        rows = self.graph.adjacency().select("src", "dst", F.col("rel").alias("relationship")).join(small_or_not(objects), "dst").join(subjects, "src").join(small_or_not(asked_for), "phrase")
        return self._best(rows.select("plan", "subject_name", "relationship", "object_name").distinct(), ["subject_name", "object_name", "relationship"], LISTED)

    # -- metrics ------------------------------------------------------------------------------------------------------
    def _metrics(self, phrases: DataFrame, about: DataFrame | None = None) -> DataFrame:
        """ranking.metric_rows for all phrases at once, with the phrase; about: (src), the only subjects that are wanted."""
        g = self.graph
        phrases = phrases.select("phrase").dropna().distinct()
        named = self._named(phrases, True) if self.named is None else self.named.join(small_or_not(phrases), "phrase", "left_semi")
        objects = named.select("phrase", F.col("id").alias("dst"), F.col("name").alias("object_name"))
        subjects = g.of_type(self.kind).select(F.col("id").alias("src"), F.col("name").alias("subject_name"))
        rows = g.adjacency().filter(~is_growth(F.col("fact"))).withColumn("value", usable_value(value_of(g.edges.columns), F.col("fact"))).filter("value IS NOT NULL")
        if about is not None:
            rows, subjects = (df.join(small_or_not(about.distinct()), "src", "left_semi") for df in (rows, subjects))
        rows = rows.select("edge_id", "src", "dst", "fact", "value").join(small_or_not(objects), "dst").join(small_or_not(subjects), "src")
        segment = F.lit(None).cast("string")
        if self.segment_rel:
            tags = g.with_rel(self.segment_rel).select("edge_id", "src", "dst").join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("tag")), "dst")
            tags = (tags.filter(F.col("tag").isin(*self.real)) if self.real else tags).groupBy("src").agg(F.min_by("tag", "edge_id").alias("tag"))
            rows = rows.join(tags, "src", "left")
            segment = segment_of(F.col("subject_name"), F.col("tag"), self.real, self.known) if self.real else F.col("tag")
        return rows.select("phrase", "edge_id", F.col("src").alias("subject_id"), "subject_name", F.col("dst").alias("_dst"), "value", segment.alias("segment"))

    def _firsts(self, phrases: DataFrame, about: DataFrame | None = None) -> DataFrame:
        return self._metrics(phrases, about).filter("segment IS NOT NULL").groupBy("phrase", "segment", "subject_id").agg(F.min_by("value", "edge_id").alias("value"))

    def _totals(self, phrases: DataFrame) -> DataFrame:
        """(phrase, segment, mean, total, n) over one value for each subject."""
        value = F.col("value")
        return self._firsts(phrases).groupBy("phrase", "segment").agg(F.round(F.avg(value), 2).alias("mean"), F.sum(value.cast("decimal(30,8)")).alias("total"), F.count(F.lit(1)).alias("n"))

    def _rank(self, plans: DataFrame, how: str) -> DataFrame:
        """The best row of each plan, whose fact and names are looked up when it is known."""
        wanted = plans.select("plan", F.col("metric").alias("phrase"), F.get("segments", F.lit(0)).alias("_segment"))
        rows = self._metrics(wanted).join(small_or_not(wanted), "phrase").filter(F.col("_segment").isNull() | (F.col("segment") == F.col("_segment")))
        key = F.struct("value", (-F.col("edge_id") if how == "max" else F.col("edge_id")).alias("_e"))
        best = (F.max_by if how == "max" else F.min_by)(F.struct("edge_id", F.col("subject_id").alias("src"), F.col("_dst").alias("dst"), "value"), key)
        best = small_or_not(cut(rows.groupBy("plan").agg(best.alias("best")).select("plan", "best.*")))
        facts = self.graph.adjacency().select("edge_id", "src", "dst", "fact").join(best, ["edge_id", "src", "dst"])
        facts = facts.join(self._names("src", "subject"), "src").join(self._names("dst", "object"), "dst")
        return facts.select("plan", F.col("src").alias("subject_id"), "subject_name", "object_name", "fact", "value")

    def _topic(self, plans: DataFrame, how: str) -> DataFrame:
        """Ranks all subjects by the second node's words, whatever the first one is."""
        return self._rank(plans.withColumn("metric", F.try_element_at("topics", F.lit(-1))), how)

    def _averages(self, plans: DataFrame) -> DataFrame:
        wanted = plans.select("plan", F.col("metric").alias("phrase"), "segments")
        return self.totals.select("phrase", "segment", F.col("mean").alias("value"), "n").join(wanted, "phrase")

    def _groups(self, plans: DataFrame) -> DataFrame:
        return self._averages(plans).filter(F.array_contains("segments", F.col("segment"))).select("plan", F.col("segment").alias("subject_name"), "value", "n")

    def _all_groups(self, plans: DataFrame) -> DataFrame:
        return self._averages(plans).select("plan", F.col("segment").alias("subject_name"), "value", "n")

    def _to_group(self, plans: DataFrame) -> DataFrame:
        wanted = plans.select("plan", F.col("metric").alias("phrase"), F.col("first").alias("subject_id"))
        firsts = self._firsts(wanted, wanted.select(F.col("subject_id").alias("src")))
        totals = self.totals.select("phrase", "segment", F.col("total").alias("_total"), (F.col("n") - 1).alias("n"))
        own = firsts.join(wanted, ["phrase", "subject_id"]).join(totals, ["phrase", "segment"])
        mean = F.when(F.col("n") > 0, F.round((F.col("_total").cast("double") - F.col("value")) / F.col("n"), 2))
        return own.select("plan", "subject_id", F.col("segment").alias("object_name"), "value", mean.alias("average"), "n")
