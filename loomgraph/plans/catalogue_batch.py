"""Queries over tables of questions: each answers all of them in one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.plans import routing
from loomgraph.plans.batch import ANSWER, Batch
from loomgraph.plans.catalogue import _USABLE, REGIONS, query
from loomgraph.plans.testgraph import table, testgraph

_SQL_KIND = {"long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}


def _row(strategy: str, level: str, **given: str) -> str:
    """The select list of an answer's row: the given columns, all others null."""
    columns = [f"CAST({given[c]} AS {_SQL_KIND[t]}) AS {c}" if c in given else f"CAST(NULL AS {_SQL_KIND[t]}) AS {c}" for c, t in ANSWER.items()]
    return f"query_id, '{strategy}' AS strategy, CAST({level} AS INTEGER) AS level, {', '.join(columns)}"


def _case(values: list) -> Column:
    """The value that a question's kind gives."""
    out = F.lit(None)
    for k, v in enumerate(values):
        out = F.when(F.col("kind") == k, v).otherwise(out)
    return out


def _words(*words: str) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


# -- about customers --------------------------------------------------------------------------------------------------
_FACT = {"subject_name": "a.name", "relationship": "rel", "object_id": "dst", "object_name": "b.name", "fact": "fact"}
_NAMED = "JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst"
_ONE = {**_FACT, "edge_id": "edge_id", "subject_id": "src", "value": "coalesce(value, share)"}
_EXTREME = {"subject_id": "src", "subject_name": "a.name", "relationship": "rel", "object_name": "b.name", "fact": "fact", "value": "v"}


def _side(who: str) -> str:
    return f"""SELECT {_row('compare_metric', '0', subject_name='s', relationship='rel', object_id='dst', object_name='o', fact='fact')} FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, rel, dst, fact NULLS FIRST) AS k FROM (SELECT DISTINCT query_id, a.name AS s, rel, dst, b.name AS o, fact FROM q JOIN adj ON src = {who} AND rel IN ('ORDERED', 'LOCATED_IN') {_NAMED} WHERE kind = 8)) WHERE k <= 20"""


@query(
    f"""+ q AS (SELECT c_custkey AS query_id, c_custkey % 9 AS kind, 'C' || c_custkey AS first, CASE c_custkey % 9 WHEN 7 THEN 'N' || (c_custkey % 25) ELSE 'C' || (c_custkey * 7 % 1000 + 1) END AS second FROM customer),
near(src, dst) AS (SELECT DISTINCT src, dst FROM adj WHERE src <> dst),
walk(source, id, hops) AS (SELECT second, second, 0 FROM q WHERE kind = 7 UNION SELECT source, dst, hops + 1 FROM walk JOIN near ON src = walk.id WHERE hops < 8),
far AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY ALL),
valued AS (SELECT query_id, kind, adj.*, coalesce(value, share, 1.0) AS v FROM q JOIN adj ON src = first WHERE kind = 4 AND rel = 'ORDERED' OR kind = 5)
---
SELECT {_row('primary', '0', **_ONE)} FROM (SELECT * FROM q JOIN adj ON src = first WHERE kind = 0 AND rel = 'LOCATED_IN') {_NAMED}
UNION ALL SELECT DISTINCT {_row('primary', '0', **_FACT)} FROM q JOIN adj ON src IN (first, second) {_NAMED} WHERE kind = 1 AND rel = 'BELONGS_TO_SEGMENT'
UNION ALL SELECT {_row('primary', '0', object_id='x.dst', object_name='b.name', relationship='x.rel', other_relationship='y.rel')} FROM q JOIN edges x ON x.src = first AND x.rel = 'ORDERED' JOIN edges y ON y.src = second AND y.dst = x.dst AND y.edge_id <> x.edge_id JOIN nodes b ON b.id = x.dst WHERE kind = 2
UNION ALL SELECT {_row('primary', '0', object_id='x.dst', object_name='b.name', relationship='x.rel')} FROM q JOIN edges x ON x.src = first AND x.rel = 'ORDERED' JOIN nodes b ON b.id = x.dst WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM adj y WHERE y.src = second AND y.dst = x.dst)
UNION ALL SELECT {_row('primary', '0', **_EXTREME)} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 4 THEN -v ELSE v END, edge_id) AS k FROM valued) {_NAMED} WHERE k = 1
UNION ALL SELECT DISTINCT {_row('relaxed_direction', '1', **_FACT)} FROM q JOIN adj ON src = first {_NAMED} WHERE kind = 6
UNION ALL SELECT {_row('compare_pair', '0', subject_id='first', object_id='second', n='hops')} FROM q JOIN far ON source = second AND id = first WHERE kind = 7 AND hops > 0
UNION ALL {_side('first')} UNION ALL {_side('second')}""",
    "nodes", "edges", "adj", recursive=True,
)
def questions_answered(spark, sf_dir):
    """A question about every customer, of nine classes: neighbours, sets of two, extremes, comparisons, and one whose own query
    finds nothing."""
    c = F.col("c_custkey")
    labels = ["F_Simple", "F_LogUnion", "F_LogIntersection", "F_LogDifference", "F_QuantMax", "F_QuantMin", "F_Simple", "F_CompMore", "F_CompMore"]
    rels = [["LOCATED_IN"], ["BELONGS_TO_SEGMENT"], ["ORDERED"], ["ORDERED"], ["ORDERED"], [], ["OWNS"], [], ["ORDERED", "LOCATED_IN"]]
    q = table(spark, sf_dir, "customer").select(c.alias("query_id"), (c % 9).alias("kind"), F.concat(F.lit("C"), c.cast("string")).alias("first"))
    other = F.concat(F.lit("C"), (F.col("query_id") * 7 % 1000 + 1).cast("string"))
    second = F.when(F.col("kind") == 7, F.concat(F.lit("N"), (F.col("query_id") % 25).cast("string"))).when(~F.col("kind").isin(0, 4, 5, 6), other)
    q = q.withColumns({"label": _case([F.lit(x) for x in labels]), "relations": _case([_words(*x) for x in rels]), "second": second})
    return Batch(testgraph(spark, sf_dir), "CUSTOMER").answers(q)


# -- over all subjects ------------------------------------------------------------------------------------------------
_COUNTED = "SELECT src, name, count(*) FILTER (WHERE rel = 'ORDERED') AS o, count(*) FILTER (WHERE rel IN ('ORDERED', 'SUPPLIES')) AS b FROM edges JOIN nodes ON id = src GROUP BY ALL"
_SHARED = f"SELECT edge_id, a.name AS s, rel, b.name AS o, share FROM supplies {_NAMED}"


@query(
    f"""+ q AS (SELECT n_nationkey AS query_id, n_nationkey % 5 AS kind, n_nationkey AS k FROM nation), counted AS ({_COUNTED}), shared AS ({_SHARED})
---
SELECT {_row('primary', '0', subject_id='src', subject_name='name', n='CASE kind WHEN 2 THEN b ELSE o END')} FROM q JOIN counted ON kind = 0 AND o >= 40 + k AND o > 0 OR kind = 1 AND o BETWEEN k + 19 AND k + 21 OR kind = 2 AND b = k + 10
UNION ALL SELECT {_row('primary', '0', edge_id='edge_id', subject_name='s', relationship='rel', object_name='o', value='share')} FROM q JOIN shared ON kind = 3 AND share >= 0.6 OR kind = 4 AND share = 0.5""",
    "nodes", "edges",
)
def questions_counted(spark, sf_dir):
    """A question for every nation about all subjects: how many of a relation they have, or values beyond a bound."""
    labels = ["F_QuantCountAtleast", "F_CompCountApprox", "F_QuantCountEqual", "F_QuantAtleast", "F_QuantEqual"]
    rels = [["ORDERED"], ["ORDERED"], ["ORDERED", "SUPPLIES"], ["SUPPLIES"], ["SUPPLIES"]]
    k = F.col("query_id")
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), (F.col("n_nationkey") % 5).alias("kind"))
    bounds = [k + 40, k + 20, k + 10, F.lit(0.6), F.lit(0.5)]
    q = q.withColumns({"label": _case([F.lit(x) for x in labels]), "relations": _case([_words(*x) for x in rels]), "threshold": _case([b.cast("double") for b in bounds])})
    return Batch(testgraph(spark, sf_dir)).answers(q)


_HOLDS = "(contains(lower(p_name), lower(word)) OR contains(lower(word), lower(p_name)) OR contains(lower(p_name), replace(lower(word), ' ratio', '')))"


@query(
    _USABLE.replace("---", f""", q AS (SELECT DISTINCT split_part(p_name, ' ', 2) || ' Ratio' AS word FROM part), asked AS (SELECT unnest(['rank ', 'groups ', 'two ', 'own ']) || word AS query_id, word FROM q),
held AS (SELECT word, edge_id, src, s_name, p_name, fact, v, segment FROM q JOIN part ON {_HOLDS} JOIN tagged ON dst = 'P' || p_partkey JOIN supplier ON src = 'S' || s_suppkey),
one AS (SELECT word, segment, src, arg_min(v, edge_id) AS v FROM held GROUP BY ALL), sums AS (SELECT word, segment, round(avg(v), 2) AS mean, sum(CAST(v AS DECIMAL(30, 8))) AS t, count(*) AS m FROM one GROUP BY ALL)
---""")
    + f"""SELECT {_row('global_ranking_max', '0', subject_id='src', subject_name='s_name', object_name='p_name', fact='fact', value='v')} FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY v DESC, edge_id) AS k FROM held) JOIN asked USING (word) WHERE k = 1 AND query_id LIKE 'rank %'
UNION ALL SELECT {_row('group_rank_by_segment_max', '0', subject_name='segment', value='mean', n='m')} FROM sums JOIN asked USING (word) WHERE query_id LIKE 'groups %'
UNION ALL SELECT {_row('group_vs_group', '0', subject_name='segment', value='mean', n='m')} FROM sums JOIN asked USING (word) WHERE query_id LIKE 'two %' AND segment IN ('ASIA', 'EUROPE')
UNION ALL SELECT {_row('comp_to_group_avg', '0', subject_id='src', object_name='segment', value='v', average='CASE WHEN m > 1 THEN round((CAST(t AS DOUBLE) - v) / (m - 1), 2) END', n='m - 1')} FROM one JOIN sums USING (word, segment) JOIN asked USING (word) WHERE query_id LIKE 'own %' AND src = 'S1'""",
    "supplies",
)
def questions_ranked(spark, sf_dir):
    """Questions about the discounts on whatever is named like a word: the best, all groups, two groups, and one supplier against its
    group."""
    g = testgraph(spark, sf_dir)
    located = g.with_rel("LOCATED_IN").filter(F.col("src").startswith("S")).select("edge_id", "src", F.col("dst").alias("n"))
    tags = located.join(g.with_rel("IN_REGION").select(F.col("src").alias("n"), "dst"), "n").select("edge_id", "src", "dst", F.lit("IN_SEGMENT").alias("rel"))
    g = PropertyGraph(g.nodes, g.with_rel("SUPPLIES").drop("share").unionByName(tags, allowMissingColumns=True))
    words = table(spark, sf_dir, "part").select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" Ratio")).alias("metric")).distinct()
    q = words.select("metric", F.posexplode(_words("rank ", "groups ", "two ", "own ")).alias("kind", "_tag")).withColumn("query_id", F.concat("_tag", "metric"))
    labels = ["F_GlobalRank", "F_GroupAggregate", "F_GroupAggregate", "F_CompToGroupAverage"]
    q = q.withColumns({"label": _case([F.lit(x) for x in labels]), "segments": F.when(F.col("kind") == 2, _words("ASIA", "EUROPE")), "first": F.when(F.col("kind") == 3, "S1")})
    return Batch(g, "SUPPLIER", "IN_SEGMENT", REGIONS).answers(q)


# -- routing ----------------------------------------------------------------------------------------------------------
_TEMPLATES = [
    "What is the {brand} of the {name}?", "Which bank lends to {name} or {type}?", "What does {brand} fund but not own in {name}?", "Compare the {name} of both {type} banks", "Is {name} lower versus its peer {brand}?",
    "How many {name} are there?", "How much more than {size} is the {name}?", "Across all {size} listed banks, which bank reports the highest {name}?", "Which segment has the highest average {name}?",
    "What is the largest {name} of {brand}?", "What is at most {size}% of {type}?", "What is roughly {size} of {name}?", "Who shares the minimum {name}, exactly {size}, with {brand}?",
]


def _route_sql(q: str) -> str:
    """The decision list as SQL over a lower-cased question."""
    has = lambda words: "(" + " OR ".join(f"contains({q}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")" if words else "FALSE"
    named = " + ".join(f"CAST({has(words)} AS INTEGER)" for words in routing.SEGMENTS.values()) or "0"
    out = []
    for r in routing.RULES:
        if r.domains:
            continue  # these need a question's domain
        tests = [has(r.any) if r.any else "TRUE", *([has(r.also)] if r.also else []), *([f"NOT {has(r.no)}"] if r.no else [])]
        tests += [f"{named} >= {r.least_segments}"] if r.least_segments else []
        tests += [f"contains({q}, 'segment')"] if r.segment_counts else []
        out.append(f"WHEN {' AND '.join(tests)} THEN '{r.label}'")
    return f"CASE {' '.join(out)} ELSE '{routing.DEFAULT}' END"


def _said(names: dict[str, str]) -> list[str]:
    return [t.format(**names) for t in _TEMPLATES]


_TEXT_SQL = "CASE p_partkey % 13 " + " ".join("WHEN {} THEN '{}'".format(k, t) for k, t in enumerate(_said({n: f"' || {c} || '" for n, c in {"brand": "p_brand", "name": "p_name", "type": "p_type", "size": "p_size"}.items()}))) + " END"


@query(f"SELECT p_partkey, question, {_route_sql('low')} AS label FROM (SELECT *, replace(replace(lower(question), 'most recently', ' '), 'most recent', ' ') AS low FROM (SELECT p_partkey, {_TEXT_SQL} AS question FROM part))")
def route_rules(spark, sf_dir) -> DataFrame:
    """The class of a question about every part, by the decision list."""
    p = table(spark, sf_dir, "part").withColumn("kind", F.col("p_partkey") % 13)
    texts = []
    for t in _TEMPLATES:
        pieces = t.replace("{", "\0").replace("}", "\0").split("\0")
        columns = {"brand": "p_brand", "name": "p_name", "type": "p_type", "size": "p_size"}
        texts.append(F.concat(*[F.col(columns[x]).cast("string") if k % 2 else F.lit(x) for k, x in enumerate(pieces)]))
    return p.select("p_partkey", _case(texts).alias("question")).select("p_partkey", "question", routing.route_column(F.col("question")).alias("label"))
