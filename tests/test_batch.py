"""A table of questions against the engine that answers one at a time."""

import collections

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.plans import batch, routing
from loomgraph.plans.engine import Engine

COMPANIES = ["Alpha Bank", "Beta Bank", "Gamma Bank", "Delta Bank"]
QUESTIONS = [
    "Whom does Alpha Bank lend to?", "Whom does Delta Bank lend to?", "Does Alpha Bank lend to steel?", "What is the ticker of Beta Bank?", "What about Gamma Bank's lenders?", "What is Delta Bank?",
    "Across all listed banks, which bank reports the highest net margin?", "Across all listed banks, which bank reports the lowest net margin?", "Which Big Banks bank has the highest net margin across all listed banks?",
    "Which segment has the highest average net margin?", "Which segment has the lowest average net margin?", "Compare Big Banks and Small Banks segments by average net margin.",
    "How is the net margin of Alpha Bank against the segment average?", "Compare Alpha Bank and Beta Bank on net margin.", "Compare Alpha Bank and Beta Bank.", "Compare Alpha Bank and Delta Bank on margin.",
    "What do both Alpha Bank and Beta Bank have in common?", "Whom does Alpha Bank lend to but not Beta Bank?", "Show Alpha Bank or Gamma Bank lending.", "Which banks lend to at least 2 sectors?", "Which banks lend to more than 1 sector?",
    "Which lends to exactly 1 sector?", "How many does each bank lend to?", "Who holds at most 0.3 of it?", "Who holds at least 0.4 of it?", "What is the largest loan of Alpha Bank?", "What is the smallest loan of Alpha Bank?", "Which companies lend to steel?",
    "Anything at all?", "", None,
]


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [(f"C{i}", n, "COMPANY", ["Entity", "Company"], {"ticker": n[:3].upper(), "uuid": "x", "empty": ""}) for i, n in enumerate(COMPANIES)]
    nodes += [("M1", "net margin", "METRIC", ["Entity", "Metric"], {}), ("T1", "steel", "TOPIC", ["Entity", "Topic"], {}), ("T2", "coal", "TOPIC", ["Entity", "Topic"], {})]
    nodes += [("S1", "Big Banks", "SEGMENT", ["Entity", "Segment"], {}), ("S2", "Small Banks", "SEGMENT", ["Entity", "Segment"], {})]
    edges = [(1, "C0", "M1", "HAS_METRIC", "Alpha's net margin is 3.5%", None, None), (2, "C1", "M1", "HAS_METRIC", "Beta's net margin is 4.5%", 45000.0, None), (3, "C2", "M1", "HAS_METRIC", "Gamma's net margin grew 90%", None, None)]
    edges += [(4, "C2", "M1", "HAS_METRIC", None, 2.0, None), (5, "C0", "T1", "LENDS_TO", "Alpha lends to steel", None, 0.5), (6, "C0", "T2", "LENDS_TO", "Alpha lends to coal", 3.0, 0.2), (7, "C1", "T1", "LENDS_TO", None, 1.0, 0.4)]
    edges += [(8, "C1", "C0", "OWNS", "Beta owns Alpha", None, None), (9, "C0", "T1", "LENDS_TO", "Alpha lends to steel", None, 0.5), (10, "C0", "C0", "OWNS", None, None, None)]
    edges += [(20 + i, f"C{i}", s, "IN_SEGMENT", None, None, None) for i, s in enumerate(["S1", "S1", "S2"])]
    g = PropertyGraph.of(
        spark.createDataFrame(nodes, "id string, name string, type string, labels array<string>, props map<string,string>"), spark.createDataFrame(edges, "edge_id long, src string, dst string, rel string, fact string, value double, share double")
    ).cached()
    names = {n: (f"C{i}", "COMPANY") for i, n in enumerate(COMPANIES)} | {"net margin": ("M1", "METRIC"), "steel": ("T1", "TOPIC")}
    return Engine(g, names, {"LENDS_TO": ["lend", "loan"], "HAS_METRIC": ["margin"]}, segment_rel="IN_SEGMENT", segments=["Big Banks", "Small Banks"], gate=False)


#: The engine's names for columns of ANSWER.
SAME = {"max_value": "value", "min_value": "value", "avg_value": "value", "object_count": "n", "company_count": "n", "peer_count": "n", "hops": "n", "segment_average": "average", "segment_name": "object_name", "a": "subject_id", "b": "object_id"}


def told(strategy, row):
    if strategy.startswith("attribute"):
        row = {("text_value" if k == "value" else k): v for k, v in row.items()}
    row = {SAME.get(k, k): v for k, v in row.items()}
    return tuple((c, float(row[c]) if isinstance(row[c], int | float) else row[c]) for c in batch.ANSWER if c in row and row[c] is not None)


def one_by_one(engine, slots_of):
    out = {}
    for k, q in enumerate(QUESTIONS):
        label = routing.route(q or "")
        answer = routing.cascade(engine.plan(q or "", label, slots_of(q or "", label)), None)
        rows = [{c: v for c, v in r.items() if c not in ("object_type", "valid_at", "path_nodes", "facts", "pairs", "target_count", "subject_id" if answer.strategy == "group" else "")} for r in answer.rows]
        out[k] = (answer.strategy, collections.Counter(told(answer.strategy, r) for r in rows))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_a_table_of_questions_equals_the_engine(spark, engine, monkeypatch, small):
    if not small:
        monkeypatch.setattr("loomgraph.storage.BROADCAST_ROWS", 0)
    df = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string").repartition(3)
    asked = batch.asked(df, engine)
    solver = batch.Batch(engine.graph, "COMPANY", "IN_SEGMENT", engine.segments)
    got = collections.defaultdict(lambda: ("none", collections.Counter()))
    for r in solver.answers(asked).collect():
        row = {c: r[c] for c in batch.ANSWER}
        strategy, rows = got[r.query_id]
        got[r.query_id] = (r.strategy, rows + collections.Counter([told("", row)]))
    want = one_by_one(engine, engine.slots)
    for k, q in enumerate(QUESTIONS):
        assert got[k] == want[k], (q, asked.filter(F.col("query_id") == k).collect())
    strategies = {s for s, _ in want.values()}
    assert strategies >= {"primary", "relaxed_direction", "attribute_lookup", "attribute_lookup_direct", "compare_pair", "compare_metric_named", "comp_to_group_avg", "global_ranking_max", "none"}


def test_no_questions_and_strange_ones(spark, engine):
    solver = batch.Batch(engine.graph)
    schema = "query_id long, label string, first string, relations array<string>"
    assert solver.answers(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "F_Simple", "absent", None), (2, None, None, None), (3, "F_Unknown", "C0", ["OWNS"]), (3, "F_Unknown", "C0", ["OWNS"]), (None, "F_Simple", "C0", None), (4, "F_LogUnion", None, [])]
    got = solver.answers(spark.createDataFrame(rows, schema)).collect()
    assert {r.query_id for r in got} == {3} and sorted(r.edge_id for r in got) == [8, 10]


def test_names_that_hold_phrases(spark, engine):
    names = ["Net Margin", "net margin ratio", "gross", "", "a", "ne"]
    g = PropertyGraph.of(spark.createDataFrame([(str(k), n, "METRIC") for k, n in enumerate(names)], "id string, name string, type string"), engine.graph.edges)
    phrases = ["net margin", "Net Margin Ratio", "gross profit", "x", "a", "", "margin"]
    rows = {(r.phrase, r.name) for r in batch.Batch(g)._named(spark.createDataFrame([(p,) for p in phrases], "phrase string"), True).collect()}
    holds = lambda a, b: b in a or a in b or b.replace(" ratio", "") in a
    assert rows == {(p, n) for p in phrases for n in names if holds(n.lower(), p.lower())}
    rows = {(r.phrase, r.name) for r in batch.Batch(g)._named(spark.createDataFrame([(p,) for p in phrases], "phrase string"), False).collect()}
    assert rows == {(p, n) for p in phrases for n in names if p.lower() in n.lower()}


def test_kinds_about_metrics_share_the_names_and_totals(spark, monkeypatch):
    """The best, all groups, two groups and one subject against its group: names are looked up once, totals by segment too."""
    calls = {"_named": 0, "_firsts": []}
    named, firsts = batch.Batch._named, batch.Batch._firsts
    monkeypatch.setattr(batch.Batch, "_named", lambda self, *a: calls.update(_named=calls["_named"] + 1) or named(self, *a))
    monkeypatch.setattr(batch.Batch, "_firsts", lambda self, *a: calls["_firsts"].append(len(a) > 1) or firsts(self, *a))
    from loomgraph.plans.catalogue_batch import questions_ranked

    questions_ranked(spark, "/root/testdata/sf0.001")
    assert calls == {"_named": 1, "_firsts": [False, True]}  # all subjects once, and the one that is asked for
