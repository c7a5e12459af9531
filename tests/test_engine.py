"""Questions end to end on a small graph, rendered rows and the trained classifier."""

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph
from loomgraph.operators import patterns
from loomgraph.plans import classifier, text
from loomgraph.plans.engine import Engine

COMPANIES = ["Alpha Bank", "Beta Bank", "Gamma Bank"]


@pytest.fixture(scope="module")
def engine(spark):
    nodes = [(f"C{i}", n, "COMPANY", ["Entity", "Company"], {"ticker": n[:3].upper(), "uuid": "x"}) for i, n in enumerate(COMPANIES)]
    nodes += [("M1", "net margin", "METRIC", ["Entity", "Metric"], {}), ("T1", "steel", "TOPIC", ["Entity", "Topic"], {}), ("S1", "Big Banks", "SEGMENT", ["Entity", "Segment"], {}), ("S2", "Small Banks", "SEGMENT", ["Entity", "Segment"], {})]
    edges = [(1, "C0", "M1", "HAS_METRIC", "Alpha's net margin is 3.5%", None), (2, "C1", "M1", "HAS_METRIC", "Beta's net margin is 4.5%", 45000.0), (3, "C2", "M1", "HAS_METRIC", "Gamma's net margin grew 90%", None), (4, "C2", "M1", "HAS_METRIC", None, 2.0)]
    edges += [(5, "C0", "T1", "LENDS_TO", "Alpha lends to steel", None), (6, "C1", "C0", "OWNS", "Beta owns Alpha", None)] + [(7 + i, f"C{i}", s, "IN_SEGMENT", None, None) for i, s in enumerate(["S1", "S1", "S2"])]
    g = PropertyGraph.of(spark.createDataFrame(nodes, "id string, name string, type string, labels array<string>, props map<string,string>"), spark.createDataFrame(edges, "edge_id long, src string, dst string, rel string, fact string, value double")).cached()
    names = {n: (f"C{i}", "COMPANY") for i, n in enumerate(COMPANIES)} | {"net margin": ("M1", "METRIC"), "steel": ("T1", "TOPIC")}
    return Engine(g, names, {"LENDS_TO": ["lend"], "HAS_METRIC": ["margin"]}, segment_rel="IN_SEGMENT", segments=["Big Banks", "Small Banks"])


@pytest.mark.parametrize(
    "question, label, strategy, within",
    [
        ("Whom does Alpha Bank lend to?", "F_Simple", "primary", "Alpha lends to steel"),
        ("What is the ticker of Beta Bank?", "F_Simple", "attribute_lookup_direct", "BET"),
        ("Across all listed banks, which bank reports the highest net margin?", "F_GlobalRank", "global_ranking_max", "4.5"),
        ("Across all listed banks, which bank reports the lowest net margin?", "F_GlobalRank", "global_ranking_min", "Gamma"),
        ("Which segment has the highest average net margin?", "F_GroupAggregate", "group_rank_by_segment_max", "Big Banks"),
        ("How is the net margin of Alpha Bank against the segment average?", "F_CompToGroupAverage", "comp_to_group_avg", "4.5"),
        ("Compare Alpha Bank and Beta Bank on net margin.", "F_CompMore", "compare_metric_named", "4.5%"),
        ("Compare Alpha Bank and Beta Bank.", "F_CompMore", "compare_pair", "hops=1"),
        ("What about Gamma Bank's lenders?", "F_Simple", "relaxed_direction", "grew 90%"),
    ],
)
def test_questions(engine, question, label, strategy, within):
    got = engine.search(question)
    assert (got["error"], got["predicted_template"], got["cypher_strategy"]) == ("", label, strategy)
    assert within in got["kg_hop_path"]


def test_unlinked_and_failing_questions(engine):
    assert engine.search("Anything at all?")["cypher_strategy"] == "none"
    broken = Engine(None, {"Alpha Bank": ("C0", "COMPANY")})
    assert broken.search("Alpha Bank?")["error"].startswith("AttributeError") or broken.search("Alpha Bank?")["cypher_strategy"] == "none"


def test_lines(spark):
    facts = spark.createDataFrame([(1, "Acme", "it grew", None), (2, "Acme", "Acme fell", None), (3, "Acme", None, None)], "pos int, subject_name string, fact string, facts array<string>")
    assert text.hop_text(facts, "pos") == "Row 1: [Acme] it grew\nRow 2: Acme fell\nRow 3: subject_name=Acme"
    best = spark.createDataFrame([(1, "Acme", "margin", 4.5)], "pos int, subject_name string, object_name string, max_value double")
    assert text.hop_text(best, "pos") == "Row 1: RANKED RESULT -- Acme has the HIGHEST margin across all compared, at 4.5."
    many = spark.createDataFrame([(1, "Acme", ["a", "", "b"])], "pos int, subject_name string, facts array<string>")
    assert text.hop_text(many, "pos").splitlines() == ["Row 1: subject_name=Acme (3 facts)", "  - a", "  - b"]
    dated = spark.createDataFrame([(1, "x", "2024-03-01 00:00:00"), (2, "y", "2024-03-01 01:00:00")], "pos int, fact string, t string").select("pos", "fact", F.to_timestamp("t").alias("valid_at"))
    assert text.hop_text(dated, "pos") == "Row 1: x (as of 2024-03-01)\nRow 2: y"


def test_classifier_on_frames_that_it_never_saw(spark):
    names, metrics = ["Axis", "Baroda", "Canara", "Dena"], ["branches", "loans", "margins"]
    model = classifier.train(classifier.questions(spark, 40, names, metrics))
    rows = classifier.report(classifier.classify(model, classifier.questions(spark, 20, names, metrics, 99, True))).collect()
    assert sum(r.hits for r in rows) / sum(r.rows for r in rows) > 0.5


def test_thematic_patterns(engine):
    assert [r.linked_id for r in patterns.ask(engine.graph, "ownership", "C0").collect()] == ["C1"]
    assert {r.id for r in patterns.tied_to_both(engine.graph, "M1", "T1").collect()} == {"C0"}
    assert patterns.chain(engine.graph, ["OWNS", "LENDS_TO"]).collect() == [("C1", "C0", "T1")]
