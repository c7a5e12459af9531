"""Scalar functions, paths on a toy graph, routing, cascade, sources and updates."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph import storage
from loomgraph.graph import PropertyGraph
from loomgraph.operators import paths, quality, search
from loomgraph.plans import linking, routing
from loomgraph.sources import files
from loomgraph.streaming import updates


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name, want", [("MetricObservation", "METRIC_OBSERVATION"), ("HAS_METRIC", None), ("CAUSES", None)])
def test_casing(spark, name, want):
    assert one(spark, X.screaming_snake(F.col("s")), s=name) == want


def test_casing_twin_is_added_once(spark):
    assert one(spark, X.casing_variants(F.col("a")), a=["HasRisk", "HAS_RISK", "Causes"]) == ["HasRisk", "HAS_RISK", "Causes", "CAUSES"]


@pytest.mark.parametrize("text, want", [("218,399", ["218399"]), ("218399", ["218399"]), ("3 items", []), ("3% growth", ["3"]), ("in FY26", []), ("6.90 and 6.9", ["6.9"]), ("1234567", ["1.23457e+06"]), ("", []), ("0.00001%", ["1e-05"])])
def test_numbers(spark, text, want):
    assert one(spark, X.extract_numbers(F.col("s")), s=text) == want


@pytest.mark.parametrize(
    "text",
    ["a12.55", "a1,200 x", "x12.50.75", "a4.5%.75", "123456.5", "1234565", "12345.65", "99999.95", "0.1234565", "1" + "0" * 120, "9" * 400, "12.345675", "1234565" + "0" * 12, "x9,999.99,88", "", None],
)
def test_numbers_equal_their_sql(spark, text):
    """What is glued to a letter goes as a whole, and halves are rounded as the double is in binary."""
    import duckdb

    from loomgraph.plans.catalogue import numbers_sql

    want = duckdb.connect().execute(f"SELECT {numbers_sql('CAST(? AS VARCHAR)')}", [text]).fetchone()[0]
    assert one(spark, F.array_sort(X.extract_numbers(F.col("s").cast("string"))), s=text) == want


@pytest.mark.parametrize("fact, want", [("up 1,204.5% now", 1204.5), ("-3.5 % fell", -3.5), ("none", None), ("", None)])
def test_number_from_fact(spark, fact, want):
    assert one(spark, X.number_from_fact(F.col("s")), s=fact) == want


def test_usable_value(spark):
    assert one(spark, X.usable_value(F.col("v"), F.col("f")), v=19060.0, f="up 5%") == 5.0
    assert one(spark, X.usable_value(F.col("v"), F.col("f")), v=218399.0, f="Rs 218,399 crore") is None
    assert one(spark, X.usable_value(F.col("v"), F.col("f")), v=4.5, f="up 5%") == 4.5


@pytest.mark.parametrize("label, rows, recall, want", [("Relevant", "0", None, "answered"), ("x", "0", 1.0, "no_retrieval"), ("x", "2", None, "unscored"), ("x", "2", 1.0, "generation_miss"), ("x", "2", 0.0, "retrieval_miss"), ("x", "2", 0.5, "partial_retrieval")])
def test_outcome(spark, label, rows, recall, want):
    df = spark.createDataFrame([(label, int(rows), recall)], "l string, n int, r double")
    assert df.select(X.outcome(F.col("l"), F.col("n"), F.col("r"))).first()[0] == want


def test_names():
    assert "value" not in quality.names_of("Value was high.")
    assert "crisil" in quality.names_of("It was rated by CRISIL.")
    assert quality.names_of("The State Bank of India grew.") == ["the state bank of india"]
    assert quality.names_of(None) == []


def test_recall(spark):
    rows = spark.createDataFrame([("It was 12.5%, then 44.2%.", "12.5", "q"), ("not disclosed", "x", "q")], "ground_truth string, kg_hop_path string, query string")
    assert [r.recall for r in quality.with_recall(rows).collect()] == [0.5, None]


def test_row_text_prefers_facts(spark):
    df = spark.createDataFrame([("a", "REL", "b", "said", None), ("a", "REL", "b", None, None), ("a", None, "m", None, 2.5)], "subject_name string, relationship string, object_name string, fact string, max_value double")
    assert [r[0] for r in df.select(X.row_text(df.columns)).collect()] == ["said", "a REL b", "a m 2.5"]


@pytest.fixture(scope="module")
def toy(spark):
    """A self-loop, parallel edges, a node apart, two equal shortest paths and a directed cycle."""
    nodes = spark.createDataFrame([(i, i, "T") for i in "ABCDEFX"], "id string, name string, type string")
    pairs = ["AA", "AB", "AB", "AC", "BD", "CD", "DE", "EA", "EF"]
    return PropertyGraph.of(nodes, spark.createDataFrame([(k, p[0], p[1], "R", f"f{k}") for k, p in enumerate(pairs)], "edge_id long, src string, dst string, rel string, fact string"))


def test_adjacency_has_a_loop_once(toy):
    assert toy.adjacency().count() == 2 * 9 - 1


def test_distances(toy):
    got = {r.id: (r.hops, "".join(r.path_nodes)) for r in paths.distances(toy, "A").collect()}
    assert got == {"A": (0, "A"), "B": (1, "AB"), "C": (1, "AC"), "E": (1, "AE"), "D": (2, "ABD"), "F": (2, "AEF")}
    assert paths.shortest_path(toy, "A", "X").count() == 0


def test_trails_use_no_edge_twice(toy):
    got = [(r.id, r.hops) for r in paths.trails(toy, "D", "F", most=10, limit=None).collect()]
    assert (("F", 2) in got) and all(h <= 9 for _, h in got)
    assert paths.trails(toy, "X", None).count() == 0


def test_rendered(toy):
    r = paths.shortest_path(toy, "A", "F").select(paths.rendered(F.col("path_nodes"), F.col("path_rels"))).first()[0]
    assert r == "A -[R]-> E -[R]-> F"


QUESTIONS = ["Is lower-confidence lending common?", "How many more than 5?", "Which segment has the lowest average X?", "Compare A and B", "x or y", "up to 5", "minimum", "plain", "about the same size", "the share of it", "", "Which bank reports the highest across all?"]


@pytest.mark.parametrize("domain", [None, "T_CompareExposure", "T_TransitRisk", "T_SectorExposure"])
def test_both_routers_agree(spark, domain):
    df = spark.createDataFrame([(q, domain) for q in QUESTIONS], "q string, d string").select("q", routing.route_column(F.col("q"), F.col("d")).alias("label"))
    assert {r.q: r.label for r in df.collect()} == {q: routing.route(q, domain) for q in QUESTIONS}


def test_cascade(spark):
    rows = spark.createDataFrame([("a",)], "fact string")
    fail = lambda: 1 / 0
    assert routing.cascade([("primary", fail), ("compare_pair", lambda: rows)]).strategy == "compare_pair"
    low = routing.cascade([("primary", lambda: rows), ("relaxed_direction", lambda: rows.limit(0))], lambda _: 0.1)
    assert (low.strategy, low.score) == ("primary", 0.1)
    assert routing.cascade([("primary", lambda: rows.limit(0))]).strategy == "none"
    with pytest.raises(ZeroDivisionError):
        routing.cascade([("primary", lambda: rows.limit(0)), ("compare_pair", fail)])


def test_mentions_prefer_longer_names():
    p = linking.gazetteer(["Indian Bank", "Bank", "Indian Bank Limited", "ab"])
    assert linking.find_mentions("The indian bank limited, a bank; banking ab", p) == ["indian bank limited", "bank"]
    assert linking.match_company("Baroda Bank", ["Bank of Baroda", "Bank of Baroda Limited", "Axis"]) == "Bank of Baroda"


def test_script_parser(spark):
    text = "UNWIND [\n {id:'S1', type:'SECTOR', label:'It\\'s'}, {id:'C1', label:'Co', ticker:'CO', sector:'S1', themes:['A','B']}] AS n\n// {id:'no', label:'x'}\nUNWIND [{s:'C1', t:'S1', r:'NEEDS', o:2, sign:'+'}, {s:'C1', t:'gone', r:'NEEDS'}] AS e"
    g = files.thematic_graph(spark, text)
    assert {(r.id, r.name, r.type) for r in g.nodes.collect()} == {("S1", "It's", "SECTOR"), ("C1", "Co", "COMPANY")}
    assert sorted((r.src, r.dst, r.rel, r.order) for r in g.edges.collect()) == [("C1", "S1", "NEEDS", 2), ("S1", "C1", "CONTAINS", None)]


def test_episodes(spark):
    text = "intro\nline\n=====\nPART ONE\n=====\nALPHA (ticker ALP, X)\nAlpha is one.\n\nMore.\n---\nBETA\nBeta is two."
    got = {r.name: r.content for r in files.episodes(spark.createDataFrame([(text,)], "value string")).collect()}
    assert got == {"[Preamble] intro": "line", "[PART ONE] ALPHA (ticker ALP, X)": "(ticker ALP, X)\n\nAlpha is one.\n\nMore.", "[PART ONE] BETA": "Beta is two."}


def test_long_episodes_are_split_between_paragraphs(spark):
    text = "T\n" + "\n\n".join(["x" * 40] * 5)
    got = files.episodes(spark.createDataFrame([(text,)], "value string"), most=100).orderBy("name").collect()
    assert [r.name for r in got] == [f"[Preamble] T (part {k}/3)" for k in (1, 2, 3)]
    assert [len(r.content) for r in got] == [82, 82, 40]


def test_upsert_keeps_the_newest(spark, tmp_path):
    schema = "k string, at int, id int"
    sink = updates.upsert_to(str(tmp_path / "state"), ["k"], "at", "id")
    sink(spark.createDataFrame([("a", 1, 1), ("b", 5, 2)], schema), 0)
    sink(spark.createDataFrame([("a", 3, 3), ("b", 4, 4)], schema), 1)
    sink(spark.createDataFrame([("a", 3, 3), ("b", 4, 4)], schema), 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "state/batch=1")).collect()} == {("a", 3, 3), ("b", 5, 2)}


def test_as_of(spark):
    facts = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "a", "2024-02-01")], "edge_id int, k string, t string").select("edge_id", "k", F.to_timestamp("t").alias("valid_at"))
    held = updates.as_of(updates.superseded(facts, ["k"]), F.lit("2024-01-15").cast("timestamp"))
    assert [r.edge_id for r in held.collect()] == [1]


@pytest.mark.parametrize("few", [3])
def test_searches_without_paths_equal_those_with(spark, monkeypatch, few):
    """Whatever is broadcast: nodes by few ones reached, few ones left, or neither; ends that the nodes lack count too."""
    import random

    monkeypatch.setattr(paths, "BROADCAST_ROWS", few)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", few)
    random.seed(few)
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}", "T", ["Entity"]) for i in range(24)], "id string, name string, type string, labels array<string>")
    edges = [(k, f"n{random.randint(0, 22)}", f"n{random.randint(0, 26)}", random.choice(["A", "B"]), random.choice(["x", "y", None])) for k in range(34)]
    g = PropertyGraph.of(nodes, spark.createDataFrame(edges, "edge_id long, src string, dst string, rel string, fact string"))
    for rels, directed in ((None, False), (["A"], True)):
        want = {r.id: r.hops for r in paths.distances(g, "n1", 12, rels, None, directed).collect()}
        assert {r.id: r.hops for r in paths.hop_counts(g, "n1", 12, rels, None, directed).collect()} == want
    known = {r.id: r for r in paths.distances(g, "n1").collect()}
    for target in ["n1", "n23", max(known, key=lambda i: (known[i].hops, i))]:
        got = [tuple(r[c] for c in ("id", "hops", "path_nodes", "path_rels", "path_facts")) for r in paths.shortest_path(g, "n1", target).collect()]
        assert got == [tuple(known[t][c] for c in ("id", "hops", "path_nodes", "path_rels", "path_facts")) for t in [target] if t in known and t != "n1"]
    far = {r.id: r.hops for r in paths.distances(g, "n2").collect()}
    for most in (4,):
        want = {e for e, a, b, *_ in edges for u, v in ((a, b), (b, a)) if u in known and v in far and known[u].hops <= most >= far[v] and known[u].hops + 1 + far[v] <= most}
        assert sorted(r.edge_id for r in paths.edges_between(g, "n1", "n2", most).collect()) == sorted(want)


def test_merge_gains_one_row_when_full(spark):
    a, b = (spark.createDataFrame([(k, i) for i, k in enumerate(s)], "k string, pos int") for s in ("xy", "yz"))
    assert [r.k for r in search.merged(a, b, ["k"], "pos", 5).collect()] == ["x", "y", "z"]
    assert search.merged(a, b, ["k"], "pos", 2).count() == 3


def test_filters_and_columns_reach_the_scan(spark):
    from loomgraph.plans.testgraph import derived

    g = derived(spark, "/root/testdata/sf0.001")
    plan = g.with_rel("IN_REGION").select("src", "dst")._jdf.queryExecution().executedPlan().toString()
    assert "nation.parquet" in plan and "lineitem" not in plan and "n_name" not in plan
