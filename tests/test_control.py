"""Linking, slots, relevance, supplements, calls, sources and storage, on small made-up cases."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.functions import expressions as X
from loomgraph.graph import PropertyGraph
from loomgraph.operators import patterns, quality, search
from loomgraph.plans import calls, linking, relevance, routing, slots
from loomgraph.plans.linking import Match, Names, Resolver
from loomgraph.sources import files

KEYWORDS = {"HasMetric": ["margin", "ratio"], "OFFERS_PRODUCT": ["product", "home loan"], "OPERATES_IN": ["overseas"]}


def match(entity, i, kind):
    return Match(entity, i, kind, entity)


ALPHA, BETA, MARGIN, STEEL, HORMUZ = match("Alpha Bank", "C0", "COMPANY"), match("Beta Bank", "C1", "COMPANY"), match("net margin", "M1", "METRIC"), match("steel", "T1", "PRODUCT"), match("Hormuz", "G1", "GEOGRAPHY")


# -- slots ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "question, label, matches, first, second, metric, mode",
    [
        ("Compare the net margin of Beta Bank and Alpha Bank", "F_CompMore", [ALPHA, BETA, MARGIN], "C0", "C1", "net margin", "compare_metric_named"),
        ("Compare Beta Bank and Alpha Bank on products", "F_CompMore", [ALPHA, BETA], "C0", "C1", None, "compare_metric"),
        ("Compare Beta Bank and Alpha Bank", "F_CompLess", [ALPHA, BETA], "C0", "C1", None, "compare_pair"),
        ("Which bank has the lowest net margin?", "F_GlobalRank", [ALPHA, MARGIN], None, "M1", "net margin", "global_ranking_min"),
        ("Which has the highest average net margin?", "F_GroupAggregate", [MARGIN], None, "M1", "net margin", "group_rank_by_segment_max"),
        ("Do PSU banks or small finance banks have the highest average net margin?", "F_GroupAggregate", [MARGIN], None, "M1", "net margin", "group_vs_group"),
        ("Is the net margin of Alpha Bank above the segment average?", "F_CompToGroupAverage", [MARGIN, ALPHA], "C0", "M1", "net margin", "comp_to_group_avg"),
        ("How does it get from Hormuz to Alpha Bank?", "F_Simple", [ALPHA, HORMUZ], "G1", "C0", None, None),
        ("What does steel (net margin) mean for Alpha Bank?", "F_LogUnion", [ALPHA, STEEL, MARGIN], "C0", "T1", None, None),
        ("What is the quality (net margin) of Alpha Bank near Beta?", "F_QuantMax", [ALPHA, STEEL, MARGIN], "C0", "M1", None, None),
        ("How much steel passes through Hormuz?", "F_QuantCount", [HORMUZ, STEEL], "T1", "G1", None, None),
        ("What is the ticker of Alpha Bank?", "F_Simple", [ALPHA], "C0", None, None, "attribute_lookup_direct"),
        ("Which banks sell steel?", "F_LogUnion", [STEEL], "T1", None, None, "list_companies_by_topic"),
        ("What would impact Alpha Bank?", "F_Simple", [HORMUZ, ALPHA], "C0", "G1", None, None),
        ("Across all banks, what is the highest net margin?", "F_QuantMax", [MARGIN], "M1", None, None, None),
    ],
)
def test_slots(question, label, matches, first, second, metric, mode):
    s = slots.fill(question, label, matches, KEYWORDS)
    assert (s.first, s.second, s.metric, slots.mode(question, label, s)) == (first, second, metric, mode)


def test_a_companys_name_chooses_no_relation():
    overseas = match("Overseas Bank", "C9", "COMPANY")
    assert slots.fill("Where is Overseas Bank?", "F_Simple", [overseas], KEYWORDS).relations == []
    s = slots.fill("What product does Overseas Bank have overseas at half the ratio?", "F_Simple", [overseas], KEYWORDS, {"F_Simple": "ANY"})
    assert s.relations == ["HasMetric", "OFFERS_PRODUCT", "OPERATES_IN", "HAS_METRIC"] and s.threshold == 0.5 and s.relation == "OFFERS_PRODUCT"
    assert slots.fill("Who?", "F_Simple", [overseas], KEYWORDS, {"F_Simple": "ANY"}).relation == "ANY"


def test_no_matches_leave_slots_empty():
    s = slots.fill("Who?", "F_Simple", [], KEYWORDS)
    assert (s.first, s.second, s.targets, s.relation) == (None, None, [], None)


# -- linking ----------------------------------------------------------------------------------------------------------
def test_two_passes():
    names = Names({"The Karnataka Bank Limited": ("C1", "COMPANY"), "Karnataka": ("G1", "GEOGRAPHY"), "Indian Bank": ("C2", "COMPANY"), "LIC": ("C3", "COMPANY"), "HDFC Limited": ("C4", "COMPANY")})
    aliases = Names({"SBI": ("C5", "COMPANY")}, "alias", linking.BY_ALIAS, False)
    spans = lambda q: [(q.index(w), q.index(w) + len(w), w) for w in ("Kerala", "Karnataka") if w in q]
    r = Resolver(names, aliases, spans, lambda words, types: match(words, "G9", "GEOGRAPHY"), {"listed Indian Banks": "Indian Bank"})
    found = r.resolve("Is karnataka bank, licensed by SBI, in Kerala?")
    assert [(m.id, m.source, m.similarity) for m in found] == [("C1", "gazetteer", 1.0), ("G9", "semantic", 1.0), ("C5", "alias", 0.99)]
    assert r.resolve("Do listed Indian Banks lend?") == [] and [m.id for m in r.resolve("Does Indian Bank lend?")] == ["C2"]
    more = r.enrich("LIC and HDFC in Karnataka", [], {"GEOGRAPHY"})
    assert [m.id for m in more] == ["G1"]
    assert {m.id for m in r.enrich("LIC and HDFC in Karnataka", more, {"COMPANY"})} == {"G1", "C3"}  # HDFC alone is no name


def test_candidates_equal_the_pattern(spark):
    names = ["Indian Bank", "Bank", "Indian Bank Limited", "Union Bank of India", "State Bank of India", "AT&T", "no"]
    texts = ["The indian bank limited, a bank; banking no", "State Bank of India or union bank of india?", "at&t Bank", "", None, "BANK BANK"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    n = spark.createDataFrame([(str(k), x) for k, x in enumerate(names)], "id string, name string")
    got = {}
    for r in linking.candidate_mentions(q, n).orderBy("query_id", "start").collect():
        got.setdefault(r.query_id, []).append(r.name.lower())
    want = {k: f for k, t in enumerate(texts) if (f := linking.find_mentions(t, linking.gazetteer([x for x in names if len(x) > 2])))}
    assert got == want
    assert linking.candidate_mentions(q, n.limit(0)).count() == 0


def test_companies():
    assert linking.match_company("BANK OF INDIA", ["State Bank of India", "Bank of India Limited"]) == "Bank of India Limited"
    assert linking.match_company("Bank of India", ["State Bank of India"]) == "State Bank of India"
    assert linking.match_company("Nobody", ["State Bank of India"]) is None


def test_runs_of_questions_are_never_broadcast(spark, monkeypatch, tmp_path):
    """Their number isn't in a plan's estimate, so the side of the join isn't chosen by it."""
    spark.range(50).selectExpr("id AS query_id", "concat('a b c d e f ', id) AS text").write.parquet(f"{tmp_path}/q")
    q = spark.read.parquet(f"{tmp_path}/q")
    names = q.selectExpr("concat('n', query_id) AS id", "concat('f ', query_id) AS name")
    joined = lambda: linking.candidate_mentions(q, names)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined() and "BuildLeft" not in joined()
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 10)
    assert "SortMergeJoin" in joined() and "BroadcastHashJoin" not in joined()


def test_company_table_equals_single_lookups(spark):
    import random

    random.seed(3)
    words = ["bank", "of", "India", "the ", "State", "axis", "Limited", "union", "9"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 5))) for _ in range(120)] + ["bank bank", "bank"]
    names, said = [t for t in texts[:60] if linking.match_company(t, ["bank of india state axis union"])] + ["bank bank"], texts[60:]
    found = linking.matched_companies(spark.createDataFrame([(t,) for t in said] + [(None,)], "mention string"), spark.createDataFrame([(t,) for t in names], "name string"))
    got = {r.mention: r.matched for r in found.collect()}
    assert got == {**{t: linking.match_company(t, names) for t in said}, None: None}


def test_companies_with_common_words_make_few_pairs(spark):
    """Words that all names share make no pairs; before, these 2,000 names and mentions made four million."""
    rows = lambda last: spark.range(2000).select(F.array(F.lit("bank"), F.lit("of"), F.concat(F.lit("n"), F.col("id").cast("string")), *last).alias("_ws"))
    assert linking._held_pairs(rows([]), rows([F.lit("limited")])).count() == 2000


# -- routing ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "question, label",
    [
        ("Across PSU banks, which bank reports the highest margin?", "F_GlobalRank"), ("Among PSBs, which bank reports the lowest margin?", "F_GlobalRank"),
        ("Do psu banks lead small finance banks?", "F_GroupAggregate"), ("Which PSU bank has the highest average margin?", "F_GroupAggregate"),
    ],
)
def test_segment_synonyms_route(spark, question, label):
    assert routing.route(question) == label
    assert spark.createDataFrame([(question,)], "q string").select(routing.route_column(F.col("q"))).first()[0] == label


# -- rules that were wrong --------------------------------------------------------------------------------------------
@pytest.mark.parametrize("winners, want", [("ab", "b"), ("ac", "c"), ("abc", "b"), ("bc", "c"), ("a", "a")])
def test_majority_takes_the_middle_of_the_winners(spark, winners, want):
    votes = [(1, w) for w in winners for _ in range(2)] + [(1, w) for w in "abc"]
    rows = spark.createDataFrame(votes, "k int, label string")
    assert quality.majority(rows, "k", "label", ["a", "b", "c"]).first()["label"] == want
    calls_made = iter([(w, f"because {w}") for w in winners * 2])
    assert calls.voted(lambda: next(calls_made), 2 * len(winners), ["a", "b", "c"]) == (want, f"because {want}")


def test_gaps_and_growth(spark):
    one = lambda e, t: spark.createDataFrame([(t,)], "t string").select(e(F.col("t"))).first()[0]
    assert one(X.real_gap, "As of March the ratio was not disclosed.") is True
    assert one(X.real_gap, "It is 5%. The date was not found.") is False
    assert one(X.real_gap, "The period was not found.") is True and one(X.real_gap, "It is 5%.") is False
    assert one(X.growth_amount, "Deposits of the bank, at 5 crore, went up 9.73% in a year") == 9.73
    assert one(X.growth_amount, "advances 11.5%") == 11.5 and one(X.growth_amount, "profit up 5%") is None and one(X.growth_amount, None) is None
    assert one(lambda c: X.mask_types(c, [("a\\Eb(", "ODD"), ("Al", "A"), ("Al Gore", "P")]), "Al Gore met a\\Eb( and al") == "<P> met <ODD> and <A>"


# -- relevance and supplements ----------------------------------------------------------------------------------------
def test_similarity_is_the_same_in_both_forms(spark):
    q = "Whom does Alpha Bank lend to?"
    texts = ["Alpha Bank lends to steel", "Alpha Bank", "", None, "to whom does it lend", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(relevance.similarity_column(F.col("t"), q, ["Alpha Bank"])).collect()]
    want = [relevance.similarity(relevance.masked(q, ["Alpha Bank"]), relevance.masked(t or "", ["Alpha Bank"])) for t in texts]
    assert got == pytest.approx(want) and got[0] > relevance.FLOOR > got[1] == 0


def test_merging_rows():
    a, b = [{"fact": "x"}, {"fact": "y"}], [{"fact": "Y "}, {"fact": "z"}, {"fact": "w"}]
    assert [r["fact"] for r in relevance.merged(a, b, 3)] == ["x", "y", "z"]
    assert [r["fact"] for r in relevance.merged(a, b, 2)] == ["x", "y", "z"]  # full already, still gains one
    assert relevance.ranked("alpha beta", [{"fact": "zzz"}, {"fact": "beta"}, {"fact": "alpha beta"}], most=2) == [{"fact": "alpha beta"}, {"fact": "beta"}]


def test_vector_join_equals_all_pairs(spark):
    import numpy as np

    v = np.random.default_rng(4).normal(size=(40, 8)).round(3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, embedding array<double>")
    got = {(r.q, r.id) for r in search.joined_top_k(rows.filter("id < 10").withColumnRenamed("id", "q"), rows, 4, "q", "id", at_once=3).collect()}
    sims = np.round(v[:10] @ v.T, 6)
    assert got == {(q, int(i)) for q in range(10) for i in np.lexsort((np.arange(40), -sims[q]))[:4]}
    assert search.joined_top_k(rows.limit(0).withColumnRenamed("id", "q"), rows, 4, "q", "id").count() == 0


def test_a_vector_join_scans_the_corpus_once(spark, monkeypatch):
    """Queries in matrices of three share a scan, and however the rows are cut the result is that of all pairs, ties by key."""
    import numpy as np

    v = np.random.default_rng(5).integers(-2, 3, size=(60, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    asked = rows.filter("id < 20").withColumnRenamed("id", "q")
    sims = v[:20] @ v.T
    want = {(q, int(i), sims[q, i]) for q in range(20) for i in np.lexsort((np.arange(60), -sims[q]))[:7]}
    one = search.joined_top_k(asked, rows, 7, "q", "id", at_once=3)
    assert {tuple(r) for r in one.collect()} == want and one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(search, "ROWS_AT_ONCE", 5)
    monkeypatch.setattr(search, "SCANNED", 1000)
    assert {tuple(r) for r in search.joined_top_k(asked, rows, 7, "q", "id", at_once=3).collect()} == want
    assert search.joined_top_k(asked, rows, 100, "q", "id").count() == 20 * 60


# -- calls ------------------------------------------------------------------------------------------------------------
def test_retries():
    tries, pauses = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "done"

    assert calls.retried(flaky, 3, 1.0, sleep=pauses.append) == "done" and pauses == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        calls.retried(lambda: 1 / 0, 2, sleep=pauses.append)
    with pytest.raises(TimeoutError):
        calls.retried(lambda: time.sleep(2), 1, seconds=0.05)


def test_called_rows_keep_their_errors(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "t string")
    got = {r.t: (r.out, r.error) for r in calls.called(rows, "t", lambda v: v[0].upper(), "out", attempts=1).collect()}
    assert got == {"a": ("A", None), "": (None, "IndexError: string index out of range"), None: (None, None)}


# -- thematic questions -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "question, entities, source, target, mode",
    [
        ("T_StockImpact", [("E", "EVENT"), ("C", "COMPANY")], "C", "E", "pair"), ("T_StockImpact", [("C", "COMPANY")], "C", None, "single"),
        ("T_CausalChain", [("C", "COMPANY"), ("G", "GEOGRAPHY")], "G", "C", "pair"), ("T_CompareExposure", [("C", "COMPANY"), ("E", "EVENT"), ("D", "COMPANY")], "C", "D", "pair"),
        ("T_CompareExposure", [("C", "COMPANY"), ("E", "EVENT")], "C", None, "single"), ("T_InvestmentFlow", [("I", "INVESTOR"), ("S", "SECTOR")], None, "S", "pair"),
        ("T_SupplyDisruption", [("R", "RAW_MATERIAL"), ("E", "EVENT")], "R", None, "pair"), ("T_TransitRisk", [("G", "GEOGRAPHY")], None, "G", "pair"), ("T_MacroTransmission", [("M", "MACRO_VAR"), ("C", "COMPANY")], "M", "C", "pair"),
    ],
)
def test_thematic_parameters(question, entities, source, target, mode):
    p = patterns.parameters(question, entities)
    assert (p["source"], p["target"], p["mode"]) == (source, target, mode)
    with pytest.raises(ValueError):
        patterns.parameters(question, [])


def test_signs_and_purity(spark):
    nodes = spark.createDataFrame([("E", "E", "EVENT"), ("A", "A", "COMPANY"), ("B", "B", "COMPANY"), ("X", "X", "OTHER")], "id string, name string, type string")
    edges = [(1, "E", "A", "HURT_BY", "+"), (2, "E", "X", "CAUSES", "-"), (3, "X", "A", "HURT_BY", None), (4, "A", "B", "OWNS", "+"), (5, "E", "A", "CAUSES", "+")]
    g = PropertyGraph.of(nodes, spark.createDataFrame(edges, "edge_id long, src string, dst string, rel string, sign string"))
    assert [r.sign for r in patterns.sign_flipped(g, "E").edges.orderBy("edge_id").collect()] == ["-", "+", None, "+", "-"]
    assert {r.id: (r.theme_purity, r.edge_count) for r in patterns.purity(g, "E", ["HURT_BY", "CAUSES"]).collect()} == {"A": (0.75, 3)}
    assert patterns.answer(g, "T_OwnershipStructure", [("B", "COMPANY")]).select("linked_id").first()[0] == "A"
    assert [r.hops for r in patterns.answer(g, "T_CausalChain", [("E", "EVENT"), ("A", "COMPANY")]).collect()] == [1, 1, 2]


# -- storage and sources ----------------------------------------------------------------------------------------------
def test_numbers_in_order(spark):
    rows = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 997)
    got = storage.numbered(rows, [F.col("v").desc(), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1000)) and [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)
    assert storage.numbered(rows.limit(0), [F.col("v")]).count() == 0
    tiles = patterns.deciles(rows, "id", "v", parts=7).groupBy("v_part").count().orderBy("v_part").collect()
    assert [r["count"] for r in tiles] == [143] * 6 + [142]


def test_stored_graph_is_pruned_and_renewed(spark, tmp_path):
    import shutil

    from loomgraph.plans import testgraph

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "t")
    (tmp_path / "t").chmod(0o755)
    g = testgraph.testgraph(spark, str(tmp_path / "t"))
    plan = g.adjacency("SUPPLIES").filter("src = 'S1'")._jdf.queryExecution().executedPlan().toString()
    assert ", EqualTo(src,S1)" in plan and "EqualTo(dst,S1)" in plan and plan.count("PartitionFilters: [isnotnull(rel") == 2
    derived = testgraph.derived(spark, str(tmp_path / "t"))
    columns = ["edge_id", "src", "dst", "rel", "fact", "value", "share"]
    assert g.edges.select(columns).exceptAll(derived.edges.select(columns)).count() == 0 and g.edges.count() == derived.edges.count() == g.reverse.count()
    region = tmp_path / "t" / "region.parquet"
    region.chmod(0o644)
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").filter("r_regionkey < 4").toPandas().to_parquet(tmp_path / "new.parquet")
    shutil.move(tmp_path / "new.parquet", region)
    assert testgraph.testgraph(spark, str(tmp_path / "t")).of_type("REGION").count() == 4


def test_questions_of_several_files(spark, tmp_path):
    for k, rows in enumerate((["text,x", '"a ""b""\nc",1', ",2"], ["text,x", "d,3", "e,4"])):
        (tmp_path / f"{k}.csv").write_text("\n".join(rows) + "\n")
    got = files.read_queries(spark, str(tmp_path)).orderBy("query_idx").collect()
    assert [(r.query_idx, r.text) for r in got] == [(0, 'a "b"\nc'), (2, "d"), (3, "e")]
    assert [r.text for r in files.read_queries(spark, str(tmp_path), 1, 2).collect()] == ["d"]


def test_ingested_twice_is_the_same(spark):
    texts = spark.createDataFrame([("Alpha owns Beta\nalpha owns Gamma",), ("Alpha owns Beta",)], "content string")
    extract = lambda t: files.facts_in(t, r"(?m)^(\w+) owns (\w+)$", "OWNS")
    g = files.ingested(texts, extract)
    again = files.ingested(texts, extract, g)
    assert (g.nodes.count(), g.edges.count()) == (3, 2) == (again.nodes.count(), again.edges.count())
