"""Queries over the whole graph and whole tables against brute force in Python."""

import collections
import os
import re

import pytest

from loomgraph.plans import catalogue
from loomgraph.plans.testgraph import testgraph as whole_graph

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def run(spark, name, path=SF):
    return catalogue.QUERIES[name](spark, path).collect()


@pytest.fixture(scope="module")
def graph(spark):
    g = whole_graph(spark, SF)
    return {r.id: r for r in g.nodes.collect()}, g.edges.select("edge_id", "src", "dst", "rel").collect()


def packed(paragraphs, most=6000):
    out = []
    for p in paragraphs:
        if out and len(out[-1]) + len(p) + 2 <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def test_episodes_of_whole_texts(spark, tmp_path):
    paragraphs = [f"{k} " + "word " * (50 * k + 30) for k in range(20)]
    paragraphs = [p.strip() for p in paragraphs]
    long = "\n\n".join(paragraphs)
    texts = [f"in\nfirst\n=====\nPART A\n=====\nALPHA (ticker ALP)\n{long}\n---\nBETA\nshort", f"LONG\n{long}", "one line", "x == y\nwith signs --- inside", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.name, r.content) for r in run(spark, "episodes_chunk_whole", str(tmp_path))]
    want = [("[Preamble] in", "first"), ("[PART A] BETA", "short"), ("[Preamble] x == y", "with signs --- inside")]
    for title, chunks in (("[PART A] ALPHA (ticker ALP)", packed(["(ticker ALP)", *paragraphs])), ("[Preamble] LONG", packed(paragraphs))):
        assert len(chunks) > 3
        want += [(f"{title} (part {k}/{len(chunks)})", c) for k, c in enumerate(chunks, 1)]
    assert sorted(got) == sorted(want)


def test_conformance_of_all_relations(spark, graph):
    nodes, edges = graph
    allowed = {("SUPPLIER", "PART", "SUPPLIES"), ("CUSTOMER", "NATION", "LOCATED_IN"), ("NATION", "REGION", "IN_REGION")}
    want = set()
    for e in edges:
        a, b = nodes[e.src].type, nodes[e.dst].type
        if e.rel not in ("SUPPLIES", "LOCATED_IN", "IN_REGION", "HAS_BRAND"):
            want.add((e.edge_id, a, e.rel, b, "undeclared relation"))
        elif (a, b, e.rel) not in allowed and e.rel != "HAS_BRAND":
            want.add((e.edge_id, a, e.rel, b, "not allowed for the types"))
    got = run(spark, "ontology_conformance_whole")
    assert set(map(tuple, got)) == want and len(got) == len(want) and "ORDERED" in {r.rel for r in got}


def test_docs_of_all_nodes(spark, graph):
    from loomgraph.plans.catalogue_whole import node_docs

    nodes, edges = graph
    want = collections.Counter((e.src, e.rel, nodes[e.dst].name) for e in edges)
    for got, parts in ((run(spark, "graph_node_docs_whole"), 1), (node_docs(whole_graph(spark, SF), 20).collect(), 3)):
        assert {r.id for r in got} == set(nodes)
        assert collections.Counter((r.id, r.rel, n) for r in got for n in r.neighbours) == want
        assert {r.id for r in got if r.rel is None} == set(nodes) - {e.src for e in edges}
        assert len({(r.id, r.rel, r.part) for r in got}) == len(got) and max(r.part or 0 for r in got) >= parts - 1


def hops_from(edges, source):
    beside = collections.defaultdict(set)
    for e in edges:
        beside[e.src].add(e.dst)
        beside[e.dst].add(e.src)
    hops, level = {source: 0}, [source]
    while level:
        level = [m for n in level for m in beside[n] if hops.setdefault(m, hops[n] + 1) == hops[n] + 1]
        level = list(dict.fromkeys(level))
    return hops


def test_paths_over_all_relations(spark, graph):
    nodes, edges = graph
    of_region, of_s1, of_s2 = (hops_from(edges, n) for n in ("R1", "S1", "S2"))
    assert {(r.id, r.hops) for r in run(spark, "shortest_path_hops_whole")} == {(n, h) for n, h in of_region.items() if h <= 12}
    want = sorted((h, n) for n, h in of_s1.items() if nodes[n].type == "REGION" and 0 < h <= 6)[:20]
    assert sorted((r.hops, r.id) for r in run(spark, "reachable_k_whole")) == want
    a, b = of_region["S1"], of_region["S2"]
    more, less = run(spark, "compare_shock_more_whole")[0], run(spark, "compare_shock_less_whole")[0]
    assert (more.hops_a, more.hops_b, more.more_exposed, less.less_exposed) == (a, b, "S1" if a < b else "S2", "S1" if a > b else "S2")
    assert len(run(spark, "compare_shock_approx_whole")) == (abs(a - b) <= 1)
    assert [r.hops for r in run(spark, "compare_pair_whole")] == [of_s1["S2"]] and of_s2["S1"] == of_s1["S2"]


def test_trails_and_edges_between_over_all_relations(spark, graph):
    nodes, edges = graph
    out = collections.defaultdict(list)
    for e in edges:
        out[e.src].append(e)
    want, level = collections.Counter(), [("S1", "S1", ())]
    for hops in range(1, 11):
        level = [(e.dst, f"{path} -[{e.rel}]-> {e.dst}", (*used, e.edge_id)) for at, path, used in level for e in out[at] if e.edge_id not in used]
        want.update((at, hops, path) for at, path, _ in level)
    assert collections.Counter(map(tuple, run(spark, "causal_trails_whole"))) == want
    target = next(f.dst for e in out["S1"] if e.rel == "LOCATED_IN" for f in out[e.dst] if f.rel == "IN_REGION")
    near, far = hops_from(edges, "S1"), hops_from(edges, target)
    within = {e.edge_id for e in edges for x, y in ((e.src, e.dst), (e.dst, e.src)) if near.get(x, 99) + 1 + far.get(y, 99) <= 12}
    assert {r.edge_id for r in run(spark, "edges_between_whole")} == within


def test_mentions_of_graph_names(spark, graph):
    nodes, _ = graph
    names = sorted({n.name.lower() for n in nodes.values() if n.type in ("PART", "BRAND")}, key=len, reverse=True)
    got = run(spark, "gazetteer_link_whole")
    assert len(got) == sum(n.type == "PART" for n in nodes.values())
    for r in got:
        text, at, want = r.question.lower(), 0, []
        while at < len(text):
            free = at == 0 or not re.match(r"\w", text[at - 1])
            hit = next((n for n in names if free and text.startswith(n, at) and not re.match(r"\w", text[at + len(n) : at + len(n) + 1])), None)
            want += [hit] if hit else []
            at += len(hit) if hit else 1
        assert r.mentions == want and len(want) >= 3


def test_facts_are_searched_for_every_part(spark, graph):
    nodes, edges = graph
    got = collections.defaultdict(set)
    for r in run(spark, "bm25_facts"):
        got[r.query_id].add(r.id)
    about = {e.edge_id: e for e in edges if nodes[e.dst].type == "PART"}
    assert all(len(ids) == 5 and ids <= set(about) for ids in got.values())
    assert set(got) == {n.name for n in nodes.values() if n.type == "PART"} != {n.name for n in nodes.values() if n.type == "PART" and n.id.endswith("0")}
