"""Tables of path questions, best trails, numbers of walks and shocks against brute force on graphs with cycles and hubs."""

import collections
import itertools
import random

import pytest

from loomgraph.graph import PropertyGraph
from loomgraph.operators import many, paths, patterns, propagation

SCHEMA = "edge_id long, src string, dst string, rel string, fact string, value double, share double, sign string"


def graph_of(spark, nodes, edges):
    return PropertyGraph.of(spark.createDataFrame([(n, n, "KIND" if n < "n2" else "OTHER") for n in nodes], "id string, name string, type string"), spark.createDataFrame(edges, SCHEMA))


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(8)
    nodes = [f"n{k}" for k in range(24)]
    pairs = [(rng.choice(nodes[:18]), rng.choice(nodes[:18])) for _ in range(44)] + [("n0", n) for n in nodes[1:9]] + [("n20", "n21"), ("n3", "n3")]
    pairs += pairs[:3]  # parallel edges
    edges = [(k, a, b, rng.choice(["X", "Y"]), rng.choice([None, f"fact {k}"]), float(rng.randint(1, 9)), rng.choice([None, 0.5, 2.0]), rng.choice(["+", "-", None])) for k, (a, b) in enumerate(pairs)]
    return nodes, edges, graph_of(spark, nodes, edges)


def plain_hops(edges, source, most, directed=False):
    beside = collections.defaultdict(set)
    for _, a, b, *_ in edges:
        beside[a].add(b)
        if not directed:
            beside[b].add(a)
    hops, level = {source: 0}, [source]
    for k in range(1, most + 1):
        level = [hops.setdefault(m, k) and m for n in level for m in sorted(beside[n]) if m not in hops]
    return hops


@pytest.mark.parametrize("directed, most, word", [(False, 12, 63), (True, 12, 3), (False, 2, 5)])
def test_hops_of_all_pairs(spark, drawn, monkeypatch, directed, most, word):
    monkeypatch.setattr(many, "WORD", word)
    nodes, edges, g = drawn
    asked = [(a, b) for a in nodes for b in nodes] + [("n1", "n2"), ("n1", None), (None, "n1"), ("absent", "n1"), ("n1", "absent")]
    got = many.hops(g, spark.createDataFrame(asked, "source string, target string"), most, None, directed).collect()
    want = {(a, b, h) for a in nodes for b, h in plain_hops(edges, a, most, directed).items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("directed, most", [(False, 2), (True, 3), (False, 3)])
def test_hops_go_out_from_the_fewer_side_and_read_large_relations_last(spark, drawn, monkeypatch, directed, most):
    """Many sources and two targets are one word of bits; small relations first, without broadcasts, gives the same."""
    nodes, edges, g = drawn
    searched = []
    run = many._search
    monkeypatch.setattr(many, "_search", lambda steps, pairs, most: searched.append(pairs.select("root").distinct().count()) or run(steps, pairs, most))
    asked = spark.createDataFrame([(a, b) for a in nodes + ["absent"] for b in ("n5", "n11")], "source string, target string")
    want = {(a, b, h) for a in nodes for b, h in plain_hops(edges, a, most, directed).items() if b in ("n5", "n11")}
    for rows in (100_000, 0):
        monkeypatch.setattr(many.small_or_not, "__defaults__", (rows,))
        got = many.hops(g, asked, most, None, directed).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert searched == [2, 2]


@pytest.mark.parametrize("directed, word, sifted", [(False, 63, 10), (True, 2, 0)])
def test_paths_go_out_from_the_fewer_side(spark, drawn, monkeypatch, directed, word, sifted):
    """Two sources and many targets are searched from the two; words of few roots, levels that are sifted and no broadcasts give the same."""
    nodes, _, g = drawn
    searched = []
    run = many._search
    monkeypatch.setattr(many, "WORD", word)
    monkeypatch.setattr(many, "SIFTED", sifted)
    monkeypatch.setattr(many, "NARROW", 0 if sifted == 0 else 400_000)
    monkeypatch.setattr(many, "_search", lambda steps, pairs, most: searched.append(pairs.select("root").distinct().count()) or run(steps, pairs, most))
    asked = spark.createDataFrame([(a, b) for a in ("n0", "n7") for b in nodes + ["absent"]], "source string, target string")
    got = sorted((r.source, r.target, r.hops, r.path_nodes, r.path_rels, r.path_facts) for r in many.shortest(g, asked, 4, None, directed).collect())
    want = [(a, r.id, r.hops, r.path_nodes, r.path_rels, r.path_facts) for a in ("n0", "n7") for r in paths.distances(g, a, 4, directed=directed).collect()]
    assert got == sorted(want) and searched == [2]


def test_paths_equal_those_of_one_search(spark, drawn):
    nodes, _, g = drawn
    targets = ["n5", "n11", "n21"]
    asked = spark.createDataFrame([(a, b) for a in nodes[:6] for b in targets], "source string, target string")
    for directed in (False, True):
        got = {(r.source, r.target): (r.hops, r.path_nodes, r.path_rels, r.path_facts) for r in many.shortest(g, asked, 8, None, directed).collect()}
        want = {}
        for a in nodes[:6]:
            for r in paths.distances(g, a, 8, directed=directed).collect():
                if r.id in targets:
                    want[a, r.id] = (r.hops, r.path_nodes, r.path_rels, r.path_facts)
        assert got == want


def test_compared_questions_equal_single_ones(spark, drawn):
    nodes, _, g = drawn
    asked = [(a, b, s) for a in ("n1", "n21") for b in ("n9", "n2") for s in ("n0", "n20")]
    df = spark.createDataFrame([(k, *q) for k, q in enumerate(asked)], "query_id int, a string, b string, shock string")
    for how in ("more", "less", "approx"):
        got = {r.query_id: tuple(r)[4:] for r in many.compare_exposures(g, df, how, 6).select("query_id", "a", "b", "shock", "hops_a", "hops_b", *([f"{how}_exposed"] if how != "approx" else [])).collect()}
        for k, (a, b, s) in enumerate(asked):
            one = [tuple(r) for r in paths.compare_exposure(g, a, b, s, how, 6).drop("facts_a", "facts_b").collect()]
            assert ([got[k]] if k in got else []) == one
    for approx in (False, True):
        got = {(r.a, r.b, r.hops) for r in many.compare_pairs(g, df, 8, approx).collect()}
        want = {(a, b, r.hops) for a, b, _ in asked for r in paths.compare_pair(g, a, b, 8, approx).collect()}
        assert got == want


def plain_trails(edges, source, target, most):
    out, frontier = [], [([source], [])]
    for _ in range(most):
        frontier = [([*ns, b], [*es, e]) for ns, es in frontier for e, a, b, *_ in edges if a == ns[-1] and e not in es]
        out += [(len(es), es, ns) for ns, es in frontier if ns[-1] == target]
    return sorted(out)


@pytest.mark.parametrize("source, target, k, most", [("n0", "n5", 10, 5), ("n0", "n11", 3, 6), ("n3", "n3", 6, 5), ("n0", "n23", 5, 4), ("n0", "n7", 1000, 4), ("absent", "n1", 2, 3)])
def test_best_trails_equal_enumeration(drawn, source, target, k, most):
    _, edges, g = drawn
    got = [(r.hops, r.path_edges, r.path_nodes) for r in many.best_trails(g, source, target, k, None, most).collect()]
    assert sorted(got) == plain_trails(edges, source, target, most)[:k]


def test_best_trails_through_many_equal_stretches(spark):
    """Sixteen stretches of two parallel edges each are 65,536 shortest trails, of which eight are asked for."""
    edges = [(2 * k + j, f"n{k}", f"n{k + 1}", "X", None, 1.0, None, None) for k in range(16) for j in (0, 1)]
    g = graph_of(spark, [f"n{k}" for k in range(17)], edges)
    got = [r.path_edges for r in many.best_trails(g, "n0", "n16", 8, None, 16).collect()]
    tails = itertools.islice(itertools.product((0, 1), repeat=16), 8)
    assert sorted(got) == [[2 * k + j for k, j in enumerate(t)] for t in tails]
    counted = {r.id: int(r.walks) for r in many.walk_counts(g, "n0", 16).collect()}
    assert counted == {f"n{k}": 2**k for k in range(1, 17)}


def test_walks_are_counted_with_cycles(drawn):
    _, edges, g = drawn
    at, want = collections.Counter({"n0": 1}), {}
    for level in range(1, 6):
        after = collections.Counter()
        for _, a, b, *_ in edges:
            after[b] += at[a]
        at = +after
        want |= {(n, level): c for n, c in at.items()}
    assert {(r.id, r.hops): int(r.walks) for r in many.walk_counts(g, "n0", 5).collect()} == want
    got = {r.id: int(r.walks) for r in propagation.walks_to(g, "n0", ["X", "Y"], "KIND", 3).collect()}
    assert got == {n: sum(want.get((n, k), 0) for k in (1, 2, 3)) for n in got} and all(n < "n2" for n in got)


def plain_effects(edges, shocks, rounds, damping=0.5, flipped=None):
    whole = collections.Counter()
    for _, a, _, _, _, _, w, _ in edges:
        whole[a] += 1.0 if w is None else w
    moving, total = dict(shocks), collections.Counter(shocks)
    for _ in range(rounds):
        after = collections.Counter()
        for _, a, b, _, _, _, w, sign in edges:
            s = (-1 if sign == "-" else 1) * (-1 if a == flipped and sign else 1)
            after[b] += moving.get(a, 0.0) * damping * s * (1.0 if w is None else w) / whole[a]
        moving = after
        total.update(after)
    return total


def test_shocks_spread_and_settle(spark, drawn):
    _, edges, g = drawn
    shocks = [("n0", 1.0), ("n4", -2.0), ("n4", 0.5)]
    df = spark.createDataFrame(shocks, "id string, effect double")
    want = plain_effects(edges, {"n0": 1.0, "n4": -1.5}, 3)
    got = {r.id: r.effect for r in propagation.propagated(g, df, rounds=3, tolerance=0.0, weight="share").collect()}
    assert got == {n: pytest.approx(want[n], abs=1e-12) for n in got} and set(got) >= {n for n, v in want.items() if abs(v) > 1e-9}
    settled = {r.id: r.effect for r in propagation.propagated(g, df, weight="share").collect()}
    long = plain_effects(edges, {"n0": 1.0, "n4": -1.5}, 60)
    assert settled == {n: pytest.approx(long[n], abs=1e-5) for n in settled}
    assert propagation.propagated(g, df.limit(0)).count() == 0


def test_volatile_nodes_are_in_the_first_part_both_ways(spark, drawn):
    _, edges, g = drawn
    shocks = {"n0": 1.0, "n4": 1.0}
    runs = [plain_effects(edges, shocks, 4, flipped=f) for f in (None, "n0")]
    reached = {r.id for r in propagation.propagated(g, spark.createDataFrame(list(shocks.items()), "id string, effect double"), rounds=4, tolerance=0.0).collect()}
    kind = [n for n in runs[0] if n < "n2" and n in reached]
    size = -(-len(kind) // 3)
    firsts = [set(sorted(kind, key=lambda n: (-round(abs(run[n]), 9), n))[: size if len(kind) % 3 else len(kind) // 3]) for run in runs]
    got = propagation.volatile(g, spark.createDataFrame(list(shocks.items()), "id string, effect double"), "n0", "KIND", 3, rounds=4, tolerance=0.0, weight="share").collect()
    assert {r.id for r in got} == firsts[0] & firsts[1]
    assert all(r.flipped_effect == pytest.approx(runs[1][r.id], abs=1e-9) for r in got)


def test_recipes_against_plain_walks(drawn):
    nodes, edges, g = drawn
    legs = [("X", "out"), ("Y", "any"), ("X", "in")]
    step = lambda n, rel, way: [(b, e, s) for e, a, b, r, _, _, s, _ in edges if r == rel and a == n and way != "in"] + [(a, e, s) for e, a, b, r, _, _, s, _ in edges if r == rel and b == n and way != "out" and not (a == b and way == "any")]
    ways = [("n0", x, y, z, (e1, e2, e3), s2) for x, e1, _ in step("n0", *legs[0]) for y, e2, s2 in step(x, *legs[1]) for z, e3, _ in step(y, *legs[2])]
    got = propagation.along(g, legs, "n0").collect()
    assert collections.Counter((r.n0, r.n1, r.n2, r.n3, r.e1, r.e2, r.e3) for r in got) == collections.Counter((a, x, y, z, *e) for a, x, y, z, e, _ in ways)
    most = {z: max((w for *_, t, _, w in ways if t == z and w is not None), default=None) for *_, z, _, _ in ways}
    rows = {r.id: (r.severity, int(r.ways)) for r in propagation.severity(g, legs, "n0", 1).collect()}
    assert rows == {z: (most[z], sum(t == z for *_, t, _, _ in ways)) for z in most}
    theme = g.nodes.filter("id < 'n13'").select("id")
    got = {r.id: (r.theme_purity, r.edge_count) for r in propagation.revenue_purity(g, "n0", legs, ["Y"], theme, "KIND").collect()}
    for n, (purity, count) in got.items():
        earned = [(v, b < "n13") for _, a, b, r, _, v, _, _ in edges if a == n and r == "Y"]
        assert count == rows[n][1] and purity == (round(sum(v for v, t in earned if t) / sum(v for v, _ in earned), 6) if earned else None)
    assert set(got) == {n for n in rows if n < "n2"}
    with pytest.raises(ValueError):
        propagation.along(g, [("X", "up")])


def test_causal_chains_take_the_best(spark):
    edges = [(1, "a", "b", "CAUSES", None, None, None, None), (2, "b", "c", "HURT_BY", None, None, None, None), (3, "a", "c", "NEEDS", None, None, None, None), (4, "c", "a", "CAUSES", None, None, None, None)]
    g = graph_of(spark, ["a", "b", "c"], edges)
    assert [r.path_edges for r in patterns.causal_chain(g, "a", "c").collect()][:2] == [[3], [1, 2]]
    assert len(patterns.causal_chain(g, "a", None).collect()) <= 10
