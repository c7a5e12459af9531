"""Corpus operators on long, deep, repeated, tied and clashing inputs, and against further brute-force versions."""

import collections
import itertools
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, decontamination, html_extraction, jaccard_join, language_id, lm_scoring, substring_dedup, url_filter
from loomgraph.llm.common import plain_words
from tests.llm.test_corpus_operators import corpus, edited, empty, frame, prose  # noqa: F401


# -- shared helpers ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("rows", [1000, 3])
def test_rows_among_and_without(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame([(i, "t") for i in range(200)] + [(None, "n"), (7, "again")], "id int, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 7)], "id long")
    got = {(r.id, r.text) for r in common.without(df, ids).collect()}
    assert got == {(i, "t") for i in range(200) if i % 7} | {(None, "n")}
    among = {r.id for r in common.likely_among(df, ids).collect()}
    assert among >= set(range(0, 200, 7)) and None not in among and len(among) < 60
    assert common.without(df, ids.limit(0)).count() == 202


@pytest.mark.parametrize("chunk", [1 << 18, 16])
def test_word_hashes_depend_on_the_word_alone(chunk, monkeypatch):
    monkeypatch.setattr(common, "_CHUNK", chunk)
    monkeypatch.setattr(common, "_POWERS", [])
    rng = random.Random(1)
    known = {}
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", "é", " ", "\n", "\t  ", "\x0b", "\x00", "\x1c", "\xa0", "abc", "x" * rng.randint(1, 40), "the "]) for _ in range(rng.randint(0, 30)))
        words, hashes = plain_words(text), common.hashed_words(text).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 100 and len(common.hashed_words(None)) == 0


# -- near copies ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n, percent, rows", [(3, 90, 100_000), (5, 80, 10)])
def test_a_group_of_two_thousand(spark, n, percent, rows, monkeypatch):
    """Copies of one text with few to many edits: links between some of them only, and far too many pairs to list."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = []
    for i in range(2000):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, " ".join(words + [rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 0, 12]))])))
    docs += [(None, docs[0][1]), (3, docs[3][1])]
    sets = {i: set(jaccard_join.shingle_set(t, n).tolist()) for i, t in docs if i is not None}
    group = list(range(2000))

    def top(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for a, b in itertools.combinations(range(2000), 2):
        if top(a) != top(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            group[max(x, y)] = min(x, y)
    got = jaccard_join.jaccard_components(frame(spark, docs), n=n, percent=percent).collect()
    assert len(got) == 2002
    assert {(r.doc_id, r.component_id) for r in got} == {(i, top(i)) for i in range(2000)} | {(None, top(0))}


# -- pages ------------------------------------------------------------------------------------------------------------
def test_pages_that_are_long_deep_or_broken(spark):
    model = html_extraction.train(html_extraction.labelled_pages(60))
    pages = {
        "deep": "<div>" * 30_000 + "<p>Some words.</p>", "stray": "<div><pre>" * 8000 + "</span></p></section>" * 20_000 + "text", "heads": "<head>" * 30_000 + "<p>x words</p>", "open": "<pre>" * 15_000 + "<p>a" * 15_000,
        "quotes": "<a title='" * 20_000, "long": "<article><p>" + "word " * 500_000 + "</p></article>",
    }
    for page in pages.values():
        began = time.time()
        html_extraction.extract(model, page)
        assert time.time() - began < 20
    rows = [(1, "<p>a", 1), (1, "<p>a", 1), (None, None, 2), (2, "", 3)]
    got = html_extraction.with_main_text(spark.createDataFrame(rows, "page_id int, html string, text int"), model).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id in (None, 2)] == ["", ""]
    assert html_extraction.with_main_text(spark.createDataFrame([], "page_id int, html string"), model).count() == 0


def test_words_inside_math_and_fallbacks_stay():
    model = html_extraction.train(html_extraction.labelled_pages())
    inside = "<article><h1>On energy and mass</h1><p>Energy is <math>E</math> here, <object>fallback words</object> and <noscript>plain words</noscript> follow, as do <canvas>drawn ones</canvas>.</p><script>no()</script></article>"
    assert html_extraction.extract(model, inside) == "On energy and mass\n\nEnergy is E here, fallback words and plain words follow, as do drawn ones."


# -- leaks ------------------------------------------------------------------------------------------------------------
def test_short_items_are_whole_lines(spark):
    items = [(1, "Who was it?"), (2, "who  was it"), (3, "?!"), (4, None), (5, "one two three four five six seven eight nine ten")]
    texts = ["Tell us who was it then", "First line\nWHO WAS IT\nthen who was it", "who was it", None, "", "x one two three four FIVE six seven eight nine ten y " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    got = decontamination.with_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = sorted((r.doc_id, x.item_id, x.start_word, x.end_word, x.distance) for r in got for x in r.leaks)
    assert found == [(1, 1, 2, 5, 0), (1, 1, 2, 5, 0), (1, 2, 2, 5, 0), (1, 2, 2, 5, 0), (2, 1, 0, 3, 0), (2, 2, 0, 3, 0), (5, 5, 1, 11, 0)]


# -- languages --------------------------------------------------------------------------------------------------------
def test_languages_of_long_tied_and_repeated_texts(spark):
    rng = random.Random(4)
    make = lambda letters, n=30: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, make("abcde"), "xx", "h1") for i in range(40)] + [(i, make("pqrst"), "yy", "h2") for i in range(40, 80)]
    rows += [(90, make("abcde", 60_000), None, None), (91, make("abcde") + " " + make("pqrst"), None, "h1"), (91, make("abcde") + " " + make("pqrst"), None, "h2"), (92, "ζζζ", None, None)]
    rows += [rows[0], rows[0]]
    got = collections.defaultdict(list)
    for r in language_id.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        got[r.doc_id].append((r.lang_id, r.lang_kept))
    assert got[90] == [("xx", True)] and got[0] == [("xx", True)] * 3 and len(got[91]) == 2
    assert sum(map(len, got.values())) == len(rows) and all(k == (lang != "und") for v in got.values() for lang, k in v)


# -- language model ---------------------------------------------------------------------------------------------------
def test_interpolated_scores(spark, corpus, monkeypatch):  # noqa: F811
    """Counts, weights by expectation-maximisation over single events, and scores, against the operator's gathered cells."""
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 700)
    rng = random.Random(2)
    phrase = [prose(rng, 6) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(phrase) for _ in range(20))) for i in range(120)] + [(None, "no id"), *corpus]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    tokens = lambda t: [*plain_words(t), b""]
    pairs = lambda t: list(zip([b"", *tokens(t)[:-1]], tokens(t)))

    def counted(keep):
        one, two = collections.Counter(), collections.Counter()
        for i, t in rows:
            if keep(fold(i)):
                one.update(tokens(t))
                two.update(pairs(t))
        return one, two, sum(one.values())

    one, two, n = counted(lambda f: f not in (2, lm_scoring.DELETED))
    bucket = lambda c: min(math.frexp(c)[1], lm_scoring.CONTEXTS - 1)
    parts = lambda v, w, one, two, n: (two[v, w] / one[v] if one[v] else 0.0, one[w] / n, 1 / (len(one) + 1))
    events = [(bucket(one[v]), parts(v, w, one, two, n)) for i, t in rows if fold(i) == lm_scoring.DELETED for v, w in pairs(t)]
    weights = np.tile([0.3, 0.6, 0.1], (lm_scoring.CONTEXTS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for _ in range(lm_scoring.EM_ROUNDS):
        sums = np.full((lm_scoring.CONTEXTS, 3), 1e-3)
        for b, p in events:
            share = weights[b] * p
            sums[b] += share / share.sum()
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0, 0] = 0.0
    weights /= weights.sum(axis=1, keepdims=True)
    one, two, n = counted(lambda f: f != 2)
    score = lambda t: sum(math.log10(float(np.dot(weights[bucket(one[v])], parts(v, w, one, two, n)))) for v, w in pairs(t))
    got = lm_scoring.score_texts(frame(spark, rows), lm_scoring.fold(F.col("doc_id"), 7)).collect()
    want = collections.Counter((i, len(tokens(t)), round(score(t), 0)) for i, t in rows)
    assert len(got) == len(rows)
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(score(t))
    for i, scores in by_id.items():
        mine = sorted(r.score for r in got if r.doc_id == i)
        assert mine == pytest.approx(sorted(scores), rel=5e-3), i
    assert sum(want.values()) == len(rows)


# -- urls -------------------------------------------------------------------------------------------------------------
def plain_tree(rows):
    """(template, labelled, purity) of each (host, path, blocked or None), level by level and node by node."""
    u = url_filter
    template = {k: [] for k in range(len(rows))}
    for level in range(u.DEPTH):
        nodes = collections.defaultdict(list)
        for k, (host, path, _) in enumerate(rows):
            segs = path.removeprefix("/").split("/") if path else []
            if level < len(segs):
                nodes[host, tuple(template[k])].append((segs[level], k))
        for members in nodes.values():
            by = collections.defaultdict(list)
            for seg, k in members:
                by[seg].append(k)
            literal = []
            for seg, ks in by.items():
                if len(ks) >= u.LITERAL_ROWS and len(ks) >= u.LITERAL_SHARE * len(members):
                    said = [rows[k][2] for k in ks if rows[k][2] is not None]
                    rate = (sum(said) + 1) / (len(said) + 2)
                    literal.append((rate, seg, rate * (1 - rate) / (len(said) + 3), bool(said)))
            literal.sort()
            branch, group = {}, []
            for i, x in enumerate(literal):
                if i and ((x[0] - literal[i - 1][0]) / math.sqrt(x[2] + literal[i - 1][2]) >= u.SIMILAR_Z or x[3] != literal[i - 1][3]):
                    group = []
                group = [*group, x[1]]
                for seg in group:
                    branch[seg] = group
            for seg, k in members:
                template[k].append("|".join(sorted(branch[seg])) if seg in branch else "*")
    deeper = [len(path.removeprefix("/").split("/")) > u.DEPTH for _, path, _ in rows]
    keys = []
    for k, (host, path, _) in enumerate(rows):
        domain = ".".join(host.split(".")[-2:])
        node = [("world",), ("domain", domain), ("host", host)]
        segs = template[k]
        node += [("branch", host, *(("/" + s) for s in segs[: level + 1]), min(level + 1, len(segs))) for level in range(u.DEPTH)]
        node.append(("leaf", host, "".join("/" + s for s in segs) + ("/**" if deeper[k] else "")))
        keys.append(node)
    members = collections.defaultdict(set)
    for k, node in enumerate(keys):
        for key in node:
            members[key].add(k)

    def share(some, prior):
        blocked = sum(rows[k][2] or 0 for k in some)
        return (blocked + u.PRIOR_ROWS * prior) / (sum(u.UNLABELLED if rows[k][2] is None else 1 for k in some) + u.PRIOR_ROWS)

    purity = {}
    for node in set(map(tuple, keys)):
        expected = 0.5
        for outer, inner in itertools.pairwise(members[key] for key in node):
            expected = share(outer - inner, expected) if outer != inner else expected
        purity[node[-1]] = share(members[node[-1]], expected)
    return [(node[-1][2], sum(rows[k][2] is not None for k in members[node[-1]]), round(purity[node[-1]], 9)) for node in keys]


def test_one_blocked_row_is_no_evidence_but_ten_are(spark):
    rules = [("block", "bad.org", "/x")]
    judge = lambda urls: url_filter.judge_urls(spark.createDataFrame(enumerate(urls), "page_id int, url string"), rules=rules)
    assert [r.purity for r in judge(["http://bad.org/x"]).collect()] == [pytest.approx(2 / 3)]
    for others in range(3):
        got = judge(["http://bad.org/x", *(f"http://bad.org/{'yz'[k]}" for k in range(others))]).collect()
        assert max(r.purity for r in got) < url_filter.REJECT
    got = judge([f"http://bad.org/x{k}" for k in range(10)]).collect()
    assert all(r.purity == pytest.approx(11 / 12) for r in got)


def test_templates_and_purity_against_a_plain_tree(spark):
    rng = random.Random(5)
    urls = []
    for k in range(900):
        host = rng.choice(["a.example.com", "b.example.com", "c.org", "d.net", "solo"])
        path = "/" + "/".join(rng.choice(["bad", "good", "tag", str(rng.randint(0, 400)), "x"]) for _ in range(rng.choice([0, 1, 2, 2, 3, 5, 6])))
        urls.append((k, f"http://{host}{path}"))
    urls += [urls[0], urls[1], (None, None)]
    rules = [("block", "example.com", "/bad"), ("allow", "example.com", "/good"), ("allow", "c.org", "/"), ("block", "solo", "/x")]
    got = sorted(url_filter.judge_urls(spark.createDataFrame(urls, "page_id int, url string"), rules=rules).collect(), key=lambda r: (r.page_id is None, r.page_id))
    want = plain_tree([(r.host, r.path, None if r.rule is None else int(r.verdict == "block")) for r in got])
    assert [(r.template, r.labelled, round(r.purity, 9)) for r in got] == want
    assert all(r.verdict == ("block" if r.purity >= url_filter.REJECT else "allow") for r in got if r.rule is None)
    assert any(r.verdict == "block" and r.rule is None for r in got) or all(r.purity < url_filter.REJECT for r in got if r.rule is None)


# -- passages ---------------------------------------------------------------------------------------------------------
def test_chain_scores_equal_enumeration():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8)
        matches = sorted({(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(n)}, key=lambda m: (m[0], -m[1]))
        best = 0.0
        for k in range(1, len(matches) + 1):
            for some in itertools.combinations(matches, k):
                if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(some, some[1:])):
                    gaps = some[-1][0] - some[0][0] + some[-1][1] - some[0][1]
                    best = max(best, substring_dedup.SEED * k - substring_dedup.GAP_COST * gaps)
        score, _ = substring_dedup.chain_scores([m[0] for m in matches], [m[1] for m in matches])
        assert max(score) == pytest.approx(best)


def test_copies_in_step_are_one_chain():
    rng = random.Random(2)
    for _ in range(50):
        x = np.cumsum([rng.randint(1, 14) for _ in range(rng.randint(1, 60))])
        assert substring_dedup.chains(x, x + 7) == [(int(x[0]), int(x[-1]) + substring_dedup.SEED, int(x[0]) + 7, int(x[-1]) + 7 + substring_dedup.SEED)]


def test_uncovered_places():
    rng = random.Random(9)
    for _ in range(300):
        free = sorted(rng.sample(range(200), 2 * rng.randint(1, 4)))
        open_end = rng.random() < 0.3
        stretches = [*free[:-1], -1] if open_end else free
        spans = [v for _ in range(rng.randint(0, 4)) for a in [rng.randint(0, 220)] for v in (a, a + rng.randint(substring_dedup.PASSAGE, 120))]
        places = {p for a, b in zip(stretches[::2], stretches[1::2]) for p in range(a, 400 if b < 0 else b + 1)}
        want = {p for p in places if not any(a <= p and p + substring_dedup.PASSAGE <= b for a, b in zip(spans[::2], spans[1::2]))}
        rest = substring_dedup.uncovered(stretches, spans)
        assert {p for a, b in zip(rest[::2], rest[1::2]) for p in range(a, 400 if b < 0 else b + 1)} == want


@pytest.mark.parametrize("words, share, least", [(50, 0.02, 0.95), (50, 0.05, 0.95), (50, 0.1, 0.95), (50, 0.2, 0.8), (100, 0.02, 0.95), (100, 0.1, 0.95), (100, 0.2, 0.9), (200, 0.02, 0.95), (200, 0.1, 0.95), (200, 0.2, 0.95)])
def test_share_of_differing_passages_that_are_found(spark, words, share, least):
    """Planted passages in which a share of the words, the first and last ones not, is replaced."""
    rng = random.Random(words + int(100 * share))
    fresh = lambda n: [f"{w}{rng.randint(0, 10**6)}" for w in prose(rng, n).split()]
    rows, trials = [], 120
    for k in range(trials):
        passage = fresh(words)
        changed = list(passage)
        for at in rng.sample(range(1, words - 1), int(words * share)):
            changed[at] = f"other{rng.randint(0, 10**6)}"
        rows += [(2 * k, " ".join(fresh(20) + passage + fresh(20))), (2 * k + 1, " ".join(fresh(25) + changed + fresh(10)))]
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert len(got) / trials >= least


def test_copies_and_ids_with_several_texts(spark):
    rng = random.Random(1)
    a, b, c = prose(rng, 70), prose(rng, 90), prose(rng, 30)
    rows = [(1, a), (2, a), (3, a), (4, b), (4, a), (5, b), (6, c), (7, c), (8, a.upper()), (9, a + " " + "long " * 50_000)]
    got = {(r.doc_id, r.source_id, r.start_word, r.end_word) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert {(2, 1, 0, 70), (3, 1, 0, 70), (4, 1, 0, 70), (5, 4, 0, 90), (8, 1, 0, 70)} <= got
    assert {r[0] for r in got} == {2, 3, 4, 5, 8, 9}


# -- pipeline ---------------------------------------------------------------------------------------------------------
def test_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_id string, leaks int, ids string, component_id long"
    item = prose(rng, 20)
    rows = [(i, prose(rng, 40), "xx", "s", 1, "z", 2, "q", 9) for i in range(12)]
    rows += [(None, prose(rng, 40), "xx", None, None, None, None, None, None), rows[0], (20, None, None, None, None, None, None, None, None), (21, "", "xx", "s", 0, "", 0, "", 0), (22, prose(rng, 9) + " " + item, "xx", "s", 1, "", 0, "", 0)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "tokens":
                assert out.columns == docs.columns
            out.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{len(some)}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{len(some)}"))
        assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == ([*((False, i) for i in range(12)), (True, None)] if some else [])


def test_addresses_are_evidence(spark, tmp_path):
    """Texts that say nothing themselves are named by their host, else by its domain, else by the suffix; whole pages too."""
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcde"), "xx", "a.one.xx") for i in range(60)] + [(i, make("pqrst"), "yy", "b.two.yy") for i in range(60, 120)]
    rows += [(200, "ζ", None, "a.one.xx"), (201, "ζ", None, "new.two.yy"), (202, "ζ", None, "other.yy"), (203, "ζ", None, "b.two.yy")]
    got = {r.doc_id: r.lang_id for r in language_id.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("doc_id >= 200").collect()}
    assert got == {200: "xx", 201: "yy", 202: "yy", 203: "yy"}
    pages = [(i, f"http://{host}/{i}", f'<html{"" if lang is None else f" lang={lang}"}><script>var zzzz</script><p>{t}</p></html>') for i, t, lang, host in rows] + [(300, None, None), (301, "", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.lang_id for r in language_id.language_of_pages(spark, str(tmp_path)).collect()}
    assert found == {**{i: "xx" for i in range(60)}, **{i: "yy" for i in range(60, 120)}, **got, 300: "und", 301: "und"}


# -- hot classes ------------------------------------------------------------------------------------------------------
def test_a_class_of_copies_is_dealt_out_when_it_gets_its_label(spark, monkeypatch):
    from loomgraph.llm import common, jaccard_join

    rng = random.Random(12)
    words = lambda k: " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") for _ in range(k))
    hot = words(60)
    rows = [(k, hot) for k in range(2000)] + [(2000, hot + " x"), (2001, "y " + hot)] + [(3000 + k, words(40)) for k in range(200)]
    asked = []
    join_groups = common.join_groups

    def spied(rows, groups, keys, size, total):
        if keys == ["rep"]:
            asked.append({r["rep"]: r[size] for r in groups.collect()})
        return join_groups(rows, groups, keys, size, total)

    monkeypatch.setattr(jaccard_join, "join_groups", spied)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i <= 2001 else i for i, _ in rows}
    assert asked and asked[0][0] == 2000 and asked[0].keys() >= {0, 2000, 2001}


def test_index_rows_are_made_of_hardly_any_keys_but_the_shared_ones(spark):
    """Entries that no other set has are sorted out before rows are made of them: few in a thousand may pass."""
    from loomgraph.llm import jaccard_join as J

    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(300)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:6])], "id long, text string")
    plan = {b: (0, 40) for b in range(J._band(296, 80) - 1, J._band(296, 80) + 1)}
    total = len(texts) * 2 * (40 + 296)
    shared, bits = J._shared_keys(docs, 5, 80, plan, total)
    made = J._shared_entries(docs, 5, 80, plan, shared, bits).select("mark", "id").collect()
    marks = {r["mark"] for r in shared.collect()}
    of_copies = [r for r in made if r["id"] < 6 or r["id"] >= 60]
    assert len(marks) > 6 * 296 and sum(r["mark"] in marks for r in of_copies) >= 12 * 296
    assert sum(r["mark"] not in marks for r in made) * 200 < total


def test_a_differing_passage_whose_seeds_all_have_earlier_holders(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage = words(60)
    rows = [(k + 1, " ".join(words(40) + passage[at : at + 30] + words(40))) for k, at in enumerate(range(0, 31, 3))]
    changed = [w if k % 12 != 6 else "changed" for k, w in enumerate(passage)]
    rows += [(100, " ".join(words(30) + passage + words(30))), (200, " ".join(words(30) + changed + words(30))), (300, " ".join(words(90)))]
    got = {(r.doc_id, r.source_id, r.start_word, r.end_word, r.distance) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == {(200, 100, 30, 90, 5)}


def test_no_holder_of_a_passage_goes_for_its_runs_of_three_words():
    rng = random.Random(5)
    common = [f"w{k}" for k in range(12)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"x{rng.randrange(10**6)}" for _ in range(n)]
    seed, found = ["one", "two", "three", "four", "five"], 0
    base = words(30) + seed + words(30)
    holders, texts = substring_dedup.Holders(), []
    for i in range(60):
        text = words(40) + [w if w in seed or rng.random() > i / 150 else "y" for w in base] + words(40)
        texts.append((i, text, text.index("one")))
        holders.add(i, 0, texts[-1][2], np.frombuffer(substring_dedup.codes(" ".join(text)), np.uint8))
    for i, text, at in texts:
        near = {a for a, *_ in holders.near(i, at, np.frombuffer(substring_dedup.codes(" ".join(text)), np.uint8))}
        for j, other, there in texts[:i]:
            mine, theirs = ([w.encode() for w in t] for t in (text, other))
            if substring_dedup.aligned(mine, theirs, (at, at + substring_dedup.SEED, there, there + substring_dedup.SEED)):
                found += 1
                assert j in near
    assert found > 50


def test_a_task_of_the_near_copies_index_holds_little(monkeypatch):
    """The arrays of a task that counts 1,300,000 marks, beside its texts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(5000)]
    band = jaccard_join._band(396, 80)
    taken = []

    class Frame:
        def select(self, *_):
            return self

        groupBy = applyInArrow = select

    monkeypatch.setattr(jaccard_join, "in_arrow", lambda df, run, *_: taken.append(run) or df)
    monkeypatch.setattr(jaccard_join, "cut", lambda df: df)
    jaccard_join._shared_keys(Frame(), 5, 80, dict.fromkeys((band, band - 1), (70, 10)), 1_300_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 1000)), pa.array(texts[k : k + 1000])], names=["id", "text"]) for k in range(0, 5000, 1000)]
    tracemalloc.start()
    try:
        assert sum(batch.num_rows for batch in taken[0](iter(batches))) > 16
        assert tracemalloc.get_traced_memory()[1] < 40_000_000
    finally:
        tracemalloc.stop()


def test_runs_of_one_word_make_no_pairs(spark):
    """Seeds of one word over and over, whose surroundings have no passage, are sifted out; those with one stay."""
    rng = random.Random(8)
    some = lambda k: [f"v{rng.randrange(3000)}" for _ in range(k)]
    texts = [[*["the"] * rng.randint(6, 39), *["of"] * rng.randint(6, 39), *some(60)] for _ in range(40)]
    common = some(30)
    for k in (50, 51):
        texts.append([*some(20), *["the"] * 25, *common[: 10 + k % 2], f"x{k}", *common[11:], *some(30)])
    rows = []
    for i, words in enumerate(texts):
        at = words.index("the")
        rows.append((7, i, at, True, 1, 0, bytearray(substring_dedup.codes(" ".join(words)))))
    around = spark.createDataFrame(rows, "key long, id long, place long, asks boolean, parts int, `from` long, around binary")
    pairs = {(r.a, r.b) for r in substring_dedup._sift_seeds(around).collect()}
    found = set()
    for b, mine in enumerate(texts):
        for a, other in enumerate(texts[:b]):
            x, y = mine.index("the"), other.index("the")
            if substring_dedup.aligned([w.encode() for w in mine], [w.encode() for w in other], (x, x + substring_dedup.SEED, y, y + substring_dedup.SEED)):
                found.add((a, b))
    assert (40, 41) in found and found <= pairs and len(pairs) <= 2 * len(found) + 5


def test_groups_beyond_a_broadcast_take_one_join(spark, monkeypatch):
    """Hot keys are dealt out by constants of the plan: rows aren't joined for that first."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = [(k % 7 if k < 900 else k, "a" if k % 2 else None, k) for k in range(2000)]
    groups = {}
    for k, a, _ in rows:
        groups[k, a] = groups.get((k, a), 0) + 1
    left = spark.createDataFrame([*rows, (5000, "a", -1)], "k int, a string, v long")
    right = spark.createDataFrame([(k, a, n) for (k, a), n in groups.items()], "k long, a string, n long").filter("n <> 2")
    for keys in (["k"], ["k", "a"]):
        held = right if len(keys) == 2 else right.filter("a = 'a'").drop("a")
        joined = common.join_groups(left, held, keys, "n", len(rows))
        known = {tuple(r[c] for c in keys): r["n"] for r in held.collect() if None not in [r[c] for c in keys]}
        want = sorted((v, known.get((k, a)[: len(keys)])) for k, a, v in left.collect())
        assert sorted((r.v, r.n) for r in joined.collect()) == want
        assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
