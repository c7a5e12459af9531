"""Corpus operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, ties, repeats,
empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, decontamination, exact_dedup, html_extraction, jaccard_join, language_id, lm_scoring, quality, substring_dedup, url_filter
from loomgraph.llm.common import plain_words

SYLLABLES = ["ka", "lo", "mir", "ten", "su", "val", "or", "qui", "da", "nes"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, k):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), k):
        words[i] = prose(rng, 1) + "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies, a group of near copies of one text, nulls, empty and odd ones, and a repeated row."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 160)) for _ in range(30)]
    texts = base + [base[0], base[0], base[1]] + [edited(rng, base[2], 1), edited(rng, base[3], 2), edited(rng, base[4], 12)]
    texts += [edited(rng, base[5], rng.randint(1, 6)) for _ in range(45)]
    texts += [None, "", "", " \n\t ", "one", "one two", "One TWO", "a b c", "A  b\nc", "é É", "x" * 5000, prose(rng, 6000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[0], (7, base[8])]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def empty(spark):
    return frame(spark, [])


# -- exact dedup ------------------------------------------------------------------------------------------------------
def test_exact_groups(spark, corpus):
    rows = [*corpus, (None, "one"), (None, None)]
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(max((x for x in by[t or ""] if x is not None), default=None)), len(by[t or ""])) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(by)


def test_exact_dedup_drops_and_carries(spark):
    rows = [(1, "a", "p"), (2, "a", "q"), (2, "a", "q"), (None, None, "r"), (3, "", "s")]
    df = frame(spark, rows, ", _text string").withColumnRenamed("_text", "_len")
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(2, "a", "q"), (3, "", "s")]
    assert exact_dedup.exact_groups(empty(spark)).count() == exact_dedup.drop_exact_copies(empty(spark)).count() == 0


def test_exact_dedup_is_native(spark, corpus):
    plan = exact_dedup.exact_groups(frame(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# -- Jaccard join -----------------------------------------------------------------------------------------------------
def brute_components(rows, n, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = plain_words(t)
        sets[i].append(set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)} if w else set())
    label = {i: i for i in sets}
    while True:
        was = dict(label)
        for a, b in itertools.combinations(sets, 2):
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                label[a] = label[b] = min(label[a], label[b])
        if was == label:
            return sets, label


@pytest.mark.parametrize("n, percent, listed", [(3, 90, 32), (3, 90, 2), (5, 80, 2)])
def test_components(spark, corpus, n, percent, listed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LISTED", listed)
    sets, label = brute_components(corpus, n, percent)
    got = jaccard_join.jaccard_components(frame(spark, corpus), n=n, percent=percent).collect()
    assert len(got) == len(corpus)
    assert {(r.doc_id, r.component_id) for r in got} == set(label.items())
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(s)) for i, each in sets.items() for s in each)


def test_shelves_hold_all_links():
    """Sets that differ as much as linked ones can share a key, whatever the allocation."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for size in [*range(1, 40), 97, 300]:
            tokens = rng.integers(1, 1 << 62, size * 2).astype(np.uint64)
            for other in {size, size - 1, -(-size * percent // 100)} - {0}:
                most = (size + other) * (100 - percent) // (100 + percent)
                gone = (most + size - other) // 2
                a = np.unique(tokens[:size])
                b = np.unique(np.concatenate([tokens[gone:size], tokens[size : size + other - (size - gone)]]))
                if len(b) != other or size - gone < 0 or len(np.setxor1d(a, b)) > most or not most:
                    continue
                shelf = jaccard_join._band(min(len(a), len(b)), percent)
                budget = jaccard_join.shelf_budget(shelf, percent)
                assert most <= budget
                for plan in [(budget + 1, 0), (max(0, budget + 1 - 2 * ((budget + 1) // 2)), (budget + 1) // 2), (0, -(-(budget + 1) // 2))]:
                    assert np.intersect1d(jaccard_join.index_keys(a, shelf, *plan), jaccard_join.index_keys(b, shelf, *plan)).size


def test_near_copies_keep_one_and_all_columns(spark, corpus):
    df = frame(spark, [(i, t, "k") for i, t in corpus], ", key string")
    _, label = brute_components(corpus, 5, 80)
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in label.items() if i == c}
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


# -- decontamination --------------------------------------------------------------------------------------------------
def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_leaks_against_all_alignments(spark):
    rng = random.Random(2)
    items = [(k, prose(rng, n)) for k, n in enumerate([4, 5, 9, 12, 30, 41])] + [(90, None), (91, "")]
    texts = [None, "", "short"] + [prose(rng, 40) + " " + edited(rng, items[k][1], e) + ". " + prose(rng, 300) for k in range(1, 6) for e in range(0, min(12, len(items[k][1].split())))]
    got = decontamination.with_leaks(frame(spark, list(enumerate(texts)), "").withColumn("leaks", F.lit("old")), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, x.item_id): x for r in got.collect() for x in r.leaks}
    want = {}
    for d, t in enumerate(texts):
        for k, item in items:
            w = decontamination.words_of(item)
            if len(w) >= decontamination.MIN_WORDS and (e := edit_distance(w, decontamination.words_of(t))) <= int(0.2 * len(w)):
                want[d, k] = e
    assert {key: x.distance for key, x in found.items()} == want
    for (d, k), x in found.items():
        assert edit_distance(decontamination.words_of(items[k][1]), decontamination.words_of(texts[d])[x.start_word : x.end_word]) == x.distance
    assert decontamination.drop_leaked(frame(spark, [(1, "a")]), spark.createDataFrame([], "item_id long, text string")).count() == 1
    assert decontamination.drop_leaked(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# -- BPE --------------------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.read_ranks(path)
    own = byte_bpe.Codec(tokens, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t is not None}, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " a ", "a \n b", "don't  we'll", "x\x1cy", "x \x1c y", "\x85a", "a\u3000 b", "  \n", "a" * 3000, "ab" * 500 + " é" * 40, "日本語 テ", "<|endoftext|>", "🙂🙂 a", "a\r\n b"]
    texts += ["".join(rng.choice("ab'st12 \n\t.,!é日\x1c\u3000  ") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for got, text in zip(own.encode_batch(texts), texts):
        assert got == library.encode_ordinary(text)
        assert own.decode(got) == text.encode()


def test_bpe_round_trip(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = frame(spark, [(1, None, 5), (2, "", 6), (2, "héllo wörld", 7)], ", n_tokens int")
    out = byte_bpe.decode(byte_bpe.encode(df, path, P.PATTERN), path)
    assert sorted(bytes(r.bytes).decode() for r in out.collect()) == ["", "", "héllo wörld"]
    digests = byte_bpe.encode_decode(df, path, P.PATTERN).collect()
    assert {r.decoded_sha256 for r in digests} == {hashlib.sha256(t.encode()).hexdigest() for t in ("", "héllo wörld")}
    assert byte_bpe.encode_decode(empty(spark), path, P.PATTERN).count() == 0


# -- language ID ------------------------------------------------------------------------------------------------------
def test_language(spark):
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcde"), "xx", "h1", 1) for i in range(60)] + [(i, make("pqrst"), "yy", "h2", 1) for i in range(60, 120)]
    rows += [(200, make("pqrst"), "xx", "h2", 1), (201, None, "xx", "h1", 1), (202, "123 !!", None, None, 1), (203, make("abcde"), None, None, 1), (203, make("abcde"), None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_id int")
    got = {r.doc_id: (r.lang_id, r.lang_kept) for r in language_id.identify_documents(df).collect()}
    assert got == {**{i: ("xx", True) for i in range(60)}, **{i: ("yy", True) for i in range(60, 120)}, 200: ("yy", True), 201: ("und", False), 202: ("und", False), 203: ("xx", True)}
    assert language_id.identify_documents(df.limit(0)).count() == 0
    assert {r.lang_id for r in language_id.identify_documents(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- HTML -------------------------------------------------------------------------------------------------------------
def test_rare_languages(spark, monkeypatch):
    """Twelve declared rows in 5,000 are a language of their own, whatever else is in the table and in however many blocks."""
    monkeypatch.setattr(language_id, "LANGUAGES_AT_ONCE", 2)
    rng = random.Random(9)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "rare": "pqrst", "odd": "uvwxy"}
    say = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(12))
    rows = [(i, say(lang), lang if i % 3 or lang == "rare" else None) for i, lang in enumerate(["aa"] * 2500 + ["bb"] * 2000 + ["cc"] * 486 + ["rare"] * 12)]
    rows += [(9000, say("rare"), None), (9001, say("aa"), None), (9002, say("odd"), "odd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("one"))
    got = {r.doc_id: r.lang_id for r in language_id.identify_documents(docs).filter("doc_id >= 4980").collect()}
    assert [got[i] for i in (*range(4986, 4998), 9000)] == ["rare"] * 13 and got[9001] == "aa" and got[4985] == "cc"


def test_html_marginals_are_exact():
    """Messages give the same marginals as the sum over all labellings of a small tree."""
    model = html_extraction.train(html_extraction.labelled_pages(60))
    nodes = html_extraction.parse("<body><nav><a>x y</a></nav><article><h1>T</h1><p>" + "word " * 30 + "</p></article><footer>z</footer>")
    seen = html_extraction._evidence(nodes)
    total, on = 0.0, np.zeros(len(nodes))
    for states in itertools.product((0, 1), repeat=len(nodes)):
        logp = model.root[states[0]]
        for i, (n, f, s) in enumerate(zip(nodes, seen, states)):
            logp += sum(t[f[0]][s][v] for t, v in zip(model.own, f[2:])) + (model.edge[f[0]][f[1]][states[n.parent]][s] if i else 0)
        total += math.exp(logp)
        on += math.exp(logp) * np.array(states)
    assert np.allclose(html_extraction.marginals(model, nodes), on / total)


def test_html_accuracy_and_text(spark):
    model = html_extraction.train(html_extraction.labelled_pages())
    right = of = 0
    for page in html_extraction.labelled_pages(100, 99):
        nodes = html_extraction.parse(page)
        for n, p in zip(nodes, html_extraction.marginals(model, nodes)):
            n.label = (nodes[n.parent].label if n.parent >= 0 else 0) if n.label is None else n.label
            right, of = right + bool(n.runs) * ((p >= 0.5) == bool(n.label)), of + bool(n.runs)
    assert right / of > 0.96
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it now.</div><article><h1>Ti &amp; t</h1><p><b>One   two\nthree of the long enough text.<br><p>Second &eacute; paragraph here, with some more words in it.</article><footer>&copy; x</footer></body></html>"
    rows = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<p", "t")], "page_id int, html string, text string")
    got = {r.page_id: r.text for r in html_extraction.with_main_text(rows, model).collect()}
    assert got[1] == "Ti & t\n\nOne two three of the long enough text.\n\nSecond é paragraph here, with some more words in it."
    assert got[2] == got[3] == ""


# -- quality ----------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == (y[3000:] > 0)).mean() > 0.9
    assert np.all(quality.fit(x[:0], y[:0]).score(x[:2]) == 0.5)


def test_quality_of_odd_texts(spark):
    df = frame(spark, [(1, None, 9), (2, "", 9), (3, "a" * 9000, 9)], ", score int")
    rows = quality.with_quality(df, quality.fit(np.zeros((2, len(quality.FEATURES))), np.array([0.0, 1.0]))).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)


# -- LM scoring -------------------------------------------------------------------------------------------------------
def test_lm_counts_and_model(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 500)
    df = frame(spark, corpus)
    part = lambda i: zlib.crc32(str(i).encode()) % 7
    got = sorted(lm_scoring.score_texts(df, lm_scoring.fold(F.col("doc_id"), 7)).collect())
    c = collections.Counter()
    for i, t in corpus:
        if part(i) != 2:
            c.update([*plain_words(t), b""])
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*plain_words(t), b""])
    want = sorted((i, len(plain_words(t)) + 1, sum(c[w] > 0 for w in [*plain_words(t), b""]), n, round(base(t), 6)) for i, t in corpus)
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got] == want
    assert all(r.score < 0 for r in got) and lm_scoring.score_texts(empty(spark), F.lit(0)).count() == 0


def test_lm_weights_sum_to_one_and_prefer_what_predicts():
    cell = (3 * lm_scoring._CELLS + 5) * lm_scoring._CELLS + 60
    w = lm_scoring.learn_weights([(cell, 100.0, 50.0, 0.1)], 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.9 and w[0, 0] == 0


# -- substring dedup --------------------------------------------------------------------------------------------------
def test_passages(spark):
    rng = random.Random(8)
    shared, other = prose(rng, 80), prose(rng, 70)
    rows = [(i, f"{prose(rng, 60)} {shared} {prose(rng, 40)}") for i in range(6)]
    rows += [(10, f"{prose(rng, 30)} {edited(rng, shared, 3)} {prose(rng, 90)}"), (11, f"{other} {prose(rng, 50)}"), (12, f"{prose(rng, 20)} {other}")]
    rows += [(20, prose(rng, 300)), (21, f"{prose(rng, 90)} {' '.join(shared.split()[:20])} {prose(rng, 90)}"), (22, None), (23, ""), (24, "the " * 400), (None, rows[0][1]), (5, rows[5][1])]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.source_id) for r in got} >= {(i, 0) for i in (*range(1, 6), 10)} | {(12, 11)}
    assert {r.doc_id for r in got} == {*range(1, 6), 10, 12}
    text = dict(rows)
    for r in got:
        mine, theirs = plain_words(text[r.doc_id])[r.start_word : r.end_word], plain_words(text[r.source_id])[r.source_start : r.source_end]
        assert len(mine) >= 50 and edit_distance(mine, theirs) <= r.distance <= 0.2 * len(mine)
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0


def test_short_passages_with_differing_words(spark):
    """Passages just over the least length whose edits leave a seed somewhere: every word set apart is in a passage's reach."""
    rng, rows = random.Random(4), []
    for k, (n, at) in enumerate([(52, [8, 13, 40, 46]), (52, [3, 24, 28, 33, 48]), (60, [4, 9, 14, 34, 39, 44]), (60, [6, 12, 18, 40, 46, 52]), (80, [5, 10, 15, 20, 42, 47, 52, 57, 62, 70])]):
        shared = [f"{w}{k}{i}" for i, w in enumerate(prose(rng, n).split())]
        changed = [f"new{k}x{i}" if i in at else w for i, w in enumerate(shared)]
        rows += [(2 * k, f"{prose(rng, 40)} {' '.join(shared)} {prose(rng, 40)}"), (2 * k + 1, f"{prose(rng, 30)} {' '.join(changed)} {prose(rng, 50)}")]
    got = {(r.doc_id, r.source_id): r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {(2 * k + 1, 2 * k) for k in range(5)}
    assert [(r.end_word - r.start_word, r.distance) for _, r in sorted(got.items())] == [(52, 4), (52, 5), (60, 6), (60, 6), (80, 10)]


def test_every_exact_run_is_in_a_passage(spark):
    """Lines that first stand in several documents, single words over and over, and repeated lines, against all runs of 50 words."""
    rng = random.Random(12)
    lines = [[f"{w}{k}" for w in prose(rng, 40).split()] for k in range(6)]
    own = lambda n: prose(rng, n).split()
    texts = [own(60) + lines[0] + own(20), lines[1] + own(70), own(10) + lines[0] + lines[1] + own(50), own(33) + lines[0] + lines[1] + own(8)]
    texts += [own(30) + ["the"] * 60 + own(20), own(9) + ["the"] * 180, ["the"] * 130, own(12) + lines[2][:30] + own(40)]
    around = [own(10), own(10)]
    texts += [own(20) + around[0] + lines[2][:30] + around[1] + own(7), own(25) + around[0] + lines[2][:30] + around[1] + own(31)]
    texts += [lines[3][:8] * 9 + own(20), own(20) + lines[3][3:8] + lines[3][:8] * 12 + own(5), own(80)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    for i, w in enumerate(texts):
        earlier = {tuple(o[k : k + 50]) for o in texts[:i] for k in range(len(o) - 49)}
        for k in range(len(w) - 49):
            if tuple(w[k : k + 50]) in earlier:
                assert any(r.doc_id == i and r.start_word <= k and k + 50 <= r.end_word for r in got), (i, k)
    assert {r.doc_id for r in got} == {3, 5, 6, 9, 11}
    for r in got:
        mine, theirs = texts[r.doc_id][r.start_word : r.end_word], texts[r.source_id][r.source_start : r.source_end]
        assert len(mine) >= 50 and edit_distance(mine, theirs) <= r.distance <= 0.2 * len(mine)


def test_distance_and_reach():
    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, v in enumerate(x, 1):
            last = [i]
            for j, w in enumerate(y, 1):
                last.append(min(row[j - 1] + (v != w), row[j] + 1, last[-1] + 1))
            row = last
        return row[-1]

    rng = random.Random(6)
    for _ in range(200):
        x, y = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        assert substring_dedup.distance(x, y) == edits(x, y)
        assert all(edits(x[:i], y[:j]) == e for e, i, j in substring_dedup.reaches(x, y))


def test_chain_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        x, y = np.array(rng.sample(range(40), n)), np.array([rng.randint(0, 40) for _ in range(n)])
        best = 0.0
        for k in range(1, n + 1):
            for some in itertools.combinations(sorted(zip(x.tolist(), y.tolist())), k):
                if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(some, some[1:])):
                    gaps = some[-1][0] - some[0][0] + some[-1][1] - some[0][1]
                    best = max(best, (substring_dedup.SEED * k - substring_dedup.GAP_COST * gaps, some[0][0], some[-1][0]) [0])
        a, b, c, d = substring_dedup.chains(x, y)[0]
        inside = sorted((p, q) for p, q in zip(x.tolist(), y.tolist()) if a <= p <= b - substring_dedup.SEED and c <= q <= d - substring_dedup.SEED)
        assert best >= substring_dedup.SEED and inside[0] == (a, c)


# -- URLs -------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/x", "http://net/", "http://net", "http://xnet/", "https://m.example.net/en/1?q", "http://example.net/en", "http://b.example.com/de/5#t", "http://b.example.com/fr/5", "http://z.org/fr/x", "ftp://z.org/fr", "http://a.org?x://y/z"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    a = "allow"
    assert got == {
        0: ("", "", None, a), 1: ("", "", None, a), 2: ("", "", None, a), 3: ("", "", None, a), 4: ("a.net", "/x", "net/", "block"), 5: ("net", "/", "net/", "block"), 6: ("net", "", None, a), 7: ("xnet", "/", None, a),
        8: ("m.example.net", "/en/1", "example.net/en/", a), 9: ("example.net", "/en", "net/", "block"), 10: ("b.example.com", "/de/5", "example.com/de/", "block"), 11: ("b.example.com", "/fr/5", None, a),
        12: ("z.org", "/fr/x", "org/fr/", a), 13: ("z.org", "/fr", None, a), 14: ("a.org", "", None, a),
    }
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_templates_learn_purity(spark):
    rows = [(k, f"http://h.com/bad/{k}.html") for k in range(40)] + [(k, f"http://h.com/good/{k}.html") for k in range(40, 80)]
    df = spark.createDataFrame(rows, "page_id int, url string")
    rules = [("block", "h.com", f"/bad/{k}.") for k in range(30)] + [("allow", "h.com", f"/good/{k}.") for k in range(40, 70)]
    got = {r.page_id: (r.verdict, r.template) for r in url_filter.judge_urls(df, rules=rules).collect()}
    assert {got[k] for k in range(30, 40)} == {("block", "/bad/*")} and {got[k] for k in range(70, 80)} == {("allow", "/good/*")}
