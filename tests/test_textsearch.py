"""Search by words against a plain BM25, and fused rankings."""

import collections
import math
import random
import re

import pytest

from loomgraph.operators import textsearch
from loomgraph.operators.textsearch import B, K1


def plain(texts, queries, k, allowed=None):
    split = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t, _ in texts}
    kind = {i: x for i, _, x in texts}
    mean = sum(map(len, split.values())) / max(len(split), 1)
    df = collections.Counter(w for some in split.values() for w in set(some))
    out = {}
    for q, text, limits in queries:
        scores = {}
        for i, some in split.items():
            if allowed and limits is not None and kind[i] not in limits:
                continue
            tf = collections.Counter(some)
            hits = set(re.findall(r"[^\W_]+", (text or "").lower())) & set(tf)
            if hits:
                scores[i] = round(sum(math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * len(some) / mean)) for w in hits), 6)
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out[q, rank] = (i, s)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40))), rng.choice("xyz")) for i in range(300)]
    texts += [(300, None, "x"), (301, "", "y"), (302, "W0, w0! é", "z"), (303, texts[5][1], "x"), (304, "the the the", "y")]
    queries = [(q, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9))), rng.choice([None, ["x"], ["x", "y"], []])) for q in range(30)]
    queries += [(30, "w0 w1", None), (31, "unknown", None), (32, None, None), (33, "É the", None), (34, "w0 w0 w59", None)]
    return texts, queries, spark.createDataFrame(texts, "id long, text string, kind string"), spark.createDataFrame(queries, "query_id long, text string, allowed array<string>")


@pytest.mark.parametrize("frequent, k", [(0.0, 5), (0.02, 10), (0.1, 3), (0.1, 400), (1.0, 5)])
def test_bm25_equals_a_plain_one(spark, corpus, frequent, k):
    texts, queries, df, asked = corpus
    on = textsearch.index(df, "id", "text", ("kind",))
    for only in (None, {"kind": "allowed"}):
        rows = textsearch.bm25(asked, on, k, only=only, frequent=frequent).collect()
        want = plain(texts, queries, k, only)
        assert {(r.query_id, r["rank"]): r.id for r in rows} == {key: i for key, (i, _) in want.items()}
        assert all(r.score == pytest.approx(want[r.query_id, r["rank"]][1], abs=2e-6) for r in rows)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_bm25_of_texts_that_score_alike(spark, corpus, monkeypatch, k):
    texts, queries, df, asked = corpus
    texts = texts + [(1000 + i, *texts[i % 40][1:]) for i in range(200)]  # many of each
    df = spark.createDataFrame(texts, "id long, text string, kind string")
    for only in (None, {"kind": "allowed"}):
        want = plain(texts, queries, k, only)
        for most in (100_000, 3):
            monkeypatch.setattr(textsearch, "BROADCAST_ROWS", most)
            rows = textsearch.bm25_alike(asked, df, "id", k, only=only).collect()
            assert {(r.query_id, r["rank"]): r.id for r in rows} == {key: i for key, (i, _) in want.items()}
            assert all(r.score == pytest.approx(want[r.query_id, r["rank"]][1], abs=2e-6) for r in rows)


def test_only_words_that_are_asked_have_postings(spark, corpus):
    _, _, df, asked = corpus
    few = asked.filter("query_id = 30")
    on = textsearch.index(df, "id", "text", asked=textsearch.words_asked(few))
    assert {r.term for r in on.postings.select("term").distinct().collect()} == {"w0", "w1"}
    assert sorted(textsearch.bm25(few, on).collect()) == sorted(textsearch.bm25(few, textsearch.index(df, "id", "text")).collect())
    assert textsearch.bm25_alike(few, df.limit(0), "id").count() == textsearch.bm25_alike(few.limit(0), df, "id").count() == 0


def test_a_stored_index_and_few_rows(spark, corpus, tmp_path):
    _, _, df, asked = corpus
    on = textsearch.index(df, "id", "text")
    on.write(str(tmp_path / "index"))
    again = textsearch.TextIndex.read(spark, str(tmp_path / "index"))
    assert sorted(textsearch.bm25(asked, again).collect()) == sorted(textsearch.bm25(asked, on).collect())
    assert textsearch.bm25(asked, textsearch.index(df.limit(0), "id", "text")).count() == 0
    assert textsearch.bm25(asked.limit(0), on).count() == 0


def test_words_and_vectors_are_fused(spark):
    texts = spark.createDataFrame([(1, "red fox", "a"), (2, "red hen", "b"), (3, "blue fox", "a"), (4, "grey", "a")], "id long, text string, kind string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [1.0, 0.0], "b"), (4, [0.9, 0.1], "a")], "id long, embedding array<double>, kind string")
    asked = spark.createDataFrame([(7, "red fox", [1.0, 0.0]), (8, "fox", None), (9, None, [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    on = textsearch.index(texts, "id", "text", ("kind",))
    order = lambda rows: {q: [r.id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (7, 8, 9)}
    got = textsearch.hybrid(asked, on, vectors).collect()
    # words: 1, 2, 3; vectors: 2, 4, 1
    one = lambda *ranks: round(sum(1 / (60 + r) for r in ranks), 9)
    assert {r.id: r.score for r in got if r.query_id == 7} == {1: one(1, 3), 2: one(2, 1), 3: one(3), 4: one(2)}
    assert order(got) == {7: [2, 1, 4, 3], 8: [1, 3], 9: [1, 4, 2]}
    assert order(textsearch.hybrid(asked, on, vectors, kinds={"kind": ["a"]}).collect()) == {7: [1, 4, 3], 8: [1, 3], 9: [1, 4]}
