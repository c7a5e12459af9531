"""The text embedding against a plain SVD, on planted topics, and with its gate and links."""

import random

import numpy as np
import pytest

from loomgraph.operators import embedding, search
from loomgraph.operators.embedding import Embedding


@pytest.fixture(scope="module")
def topics(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = [["".join(rng.choice(letters) for _ in range(7)) for _ in range(30)] for _ in range(5)]
    common = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(20)]
    rows = []
    for k in range(400):
        topic = k % 5
        rows.append((k, " ".join(rng.sample(vocabulary[topic], 8) + rng.sample(common, 5)), topic))
    rows += [(400, None, 0), (401, "", 0), (402, "!!!", 1)]
    df = spark.createDataFrame(rows, "id long, text string, topic int").repartition(5)
    return rows, df, embedding.trained(df, "text", rank=8, width=1024)


def test_directions_equal_those_of_a_plain_svd(topics):
    rows, _, model = topics
    texts = [t for _, t, _ in rows if t]
    row, bucket, value = embedding._rows(texts, model.idf)
    x = np.zeros((len(texts), 1024))
    np.add.at(x, (row, bucket), value)
    plain = np.linalg.svd(x, full_matrices=False)[2][:4].T
    cosines = np.linalg.svd(plain.T @ model.directions)[1]
    assert cosines.min() > 0.999


def test_texts_of_a_topic_are_near_and_the_gate_keeps_them(spark, topics):
    rows, df, model = topics
    vectors = model.embed(df, "text").select("id", "topic", "embedding")
    assert {r.id for r in vectors.filter("embedding IS NULL").collect()} == {400, 401, 402}
    asked = vectors.filter("id % 20 = 0 AND id < 400")
    near = search.joined_top_k(asked.withColumnRenamed("id", "q"), vectors, 11, "q", "id").collect()
    topic = {i: t for i, _, t in rows}
    right = [topic[r.q] == topic[r.id] for r in near if r.q != r.id]
    assert sum(right) / len(right) > 0.97
    pairs = [(float(r.sim), topic[r.q] == topic[r.id]) for r in search.joined_top_k(asked.withColumnRenamed("id", "q"), vectors, 400, "q", "id").collect() if r.q != r.id]
    df = spark.createDataFrame(pairs, "sim double, relevant boolean")
    for recall in (0.9, 0.95, 1.0):
        floor = embedding.floor_for(df, recall)
        got = embedding.measured(df, floor).first()
        assert got.recall >= recall - 1e-6 and got.precision > 0.6
        hits = sorted(s for s, r in pairs if r)
        assert floor == pytest.approx(hits[int(np.floor((1 - recall) * len(hits) + 1e-9))])
    assert embedding.floor_for(df.filter("NOT relevant")) is None
    assert embedding.measured(df.limit(0), 0.5).first().recall is None


def test_a_table_of_spans_is_linked(spark, topics):
    names = [("n1", "net interest margin", "METRIC"), ("n2", "net interest income", "METRIC"), ("n3", "interest", "TOPIC"), ("n4", "Axis Bank", "COMPANY"), ("n5", "Axis", "TOPIC"), ("n6", "", "TOPIC"), ("n7", None, "TOPIC")]
    df = spark.createDataFrame(names, "id string, name string, type string")
    model = embedding.trained(df, "name", rank=16, width=512)
    spans = spark.createDataFrame([(1, "Net Interest Margin", ["METRIC"]), (2, "net interest margins", None), (3, "axis", ["TOPIC"]), (4, "zzz qqq", []), (5, None, []), (6, "axis bank ltd", ["COMPANY"])], "span_id long, text string, kinds array<string>")
    got = {r.span_id: r for r in embedding.linked_spans(spans, df, model, "kinds", floor=0.4).collect()}
    assert {k: r.id for k, r in got.items()} == {1: "n1", 2: "n1", 3: "n5", 6: "n4"}
    assert got[1].boosted == pytest.approx(got[1].sim + 0.55) and got[3].boosted >= 0.85


def test_equal_spans_are_embedded_once(spark, topics, monkeypatch):
    _, _, model = topics
    names = spark.createDataFrame([("n1", "net interest", "METRIC"), ("n2", "net interest", "TOPIC")], "id string, name string, type string")
    given = []
    made = embedding.Embedding.embed
    monkeypatch.setattr(embedding.Embedding, "embed", lambda self, df, *more: given.append(df.count()) or made(self, df, *more))
    model = embedding.trained(names, "name", rank=4, width=64)
    spans = spark.createDataFrame([(k, "net interest", ["TOPIC"] if k % 2 else [None]) for k in range(50)], "span_id long, text string, kinds array<string>")
    got = {r.span_id: r.id for r in embedding.linked_spans(spans, names, model, "kinds").collect()}
    assert got == {k: "n2" if k % 2 else "n1" for k in range(50)} and sorted(given) == [1, 2]


def test_no_texts(spark):
    model = embedding.trained(spark.createDataFrame([(None,)], "text string"), "text", rank=4, width=64)
    assert isinstance(model, Embedding) and model.vectors(["a b"]).any() == np.False_
    one = embedding.trained(spark.createDataFrame([("a b",), ("a b",)], "text string"), "text", rank=4, width=64)
    assert one.similarity("a b", "a b") == pytest.approx(1.0)
