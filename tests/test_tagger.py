"""The tagger on names and frames that it never saw, its Viterbi against enumeration, and its table form."""

import itertools
import random

import numpy as np
import pytest

from loomgraph.plans import linking, relevance, tagger

FRAMES = [
    "What is the {METRIC} of {COMPANY}?", "Does {COMPANY} lend to {COMPANY}?", "Compare {COMPANY} and {COMPANY} on {METRIC}.", "Which bank has the highest {METRIC} in {PLACE}?", "How many branches does {COMPANY} have in {PLACE}?",
    "Who supplies {COMPANY} with steel?", "Is the {METRIC} of {COMPANY} above its peers?", "Where is {COMPANY} based?", "What happens to {COMPANY} if oil gets dearer in {PLACE}?", "List all owners of {COMPANY}.", "Tell me how {PLACE} matters to {COMPANY}",
]
NEW = ["Has {COMPANY} raised its {METRIC} in {PLACE}?", "Which branches of {COMPANY} are in {PLACE}?", "Does {COMPANY} have the highest {METRIC}?"]

#: Written after the tagger was settled on the frames above, and measured once.
FRESH = ["Did {COMPANY} report a lower {METRIC} than {COMPANY}?", "Show the {METRIC} for {PLACE}.", "When did {COMPANY} open in {PLACE}?", "Why is the {METRIC} at {COMPANY} so weak?"]


def names(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ro", "di", "ka", "len", "sto", "mi", "ru"]) for _ in range(rng.randint(2, 3)))
    companies = [word().title() + rng.choice([" Bank", " Steel", " Finance", " Motors", ""]) for _ in range(60)] + [word()[:4].upper() + " Ltd." for _ in range(20)]
    metrics = [f"{a} {b}" for a in ("net", "gross", "cost", "loan", "deposit", "capital") for b in ("margin", "ratio", "growth", "income")]
    return {"COMPANY": companies, "METRIC": metrics, "PLACE": [word().title() + rng.choice(["land", "pur", "stan"]) for _ in range(30)]}


@pytest.fixture(scope="module")
def model():
    return tagger.train(tagger.labelled(FRAMES, names(1), 1500))


def test_names_and_frames_that_it_never_saw(model):
    for frames, seed, least in ((FRAMES, 2, 0.95), (NEW, 3, 0.85), (FRESH, 9, 0.85)):
        made = tagger.labelled(frames, names(seed), 300, seed)
        precision, recall = tagger.scored(model.spans([t for t, _ in made]), [s for _, s in made])
        assert min(precision, recall) >= least, (seed, precision, recall)


def test_paths_equal_enumeration():
    rng = np.random.default_rng(5)
    model = tagger.Tagger(["O", "B-X", "I-X"], np.zeros((tagger.BUCKETS, 3)), rng.normal(size=(4, 3)))
    texts = ["a", "", "b cc", "dd e, f", "a b a c", None, "g h i j k"]
    for t in texts:
        for i in tagger.features([t[a:b] for a, b in tagger.tokens(t)] if t else []).ravel():
            model.emit[i] = rng.normal(size=3)
    for t, got in zip(texts, model.paths(texts)):
        at = tagger.tokens(t)
        if not at:
            assert got == []
            continue
        emit = model.emit[tagger.features([t[a:b] for a, b in at])].sum(axis=1)
        worth = lambda p: model.move[-1, p[0]] + sum(emit[k, x] for k, x in enumerate(p)) + sum(model.move[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(got) == max(itertools.product(range(3), repeat=len(at)), key=worth)
        assert tagger._viterbi(emit, model.move) == got


def test_a_table_is_tagged_and_the_resolver_takes_the_spans(spark, model):
    made = tagger.labelled(NEW, names(4), 50, 4)
    rows = [(k, t, "old") for k, (t, _) in enumerate(made)] + [(50, None, "old"), (51, "", "old"), (52, "?!", "old")]
    got = {r.id: [tuple(s) for s in r.spans] for r in tagger.tagged(spark.createDataFrame(rows, "id int, text string, spans string").repartition(3), "text", model).collect()}
    assert got == {k: spans for k, spans in enumerate(model.spans([t for _, t, _ in rows]))}
    assert got[50] == got[51] == []
    question = "Does Lenstoba Bank lend to Alpha Bank?"
    resolver = linking.Resolver(linking.Names({"Alpha Bank": ("C1", "COMPANY")}), None, model.hook, lambda words, kinds: linking.Match(words, f"new:{words}", "COMPANY", words, 0.9, "semantic", 0, 0))
    assert {m.id for m in resolver.resolve(question)} == {"C1", "new:Lenstoba Bank"}
    assert tagger.train([]).spans(["a b"]) == [[]]


def test_the_engine_takes_an_embedding_as_its_scorer():
    class Model:
        def vectors(self, texts):
            return np.array([[1.0, 0.0] if "red" in t else [0.6, 0.8] for t in texts])

    score = relevance.embedded(Model())
    assert score([{"fact": "a red fox"}, {"fact": "blue"}], "red?") == 1.0 and score([{"fact": "blue"}], "red?") == pytest.approx(0.6) and score([], "red?") == 0.0
