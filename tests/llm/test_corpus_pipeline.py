"""The pipeline against a plain version of its stages."""

import collections
import itertools

from loomgraph.llm import decontamination
from loomgraph.llm.common import plain_words


def test_run(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(6)
    words = ["ka", "lo", "mir", "ten", "su", "val", "or", "qui", "da", "nes"]
    prose = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = [prose(60) for _ in range(20)]
    item = prose(30)
    texts += [texts[0], texts[1] + " more", prose(30) + " " + item, None, "123 456", ""]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    last = {}
    for i, t in kept.items():
        last[t] = max(i, last.get(t, -1))
    kept = {i: t for t, i in last.items()}
    sets = {i: set(zip(*[plain_words(t)[k:] for k in range(5)])) for i, t in kept.items()}
    group = {i: i for i in kept}
    for a, b in itertools.combinations(sorted(kept), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            group[b] = min(group[a], group[b])
    kept = {i for i in kept if group[i] == i and " ".join(decontamination.words_of(item)) not in " ".join(decontamination.words_of(kept[i]))}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(kept)
    assert all(r.n_tokens > 0 for r in got)
