"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree on one feature's bins at a time; the trees of a feature add up to one lookup table. The
strongest pairs of what remains get tables over coarse bins. A text's score is the sum of its bins' entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import code_points, fold, in_arrow, kind_table, slices

#: Labelled rows that the classifier is fitted on at most, chosen by hash.
FIT_ROWS = 20_000
#: Bins of a feature and of a feature in a pair; pairs; rounds over all features and over all pairs; leaves' step and ridge.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, STEP, RIDGE = 32, 8, 6, 120, 60, 0.15, 1.0
#: Score from which a text is predicted to be good.
GOOD = 0.3

FEATURES = [
    "log_chars", "log_words", "word_chars", "lower", "upper", "digit", "space", "symbol", "bars", "marks", "bangs", "unique_words", "top_word", "same_next", "unique_lines", "line_words",
    "short_words", "long_words", "capital_words", "ended_words", "end_repeats",
]
_MARKS = "*#%&$"


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each whole text; zeros for empty ones."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in slices(texts):
        points, starts = code_points(texts[lo:hi])
        kinds = kind_table()[points]
        sums = [np.add.reduceat((kinds == k).astype(np.int64), starts) for k in range(5)]
        for i, text in enumerate(texts[lo:hi]):
            words = text.split()
            if not words:
                continue
            n, w = len(text), len(words)
            counts = Counter(words)
            lines = [x for x in text.split("\n") if x.strip()]
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
            letters = max(1, sums[1][i] + sums[2][i])
            out[lo + i] = (
                np.log(n), np.log(w), lengths.mean(), sums[1][i] / n, sums[2][i] / letters, sums[3][i] / n, sums[4][i] / n, (sums[0][i] - 1) / n, text.count("|") / w,
                sum(map(text.count, _MARKS)) / w, text.count("!") / w, len(counts) / w, max(counts.values()) / w, sum(map(eq, words, words[1:])) / w, len(set(lines)) / len(lines), np.log1p(w / len(lines)),
                (lengths <= 3).mean(), (lengths >= 12).mean(), sum(x[0].isupper() for x in words) / w, sum(x[-1] in ".," for x in words) / w, text.count(words[-1]) / w,
            )
    return out


@dataclass
class Gam:
    """Lookup tables over bins. edges[f]: the bins' inner limits; pairs: (f, g, edges of f, edges of g, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, ef, eg, table in self.pairs:
            total += table[np.searchsorted(ef, x[:, f], side="right"), np.searchsorted(eg, x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where to split a run of bins, and the gain; 0 and 0 where no split helps."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(np.argmax(gain))
    return (k + 1, float(gain[k])) if gain[k] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, bin by bin, of a tree of that depth on ordered bins."""
    cut, _ = _best_cut(g, h) if depth else (0, 0.0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree on two features' bins: one split of the first, then one of the second on either side; and its gain."""
    best, table = -1.0, np.zeros_like(g)
    for k in range(1, len(g)):
        trial, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, k), slice(k, None)):
            gg, hh = g[rows].sum(axis=0), h[rows].sum(axis=0)
            leaves = _tree(gg, hh, 1)
            trial[rows] = leaves
            gain += float((leaves * gg).sum())
        if gain > best:
            best, table = gain, trial
    return table, best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boosts log-loss cyclically: first every feature in turn, then the pairs of largest gain on what is left."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Gam(base=float(np.log(rate / (1 - rate))), edges=[_edges(x[:, f], BINS) for f in range(x.shape[1])])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y):
        return model
    total = np.full(len(y), model.base)
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, bins in enumerate(at):
            g, h = slopes()
            n = len(model.tables[f])
            step = STEP * _tree(np.bincount(bins, g, n), np.bincount(bins, h, n))
            model.tables[f] += step
            total += step[bins]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        rows, cols = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(at[f] * cols + at[k], v, rows * cols).reshape(rows, cols)

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(f, k, g), grid(f, k, h))[1], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)[:PAIRS]
    chosen = [(f, k, np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))) for _, f, k in gains]
    for _ in range(PAIR_ROUNDS):
        for f, k, table in chosen:
            g, h = slopes()
            step = STEP * _pair_tree(grid(f, k, g), grid(f, k, h))[0]
            table += step
            total += step[at[f], at[k]]
    model.pairs = [(f, k, coarse[f], coarse[k], table) for f, k, table in chosen]
    return model


def _feature_rows(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), type=pa.list_(pa.float64()))], names=["label", "x"])

    return in_arrow(docs.select(text_col, "label"), run, "label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Gam:
    """A model of label_col from the texts of `rows` labelled rows at most; null ids and labels teach nothing. Of several
    labels of one id the largest counts."""
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL").groupBy("_id").agg(F.max("label").alias("label"))
    some = named.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    known = docs.select(F.col(id_col).alias("_id"), text_col).join(F.broadcast(some), "_id")
    taught = _feature_rows(known, text_col).collect()
    x = np.array([r[1] for r in taught]).reshape(len(taught), len(FEATURES))
    return fit(x, np.array([float(r[0] > 0) for r in taught]))


def with_quality(docs: DataFrame, model: Gam, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col, the probability that a whole text is good. Null counts as empty; an empty text has all features 0. A
    column that is named out_col already is replaced."""
    docs = docs if out_col == text_col else docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or "" for t in batch.column(batch.schema.names.index(text_col)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, out_col])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labelled rows that aren't held out, and its prediction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs, labels.filter(~held_out))
    return with_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
