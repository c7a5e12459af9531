"""Text vectors without a given model: truncated SVD of hashed tf-idf, trained on the texts at hand.

A text is a sparse row over WIDTH buckets of words and of their three-letter runs. The leading directions of all rows come from
subspace iteration: every pass over the texts multiplies them by the present directions, each task adds up a matrix of fixed
size, and matrices are added up in a few tasks before the driver sees them. Nothing grows with the number of texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.search import joined_top_k
from loomgraph.storage import cut, small_or_not

#: Buckets, directions, passes over the texts, and tasks that add up matrices. A matrix has WIDTH * RANK numbers (2 MB).
WIDTH, RANK, PASSES, SUMMED_IN = 4096, 64, 6, 8
#: What a three-letter run counts beside a whole word.
RUN_WEIGHT = 0.35
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None, width: int = WIDTH) -> dict[int, float]:
    """bucket -> signed count of the text's words and of their three-letter runs."""
    out: dict[int, float] = {}
    for word in _WORD.findall((text or "").lower()):
        line = f" {word} "
        for piece, weight in ((f"w{word}", 1.0), *((line[i : i + 3], RUN_WEIGHT) for i in range(len(line) - 2))):
            h = zlib.crc32(piece.encode())
            out[h % width] = out.get(h % width, 0.0) + (weight if h & 0x80000000 else -weight)
    return out


def _rows(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the texts' tf-idf rows, each of length 1: damped counts, so a long text's repeats don't rule it."""
    row, bucket, value = [], [], []
    for k, text in enumerate(texts):
        found = features(text, len(idf))
        b = np.fromiter(found, np.int64, len(found))
        v = np.fromiter(found.values(), np.float64, len(found))
        v = np.sign(v) * np.log1p(np.abs(v)) * idf[b]
        norm = np.sqrt((v * v).sum())
        if norm > 0:
            row.append(np.full(len(b), k))
            bucket.append(b)
            value.append(v / norm)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(row, np.int64), join(bucket, np.int64), join(value, np.float64)


def _times(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, directions: np.ndarray) -> np.ndarray:
    """The sparse rows times the directions."""
    row, bucket, value = rows
    out = np.zeros((n, directions.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[starts]] = np.add.reduceat(value[:, None] * directions[bucket], starts)
    return out


@dataclass(frozen=True)
class Embedding:
    """idf by bucket, and the directions (buckets x rank). Texts without a known bucket have a null vector."""

    idf: np.ndarray
    directions: np.ndarray

    def vectors(self, texts: Iterable[str | None]) -> np.ndarray:
        """Vectors of length 1, or 0 where a text has none."""
        texts = list(texts)
        out = _times(_rows(texts, self.idf), len(texts), self.directions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)

    def similarity(self, a: str, b: str) -> float:
        x, y = self.vectors([a, b])
        return float(x @ y)

    def embed(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """df with the texts' vectors; null for texts without any. A column that is named out is replaced."""
        df = df.drop(out)
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = model.vectors(batch.column(batch.schema.names.index(text)).to_pylist())
                made = pa.array([v.tolist() if v.any() else None for v in made], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _added(df: DataFrame, column: str, partial) -> np.ndarray | None:
    """The sum of the arrays that partial(list of texts) gives for the batches of a column: added up in each task, then in
    SUMMED_IN tasks, then here."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = partial(batch.column(0).to_pylist())
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["m"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in batch.column(0).to_pylist():
                made = np.frombuffer(m, "<f8")
                total = made.copy() if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    rows = df.select(column).mapInArrow(each, "m binary").repartition(SUMMED_IN).mapInArrow(again, "m binary").collect()  # SUMMED_IN rows
    return sum(np.frombuffer(r["m"], "<f8") for r in rows) if rows else None


def trained(texts: DataFrame, text: str, rank: int = RANK, width: int = WIDTH, passes: int = PASSES, seed: int = 7) -> Embedding:
    """The embedding of a table of texts: every text takes part in every pass. Null and empty texts add nothing; a table without
    words gives directions that lead nowhere."""
    rows = cut(texts.select(F.col(text).alias("_t")).filter("_t IS NOT NULL"))

    def held(some: list[str]) -> np.ndarray:
        out = np.zeros(width + 1)
        for t in some:
            found = features(t, width)
            out[np.fromiter(found, np.int64, len(found))] += 1
        out[width] = len(some)
        return out

    counts = _added(rows, "_t", held)
    if counts is None:
        return Embedding(np.zeros(width), np.zeros((width, rank)))
    idf = np.where(counts[:width] > 0, np.log((1 + counts[width]) / (1 + counts[:width])) + 1.0, 0.0)
    directions = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank)))[0]
    for _ in range(passes):

        def turned(some: list[str], directions=directions) -> np.ndarray:
            sparse = _rows(some, idf)
            seen = _times(sparse, len(some), directions)
            out = np.zeros((width, rank))
            np.add.at(out, sparse[1], sparse[2][:, None] * seen[sparse[0]])
            return out.ravel()

        moved = _added(rows, "_t", turned).reshape(width, rank)
        left, size, _ = np.linalg.svd(moved, full_matrices=False)
        directions = left * (size > 1e-9)  # fewer directions than rank where the texts have no more
    return Embedding(idf, directions)


# -- the gate and the links -------------------------------------------------------------------------------------------
def floor_for(pairs: DataFrame, recall: float = 0.95, sim: str = "sim", relevant: str = "relevant") -> float | None:
    """The highest floor at which at least `recall` of the relevant pairs pass; null without relevant pairs."""
    hits = pairs.filter(F.col(relevant) & F.col(sim).isNotNull())
    n = hits.count()
    if not n:
        return None
    place = int(np.floor((1 - recall) * n + 1e-9))  # so many may be lost
    return hits.agg(F.percentile(sim, F.lit(place / max(n - 1, 1)))).first()[0]


def measured(pairs: DataFrame, floor: float, sim: str = "sim", relevant: str = "relevant") -> DataFrame:
    """(pairs, relevant, passed, recall, precision) of a floor; a share of nothing is null."""
    passes = F.coalesce(F.col(sim) >= floor, F.lit(False))
    sums = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(relevant).alias("relevant"), F.count_if(passes).alias("passed"), F.count_if(passes & F.col(relevant)).alias("_hits"))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("_hits") / F.col(n), 6))
    return sums.select("pairs", "relevant", "passed", share("relevant").alias("recall"), share("passed").alias("precision"))


def linked_spans(spans: DataFrame, names: DataFrame, model: Embedding, preferred: str | None = None, span_id: str = "span_id", text: str = "text", candidates: int = 15, short: int = 4, short_floor: float = 0.85, floor: float | None = None) -> DataFrame:
    """(span_id, id, sim, boosted): the node of names (id, name, type) that each span means, as search.linked finds it for one: of its most
    similar ones, an exact name is worth 0.35 more, a type that the span's list `preferred` holds 0.2 more; short spans need a high
    score after that. floor: the least boosted score of all. Ties go to the first id; spans that nothing is like have no row."""
    from pyspark.sql import Window

    preferred_types = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(preferred), F.array().cast("array<string>"))))) if preferred else F.array().cast("array<string>")
    asked = spans.select(F.col(span_id).cast("long").alias("_q"), F.col(text).alias("_t"), preferred_types.alias("_p")).filter("_q IS NOT NULL AND _t IS NOT NULL")
    # Spans with equal text and types mean the same, so each text is embedded and searched once.
    kinds = cut(asked.select("_t", "_p").distinct())
    texts = cut(kinds.select("_t").distinct().withColumn("_n", F.monotonically_increasing_id()))
    numbered = cut(names.select("id", "name", "type").withColumn("_k", F.monotonically_increasing_id()))
    vectors = cut(model.embed(numbered.select("_k", "name"), "name", "embedding").select("_k", "embedding"))
    near = joined_top_k(model.embed(texts, "_t", "embedding").select("_n", "embedding"), vectors, candidates, "_n", "_k")
    rows = near.join(texts, "_n").join(numbered, "_k").join(kinds, "_t")
    boosted = F.col("sim") + F.when(F.lower("name") == F.lower("_t"), 0.35).otherwise(0.0) + F.when(F.array_contains("_p", F.col("type")), 0.2).otherwise(0.0)
    rows = rows.withColumn("boosted", F.round(boosted, 6))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_t", "_p").orderBy(F.col("boosted").desc(), "id"))).filter("_r = 1")
    kept = (F.length("_t") > short) | (F.col("boosted") >= short_floor)
    kept = kept if floor is None else kept & (F.col("boosted") >= floor)
    best = cut(best.filter(kept).select("_t", "_p", "id", "sim", "boosted"))
    linked = asked.join(small_or_not(best), ["_t", "_p"]).groupBy("_q").agg(F.min_by(F.struct("id", "sim", "boosted"), F.struct(-F.col("boosted"), F.col("id"))).alias("b"))
    return linked.select(F.col("_q").alias(span_id), "b.id", "b.sim", "b.boosted")
