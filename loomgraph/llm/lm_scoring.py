"""Language-model scoring by deleted interpolation of a bigram model.

P(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1), where the weights depend on how often the context v occurs and are
learnt by expectation-maximisation on held-out counts: one part of the training documents is deleted from the counts and
predicted by the rest.

Counts are exchanged in packed blocks: a block of documents asks for the counts of its distinct words and bigrams once, in
sorted arrays dealt by hash, and gets them back in the same order. No token is a row of its own, no group grows with a key's
frequency, and a bucket's size is set from the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_ROWS, fold, hashed_words, in_arrow, mixed, written

#: Tokens of a block of documents (a longer document is a block of its own), and bytes of text that one count bucket stands for.
BLOCK_TOKENS, BUCKET_BYTES = 1_500_000, 6_000_000
#: The training documents' fold of FOLDS that is deleted and predicted when weights are learnt.
FOLDS, DELETED = 7, 3
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ... up to 2 ** (CONTEXTS - 2) and more.
CONTEXTS = 20
#: Cells in which held-out events are gathered for each context bucket: log10 probabilities by this step, down to LOWEST.
CELL, LOWEST = 0.05, -10.0
EM_ROUNDS = 40

_END = np.uint64(0x5BF03635D1A2C3E7)
_CELLS = int(-LOWEST / CELL) + 2


def _pack(x: np.ndarray) -> bytes:
    """A sorted uint64 array as differences, by byte planes, which compress where differences are small."""
    return np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _bigrams(words: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bigram's hash at every token; a document's first token follows the end token."""
    h = words[at]
    before = np.empty_like(h)
    before[1:], before[starts] = h[:-1], _END
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + h) | np.uint64(1)


_BLOCK = "block long, deleted boolean, ids binary, fold binary, lengths binary, words binary, tokens binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents (id, fold, text) in blocks, those of the deleted fold apart: ids, folds, numbers of tokens, distinct word hashes, and tokens as places in
    these. Word hashes are even and the end token is odd among them, so bigrams, made odd too, never equal words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        size = {True: 0, False: 0}
        held = {True: ([], [], [], []), False: ([], [], [], [])}

        def block(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            ids, folds, lengths, tokens = held[deleted]
            words, at = np.unique(np.concatenate(tokens), return_inverse=True)
            row = [number, deleted, np.array(ids, dtype="<i8").tobytes(), np.array(folds, dtype=np.uint8).tobytes(), np.array(lengths, dtype="<u4").tobytes(), _pack(words), _planes(at)]
            number += 1
            held[deleted] = ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for i, part, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = hashed_words(text.as_py())
                h = np.empty(len(words) + 1, dtype=np.uint64)
                h[:-1] = words & ~np.uint64(1)
                h[-1] = _END & ~np.uint64(1)
                deleted = part.as_py() == DELETED
                for x, v in zip(held[deleted], (i.as_py(), part.as_py(), len(h), h)):
                    x.append(v)
                size[deleted] += len(h)
                if size[deleted] >= BLOCK_TOKENS:
                    yield block(deleted)
                    size[deleted] = 0
        for deleted in held:
            if held[deleted][0]:
                yield block(deleted)

    return in_arrow(docs, run, _BLOCK)


def _open(row: dict) -> tuple[np.ndarray, ...]:
    ids, folds, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["fold"], np.uint8), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    words, at = _unpack(row["words"]), _unplane(row["tokens"]).astype(np.int64)
    return ids, folds, lengths, words, at, np.cumsum(lengths) - lengths


def _requests(blocks: DataFrame, buckets: int, held_out: int) -> DataFrame:
    """(bucket, block, keys, kept, deleted): each block's distinct words and bigrams, with their training counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, folds, lengths, words, at, starts = _open(row)
                each = np.repeat(folds, lengths)
                bigrams, place = np.unique(_bigrams(words, at, starts), return_inverse=True)
                keys = np.concatenate([words, bigrams])
                counts = [np.concatenate([np.bincount(at, use, len(words)), np.bincount(place, use, len(bigrams))]) for use in ((each != held_out) & (each != DELETED), each == DELETED)]
                bucket = (mixed(keys) >> np.uint64(24)) % np.uint64(buckets)
                order = np.lexsort((keys, bucket))
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.nonzero(np.diff(ends))[0]:
                    k = order[ends[b] : ends[b + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array([row["block"]]), pa.array([_pack(keys[k])]), pa.array([_planes(counts[0][k])]), pa.array([_planes(counts[1][k])])], names=["bucket", "block", "keys", "kept", "deleted"])

    return in_arrow(blocks, run, "bucket long, block long, keys binary, kept binary, deleted binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(block, bucket, kept, deleted, vocabulary, tokens): the corpus's counts of each block's keys in a bucket, in the same
    order; once for each bucket also the words that occur in training (kept part and all) and their tokens."""

    def sums(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _ANSWER})
        keys = [_unpack(b.as_py()) for b in rows["keys"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        kept, deleted = (np.bincount(place, np.concatenate([_unplane(b.as_py()) for b in rows[c]]), len(every)) for c in ("kept", "deleted"))
        word = every & np.uint64(1) == 0
        facts = [int((word & (kept > 0)).sum()), int(kept[word].sum()), int((word & (kept + deleted > 0)).sum()), int((kept + deleted)[word].sum())]
        ends = np.cumsum([0, *map(len, keys)])
        out = {n: [] for n, _ in _ANSWER}
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            at = place[a:b]
            for n, v in zip(out, (rows["block"][k].as_py(), rows["bucket"][k].as_py(), _planes(kept[at]), _planes(deleted[at]), facts if k == 0 else None)):
                out[n].append(v)
        return pa.table({n: pa.array(out[n], t) for n, t in _ANSWER})

    return requests.groupBy("bucket").applyInArrow(sums, "block long, bucket long, kept binary, deleted binary, facts array<bigint>")


_ANSWER = [("block", pa.int64()), ("bucket", pa.int64()), ("kept", pa.binary()), ("deleted", pa.binary()), ("facts", pa.list_(pa.int64()))]


def _counts(row: dict, answers: pa.Table, buckets: int, columns: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """For every token of a block: c(v), c(w) and c(v, w), summed over the named parts."""
    _, _, _, words, at, starts = _open(row)
    bigrams, place = np.unique(_bigrams(words, at, starts), return_inverse=True)
    keys = np.concatenate([words, bigrams])
    order = np.lexsort((keys, (mixed(keys) >> np.uint64(24)) % np.uint64(buckets)))
    by_bucket = np.argsort(answers["bucket"].to_numpy())
    total = np.zeros(len(keys))
    for c in columns:
        blobs = answers[c].to_pylist()
        total[order] += np.concatenate([_unplane(blobs[k]) for k in by_bucket])
    word = total[: len(words)][at]
    before = np.empty_like(word)
    end = total[: len(words)][np.searchsorted(words, _END & ~np.uint64(1))]
    before[1:], before[starts] = word[:-1], end
    return before, word, total[len(words) :][place]


def _context(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c)[1], CONTEXTS - 1)


def _parts(before: np.ndarray, word: np.ndarray, pair: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    return np.divide(pair, before, out=np.zeros_like(pair), where=before > 0), word / max(tokens, 1)


def _events(blocks: DataFrame, answers: DataFrame, buckets: int, tokens: int) -> DataFrame:
    """(cell, n, p2, p1): the deleted part's tokens, gathered by context bucket and by what either estimate gives them."""

    def gather(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [row for row in left.to_pylist()]
        if not rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("cell", pa.int64()), ("n", pa.float64()), ("p2", pa.float64()), ("p1", pa.float64()))})
        row = rows[0]
        before, word, pair = _counts(row, right, buckets, ("kept",))
        p2, p1 = _parts(before, word, pair, tokens)
        grid = lambda p: np.where(p > 0, 1 + np.clip(np.log10(np.maximum(p, 1e-300)) / -CELL, 0, _CELLS - 2).astype(np.int64), 0)
        cell = (_context(before) * _CELLS + grid(p2)) * _CELLS + grid(p1)
        cells, at = np.unique(cell, return_inverse=True)
        return pa.table({"cell": cells, "n": np.bincount(at, minlength=len(cells)).astype(float), "p2": np.bincount(at, p2, len(cells)), "p1": np.bincount(at, p1, len(cells))})

    answers = answers.join(F.broadcast(blocks.select("block")), "block", "left_semi") if blocks.count() <= BROADCAST_ROWS else answers
    cells = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(gather, "cell long, n double, p2 double, p1 double")
    return cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))


def learn_weights(cells: list, vocabulary: int) -> np.ndarray:
    """Weights (l2, l1, l0) of each context bucket, by expectation-maximisation on the gathered held-out events. The number
    of cells is fixed by CONTEXTS and CELL; each stands for its events' mean probabilities."""
    weights = np.tile([0.3, 0.6, 0.1], (CONTEXTS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if cells:
        cell, n, p2, p1 = (np.array(c, dtype=float) for c in zip(*cells))
        context = (cell // (_CELLS * _CELLS)).astype(int)
        p = np.stack([p2 / n, p1 / n, np.full(len(n), 1 / (vocabulary + 1))], axis=1)
        for _ in range(EM_ROUNDS):
            share = weights[context] * p
            share *= (n / share.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(context, share[:, k], CONTEXTS) for k in range(3)], axis=1) + [1e-3, 1e-3, 1e-3]
            weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0, 0] = 0.0  # an unseen context has no estimate of its own
    return weights / weights.sum(axis=1, keepdims=True)


def _scores(blocks: DataFrame, answers: DataFrame, buckets: int, weights: np.ndarray, vocabulary: int, tokens: int) -> DataFrame:
    out = [("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def score(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in out})
        ids, _, lengths, _, _, starts = _open(rows[0])
        before, word, pair = _counts(rows[0], right, buckets, ("kept", "deleted"))
        p2, p1 = _parts(before, word, pair, tokens)
        w = weights[_context(before)]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1))
        base = np.log10((word + 1) / (tokens + vocabulary + 1))
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table([pa.array(x, t) for x, (_, t) in zip((ids, lengths, add((word > 0).astype(np.int64)), add(base), add(model)), out)], names=[n for n, _ in out])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "id long, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, training_fold, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    training_fold: a column of 0 to FOLDS - 1; rows of fold `held_out` teach nothing, and those of fold DELETED are what the
    weights are learnt on. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; every text, null and empty ones too, ends in an
    end token. Null ids stay null as id 0 would: they are given as null. Repeated rows count each time. With nothing to learn
    from, all words are unknown. Words are told apart by 63-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), training_fold.cast("int").alias("fold"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-int(size) // BUCKET_BYTES))
    shuffled = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = written(_blocks(rows.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))), "blocks")
    answers = written(_answers(_requests(blocks, buckets, held_out).repartition(min(buckets, 4 * shuffled), "bucket")), "answers")
    facts = answers.filter("facts IS NOT NULL").agg(*[F.coalesce(F.sum(F.get("facts", F.lit(i))), F.lit(0)).alias(f"_{i}") for i in range(4)]).first()
    weights = learn_weights(_events(blocks.filter("deleted"), answers, buckets, facts[1]).select("cell", "n", "p2", "p1").collect(), facts[0])
    scored = _scores(blocks, answers, buckets, weights, facts[2], facts[3])
    given = F.when(F.col("id") != _NO_ID, F.col("id"))
    return scored.select(given.alias(id_col), "n_tokens", "n_known", F.lit(facts[3]).cast("long").alias("train_tokens"), "base_score", "score")


_NO_ID = -(1 << 63)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base score and log10 probability by the model of all training documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, fold(F.col("doc_id"), FOLDS))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
