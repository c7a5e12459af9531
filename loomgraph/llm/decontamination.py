"""Benchmark decontamination by pigeonhole edit matching over words, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import free_name, in_arrow

#: Word edits allowed as a share of an item's words: a match is 0.8 alike or more.
EDIT_SHARE = 0.2
#: Items with fewer words than a shingle are no evidence of a leak inside other text: they are found as whole lines only.
MIN_WORDS = 5
#: Characters of items that one scan of the documents searches for; more items take more scans.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"\w+")
LEAKS = T.ArrayType(
    T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())]
    )
)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces_of(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """words in budget + 1 runs of nearly equal length, with the place of each."""
    n, k = len(words), budget + 1
    ends = [n * i // k for i in range(k + 1)]
    return [(a, words[a:b]) for a, b in zip(ends, ends[1:])]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of pattern to a run of text, and the first place after such a run."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & mask, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up, down = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str | None]], share: float, min_words: int):
        self.items = []
        self.short: dict[tuple[str, ...], list[int | None]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if len(words) < min_words:
                if words:
                    self.short.setdefault(tuple(words), []).append(item_id)
                continue
            budget = int(share * len(words))
            for at, run in pieces_of(words, budget):
                pieces.setdefault(f" {' '.join(run)} ", []).append((len(self.items), at))
            self.items.append((item_id, words, budget))
        self.search = ahocorasick.Automaton()
        for run, owners in pieces.items():
            self.search.add_word(run, (len(run), owners))
        if pieces:
            self.search.make_automaton()
        self.any = bool(pieces)

    def whole_lines(self, text: str) -> list[dict]:
        """The short items that are a line of the text, word by word, each where it is first."""
        out: dict[tuple[str, ...], int] = {}
        at = 0
        for line in text.splitlines():
            words = tuple(words_of(line))
            if words in self.short:
                out.setdefault(words, at)
            at += len(words)
        return [{"item_id": i, "distance": 0, "item_words": len(w), "start_word": at, "end_word": at + len(w)} for w, at in out.items() for i in self.short[w]]

    def leaks(self, text: str | None) -> list[dict]:
        if not text:
            return []
        lines = self.whole_lines(text) if self.short else []
        return lines + self.passages(text) if self.any else lines

    def passages(self, text: str) -> list[dict]:
        """The longer items that the text holds within their budgets, each at its best match."""
        words = words_of(text)
        line = f" {' '.join(words)} "
        found: dict[int, list[tuple[int, int]]] = {}
        done = seen = 0
        for end, (length, owners) in self.search.iter(line):
            start = end - length + 1
            if start > done:  # words are counted as far as the hits go, once over the text
                seen += line.count(" ", done, start)
                done = start
            at = seen if start == done else seen - line.count(" ", start, done)
            for k, offset in owners:
                _, pattern, budget = self.items[k]
                found.setdefault(k, []).append((max(0, at - offset - budget), at - offset + len(pattern) + budget))
        out = []
        for k, spans in sorted(found.items()):
            item_id, pattern, budget = self.items[k]
            spans.sort()
            joined = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            best = min(((*myers(pattern, words[a:b]), a) for a, b in joined), key=lambda x: (x[0], x[2] + x[1]))
            if best[0] <= budget:
                end = best[2] + best[1]
                _, back = myers(pattern[::-1], words[max(0, end - len(pattern) - budget) : end][::-1])
                out.append({"item_id": item_id, "distance": best[0], "item_words": len(pattern), "start_word": end - back, "end_word": end})
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple]]:
    """All items, in blocks of about `chars` characters at most."""
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = max(1, -(-int(total) // chars))
    for k in range(n):
        yield [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k).select(F.col(id_col).cast("long"), text_col).collect()]


def with_leaks(
    docs: DataFrame, items: DataFrame, out_col: str = "leaks", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, min_words: int = MIN_WORDS
) -> DataFrame:
    """docs with out_col: the items that occur in the text within the edit budget, by item order of each block.

    Words are lower-cased runs of letters, digits and underscores. An item of n words may differ by floor(share * n) words;
    it is split into one run more than that, so a match holds one run unchanged, and every such hit is verified. Each item is
    listed once, at its best match. Items of fewer words than min_words are found where they are a whole line of the text.
    Null or empty texts hold no leak, null and wordless items match nothing; rows of docs stay as they are, repeated ones too;
    a column that is named out_col already is replaced. The whole text is searched. Items are taken in blocks of BLOCK_CHARS,
    each with a scan of its own, so a worker's automaton has a bounded size.
    """
    docs = docs.drop(out_col)
    for k, items_now in enumerate(_blocks(items, item_id, item_text, BLOCK_CHARS)):
        had = k > 0
        schema = docs.schema if had else T.StructType([*docs.schema.fields, T.StructField(out_col, LEAKS)])

        def run(batches: Iterator[pa.RecordBatch], items_now=items_now, had=had) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items_now, share, min_words)
            for batch in batches:
                names = batch.schema.names
                found = [matcher.leaks(t.as_py()) for t in batch.column(names.index(text_col))]
                columns = dict(zip(names, batch.columns))
                if had:
                    found = [a + b for a, b in zip(columns[out_col].to_pylist(), found)]
                columns[out_col] = pa.array(found, type=_ARROW)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        docs = in_arrow(docs, run, schema)
    return docs


_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32())]))


def drop_leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds an item; all other rows and all columns stay."""
    out = free_name(docs, "leaks")
    return with_leaks(docs, items, out, **options).filter(F.size(out) == 0).drop(out)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_leaks(docs, items).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


QUERIES = {"op4_decontamination": op4_decontamination}
