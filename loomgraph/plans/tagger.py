"""A sequence tagger for questions: which words name a thing, and of what type. Averaged structured perceptron with Viterbi.

It is trained on generated questions whose names are known (labelled()), a bounded sample; it then finds names that no list holds, by
the words and shapes around them. Tables of questions are tagged batch by batch, all questions of a batch side by side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Buckets of features, rounds over the training questions, and questions that training takes at most.
BUCKETS, ROUNDS, FIT_QUESTIONS = 1 << 16, 8, 5_000
#: The share of a word's features that training hides at each visit: a name must be known by its words or by what is around them alone.
HIDDEN = 0.3
_TOKEN = re.compile(r"[^\W_]+(?:[&'.-][^\W_]+)*|[^\w\s]")


def tokens(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of a text's words and marks."""
    return [m.span() for m in _TOKEN.finditer(text or "")]


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


def features(words: list[str]) -> np.ndarray:
    """The buckets (words x features) of each word: itself, its ends, its shape and its neighbours."""
    low = ["<s>", "<s>", *(w.lower() for w in words), "</s>", "</s>"]
    shape = ["", *(_shape(w) for w in words), ""]
    out = []
    for k, w in enumerate(words):
        at = k + 2
        pieces = (
            f"w{low[at]}", f"p{low[at - 1]}", f"n{low[at + 1]}", f"q{low[at - 2]} {low[at - 1]}", f"m{low[at + 1]} {low[at + 2]}", f"e{low[at][-3:]}", f"b{low[at][:3]}",
            f"s{shape[k + 1]}", f"t{shape[k]} {shape[k + 1]}", f"u{shape[k + 1]} {shape[k + 2]}", f"v{low[at - 1]} {shape[k + 1]}", f"x{k == 0} {shape[k + 1]}", f"y{low[at + 1]} {shape[k + 1]}", f"z{len(w) > 3} {w.isupper()}",
        )
        out.append([zlib.crc32(p.encode()) % BUCKETS for p in pieces])
    return np.array(out, dtype=np.int64).reshape(len(words), 14)


@dataclass(frozen=True)
class Tagger:
    """tags: O, then B-type and I-type; the weights of features and of one tag after another."""

    tags: list[str]
    emit: np.ndarray
    move: np.ndarray

    def paths(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The best tags of each text, all texts side by side: one step a word."""
        found = [features([t[a:b] for a, b in tokens(t)]) for t in texts]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        if not len(found) or not sizes.max():
            return [[] for _ in found]
        scores = np.zeros((len(found), sizes.max(), len(self.tags)))
        for k, f in enumerate(found):
            if len(f):
                scores[k, : len(f)] = self.emit[f].sum(axis=1)
        best, back = scores[:, 0] + self.move[-1], np.zeros(scores.shape, dtype=np.int64)
        for step in range(1, scores.shape[1]):
            ways = best[:, :, None] + self.move[None, :-1]
            back[:, step] = ways.argmax(axis=1)
            on = (step < sizes)[:, None]
            best = np.where(on, ways.max(axis=1) + scores[:, step], best)
        out = []
        for k, size in enumerate(sizes):
            path = [int(best[k].argmax())] if size else []
            for step in range(size - 1, 0, -1):
                path.append(int(back[k, step, path[-1]]))
            out.append(path[::-1])
        return out

    def spans(self, texts: Iterable[str | None]) -> list[list[tuple[int, int, str, str]]]:
        """(start, end, words, type) of the names in each text."""
        texts = list(texts)
        return [_spans(t or "", tokens(t), [self.tags[i] for i in path]) for t, path in zip(texts, self.paths(texts))]

    def hook(self, question: str) -> list[tuple[int, int, str]]:
        """For the resolver's `spans`."""
        return [s[:3] for s in self.spans([question])[0]]


def _spans(text: str, at: list[tuple[int, int]], tags: list[str]) -> list[tuple[int, int, str, str]]:
    out, open_ = [], None
    for (a, b), tag in [*zip(at, tags), ((len(text), len(text)), "O")]:
        if open_ and tag == f"I-{open_[2]}":
            open_ = (open_[0], b, open_[2])
            continue
        if open_:
            out.append((open_[0], open_[1], text[open_[0] : open_[1]], open_[2]))
        open_ = (a, b, tag[2:]) if tag != "O" else None
    return out


def labelled(frames: list[str], names: dict[str, list[str]], count: int, seed: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Questions with their spans (start, end, type): frames whose {TYPE} places are filled with names of the type."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        text, spans = "", []
        for k, piece in enumerate(re.split(r"\{(\w+)\}", frames[rng.integers(len(frames))])):
            if k % 2:
                name = names[piece][rng.integers(len(names[piece]))]
                spans.append((len(text), len(text) + len(name), piece))
                piece = name
            text += piece
        out.append((text, spans))
    return out


def train(questions: Iterable[tuple[str, list[tuple[int, int, str]]]], rounds: int = ROUNDS, seed: int = 3) -> Tagger:
    """A tagger from labelled questions; of more than FIT_QUESTIONS the first ones count. Spans that cut words cover all of them."""
    questions = list(questions)[:FIT_QUESTIONS]
    kinds = sorted({s[2] for _, spans in questions for s in spans})
    tags = ["O", *(f"{x}-{k}" for k in kinds for x in "BI")]
    rows = []
    for text, spans in questions:
        at = tokens(text)
        gold = [0] * len(at)
        for a, b, kind in spans:
            inside = [k for k, (x, y) in enumerate(at) if x < b and y > a]
            for k in inside:
                gold[k] = tags.index(f"{'B' if k == inside[0] else 'I'}-{kind}")
        if at:
            rows.append((features([text[a:b] for a, b in at]), gold))
    emit, move = np.zeros((BUCKETS, len(tags))), np.zeros((len(tags) + 1, len(tags)))
    # An I follows only its own B or I.
    for k, tag in enumerate(tags):
        if tag[0] == "I":
            move[[j for j, t in enumerate([*tags, ""]) if t[2:] != tag[2:] or t == "O"], k] = -1e6
    sums, moved, seen = np.zeros_like(emit), np.zeros_like(move), 0
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    # An average is the last weights less each change weighted by when it was made.
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            f, gold = rows[i]
            seen_now = rng.random(f.shape) >= HIDDEN
            guess = _viterbi((emit[f] * seen_now[:, :, None]).sum(axis=1), move)
            seen += 1
            if guess == gold:
                continue
            for k, (g, h) in enumerate(zip(gold, guess)):
                if g != h:
                    for sign, tag in ((1.0, g), (-1.0, h)):
                        np.add.at(emit[:, tag], f[k][seen_now[k]], sign)
                        np.add.at(sums[:, tag], f[k][seen_now[k]], sign * seen)
                before = ((gold[k - 1], guess[k - 1]) if k else (len(tags), len(tags)))
                if (before[0], g) != (before[1], h):
                    for sign, (a, b) in ((1.0, (before[0], g)), (-1.0, (before[1], h))):
                        move[a, b] += sign
                        moved[a, b] += sign * seen
    n = max(seen, 1)
    return Tagger(tags, emit - sums / n, move - moved / n)


def _viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    best, back = scores[0] + move[-1], []
    for s in scores[1:]:
        ways = best[:, None] + move[:-1]
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("words", T.StringType()), T.StructField("type", T.StringType())]))


def tagged(questions: DataFrame, text: str, tagger: Tagger, out: str = "spans") -> DataFrame:
    """questions with the names that the tagger finds in each, array<struct<start, end, words, type>> in their order; none for null and
    empty texts. A column that is named out is replaced."""
    questions = questions.drop(out)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.string()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tagger.spans(batch.column(batch.schema.names.index(text)).to_pylist())
            made = pa.array([[dict(zip(("start", "end", "words", "type"), s)) for s in some] for some in found], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return questions.mapInArrow(run, T.StructType([*questions.schema.fields, T.StructField(out, _SPANS)]))


def scored(found: list[list[tuple]], wanted: list[list[tuple[int, int, str]]]) -> tuple[float, float]:
    """(precision, recall) of spans that agree in place and type."""
    got = [{(s[0], s[1], s[-1]) for s in some} for some in found]
    want = [set(some) for some in wanted]
    hits = sum(len(a & b) for a, b in zip(got, want))
    return hits / max(sum(map(len, got)), 1), hits / max(sum(map(len, want)), 1)
