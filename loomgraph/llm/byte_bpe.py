"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

For each piece of text the tree's leaves are byte positions; a leaf holds (rank of the pair that starts there, position), so
the root is the leftmost pair of least rank. A merge changes three leaves (the merged pair, its right half, the live neighbour
on the left) and recomputes their paths, so a piece of n bytes takes O(n log n). Pieces of like size are encoded side by side in
numpy; longer ones one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomgraph.llm.common import KEPT, Remembered, in_arrow, text_slices

#: Bytes of the longest piece whose tree is built beside others', and leaves of the trees that are worked on at a time.
WIDE, LEAVES_AT_ONCE = 256, 1 << 17
#: Bytes of encoded chunks in each of the two generations that a task remembers; bytes of text that it handles at a time.
REMEMBERED, BYTES_AT_ONCE = 16_000_000, 1_000_000

_AMBIGUOUS = re.compile(r"\s\s|\s\Z")
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
#: Rust's \s is Unicode's White_Space; the regex module's also holds the separators U+001C to U+001F.
_SPACE = r"\p{White_Space}"
#: The alternative by which letters after a space are one piece.
_LETTERS = r" ?\p{L}+"


class PairTable:
    """Ranks of pairs of ids, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -2, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == -2
            self.keys[slot[free]], self.ids[slot[free]] = keys[free], ids[free]  # of several with one slot the last stays
            left = self.keys[slot] != keys
            keys, ids, slot = keys[left], ids[left], slot[left] + 1 & (1 << self.bits) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, keys: np.ndarray, none: int) -> np.ndarray:
        """The rank of each key, or none. Negative keys have none."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ids[slot], none)
        on = np.nonzero((held != keys) & (held != -2) & (keys >= 0))[0]
        while len(on):
            slot[on] = slot[on] + 1 & (1 << self.bits) - 1
            held = self.keys[slot[on]]
            hit = held == keys[on]
            out[on[hit]] = self.ids[slot[on[hit]]]
            on = on[~hit & (held != -2)]
        return out


class Codec:
    """Encodes texts to ids and back for one vocabulary. tokens: the bytes of each id, None where an id is free. Ids are held
    as packed 32-bit integers."""

    def __init__(self, tokens: list[bytes | None], pattern: str):
        self.tokens = tokens
        self.token_array = np.array(tokens, dtype=object)
        self.ranks = {t: i for i, t in enumerate(tokens) if t is not None}
        inside = regex.sub(r"\\s(?=[^\[\]]*\])", lambda _: _SPACE, pattern)
        self.pieces = regex.compile(inside.replace(r"\s", _SPACE).replace(r"\S", r"\P{White_Space}"))
        before, letters, _ = f"|{pattern}|".partition(f"|{_LETTERS}|")
        self.letters_whole = bool(letters) and all(x.startswith("'") for x in before.split("|") if x)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.shift = max(1, len(tokens)).bit_length()
        keys, ids = [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << self.shift | right)
                    ids.append(i)
        self.pairs = PairTable(np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int64))
        self.none = 1 << 40
        #: Letters to Python but not to the pattern, or the other way round.
        self.odd_letters = set()
        for lo in range(0, 0x110000, 0x800):
            some = "".join(map(chr, range(lo, lo + 0x800))) if lo != 0xD800 else ""
            self.odd_letters |= set(filter(str.isalpha, some)) ^ set(regex.findall(r"\p{L}", some))
        self.forget()

    def forget(self) -> None:
        """Starts with nothing remembered: young and old hold the ids of chunks that follow a space, plain those of pieces
        that don't."""
        self.young, self.old, self.plain = Remembered(), Remembered(), Remembered()

    # -- merging ------------------------------------------------------------------------------------------------------
    def _merge_many(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Pieces of at most `leaves` bytes, a power of two, merged side by side. Columns 0 and leaves + 1 stand for what is
        before and after a piece."""
        n, wide, depth = len(pieces), leaves + 2, leaves.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        inside = np.arange(leaves) < lengths[:, None]
        ids = np.full((n, wide), -1, dtype=np.int64)
        ids[:, 1:-1][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        after[np.arange(n), lengths] = leaves + 1
        before = np.tile(np.arange(-1, wide - 1), (n, 1)).ravel()
        none = self.none
        tree = np.full((n, 2 * leaves), none, dtype=np.int64)
        row, col = np.nonzero(inside[:, 1:])
        rank = self.pairs.ranks(ids[row, col + 1] << self.shift | ids[row, col + 2], none >> depth)
        tree[row, leaves + col] = rank << depth | np.where(rank < none >> depth, col, 0)
        for level in range(depth - 1, -1, -1):
            k = np.arange(1 << level, 2 << level)
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.nonzero(tree[:, 1] < none)[0]
        ids, after, tree = ids.ravel(), after.ravel(), tree.ravel()
        at_row, at_tree = live * wide, live * 2 * leaves
        best = tree[at_tree + 1]
        while len(at_row):
            at = (best & leaves - 1) + 1
            new = best >> depth
            here = at_row + at
            right = after[here]
            beyond = after[at_row + right]
            ids[here] = new
            ids[at_row + right] = -1
            after[here] = beyond
            before[at_row + beyond] = at
            left = before[here]
            keys = np.concatenate([new << self.shift | ids[at_row + beyond], ids[at_row + left] << self.shift | new])
            rank = self.pairs.ranks(keys, none >> depth) << depth
            m = len(at)
            leaf = np.concatenate([right, at, np.where(left > 0, left, right)]) - 1
            value = np.concatenate([np.full(m, none), rank])
            value[m:] += np.where(value[m:] < none, leaf[m:], 0)
            tops = np.concatenate([at_tree, at_tree, at_tree])
            node = leaf + leaves
            tree[tops + node] = value
            for _ in range(depth):
                node >>= 1
                pair = tops + 2 * node
                tree[tops + node] = np.minimum(tree[pair], tree[pair + 1])
            best = tree[at_tree + 1]
            on = best < none
            if not on.all():
                at_row, at_tree, best = at_row[on], at_tree[on], best[on]
        ids = ids.reshape(n, wide)
        held = ids >= 0
        flat, ends = ids[held].astype("<i4").tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_one(self, piece: bytes) -> bytes:
        """A piece of any length with a tree of its own."""
        n = len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        none = self.none * leaves
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        get = self.ranks.get
        tree = [none] * (2 * leaves)

        def rank(i: int, j: int) -> int:
            r = get(parts[i] + parts[j])
            return none if r is None else r * leaves + i

        for i in range(n - 1):
            tree[leaves + i] = rank(i, i + 1)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = leaves + leaf
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a < b else b
                if tree[k] == value:
                    return
                tree[k] = value
                k >>= 1

        while (best := tree[1]) < none:
            at = best % leaves
            right = after[at]
            beyond = after[right]
            parts[at], parts[right], after[at] = parts[at] + parts[right], b"", beyond
            put(right, none)
            if beyond < n:
                before[beyond] = at
                put(at, rank(at, beyond))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], rank(before[at], at))
        return np.array([get(p) for p in parts if p], dtype="<i4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece."""
        out = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        whole = list(map(self.ranks.get, pieces))
        for k, piece in enumerate(pieces):
            if (i := whole[k]) is not None:
                out[k] = i.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[k] = self._merge_one(piece)
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for leaves, at in by_size.items():
            step = max(1, LEAVES_AT_ONCE // leaves)
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                for k, ids in zip(some, self._merge_many([pieces[k] for k in some], leaves)):
                    out[k] = ids
        return out

    # -- texts --------------------------------------------------------------------------------------------------------
    def _is_letters(self, chunk: str) -> bool:
        return chunk.isalpha() and (chunk.isascii() or self.odd_letters.isdisjoint(chunk))

    def _learn(self, chunks: list[str], plain: list[str]) -> None:
        """Remembers chunks that follow a space and plain ones, at whose ends the pattern always splits."""
        whole = set(filter(self._is_letters, chunks)) if self.letters_whole else set()
        cut = {c: self.pieces.findall(" " + c) for c in chunks if c not in whole}
        cut_plain = {c: self.pieces.findall(c) for c in plain}
        pieces = set(chain.from_iterable(chain(cut.values(), cut_plain.values())))
        spaced = {p for p in pieces if p[0] == " " and len(p) > 1}
        fresh = list(whole.union(p[1:] for p in spaced).difference(self.young))
        others = list((pieces - spaced).difference(self.plain))
        ids = self.merge([*((" " + p).encode() for p in fresh), *(p.encode() for p in others)])
        self.young.keep(fresh, ids[: len(fresh)])
        self.plain.keep(others, ids[len(fresh) :])
        of = lambda p: self.young[p[1:]] if p in spaced else self.plain[p]
        for memory, found in ((self.young, cut), (self.plain, cut_plain)):
            memory.keep(found, [b"".join(map(of, c)) for c in found.values()])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [np.frombuffer(ids, dtype="<i4").tolist() for ids in self.packed_batch(texts)]

    def packed_batch(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. A single space between two other characters always starts a piece, so what lies
        between such spaces is encoded once and remembered."""
        split = [t.split(" ") if not _AMBIGUOUS.search(t) else _BETWEEN_WORDS.split(t) for t in texts]
        need = set()
        for parts in split:
            need.update(parts[1:])
        if self.young.bytes > REMEMBERED:
            self.old, self.young = self.young, Remembered()
        if self.plain.bytes > REMEMBERED:
            self.plain = Remembered()
        missing = need.difference(self.young)
        again = missing.intersection(self.old)
        self.young.keep(again, map(self.old.__getitem__, again))
        self._learn(list(missing - again), list({parts[0] for parts in split}.difference(self.plain)))
        get = self.young.__getitem__
        return [self.plain[parts[0]] + b"".join(map(get, parts[1:])) for parts in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.token_array[ids].tolist())


def read_ranks(path: str) -> list[bytes | None]:
    """The bytes of each id in a rank file (base64 and id on each line)."""
    with open(path, "rb") as file:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(None, file.read().splitlines()))}
    return [ranks.get(i) for i in range(max(ranks) + 1)]


def _codec(tokens: list[bytes | None], pattern: str) -> Codec:
    """The worker's codec for a vocabulary, kept from task to task; what it remembers of texts isn't."""
    key = (hash(tuple(tokens)), pattern)
    if "codec" not in KEPT or KEPT["codec"][0] != key:
        KEPT["codec"] = (key, Codec(tokens, pattern))
    return KEPT["codec"][1]


def _with_codec(df: DataFrame, path: str, pattern: str, text_col: str, out: list[T.StructField], make: Callable) -> DataFrame:
    """df with the columns that make(codec, texts) gives as Arrow arrays."""
    tokens = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokens, pattern)
        try:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for lo, hi in text_slices(texts, BYTES_AT_ONCE):
                    part = batch.slice(lo, hi - lo)
                    made = make(codec, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(f.name for f in out)])
        finally:
            codec.forget()

    return in_arrow(df, run, T.StructType([*df.schema.fields, *out]), keep="codec")


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with out_col, the ids of each text (null and empty: no ids). Special tokens are ordinary text. A column that is named
    out_col already is replaced."""
    df = df.drop(out_col)
    field = T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)

    def make(codec: Codec, texts: list[str]) -> list[pa.Array]:
        packed = codec.packed_batch(texts)
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
        return [pa.ListArray.from_arrays(pa.array(ends), ids, type=pa.list_(pa.field("element", pa.int32(), False)))]

    return _with_codec(df, path, pattern, text_col, [field], make)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """df with out_col, the bytes of the ids (null: empty). An id that the vocabulary lacks is an error. A column that is named out_col
    already is replaced."""
    df = df.drop(out_col)
    tokens = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            raw = pa.array([b"".join(map(tokens.__getitem__, i or ())) for i in ids], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, out_col])

    return in_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType(), False)]))


def encode_decode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the decoded bytes), without moving the
    ids out of the worker. Null text counts as empty; rows are neither dropped nor merged. Columns of these names are
    replaced."""
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256")
    out = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]

    def make(codec: Codec, texts: list[str]) -> list[pa.Array]:
        decimal = codec.__dict__.setdefault("decimal", np.array([str(i) for i in range(len(codec.tokens))], dtype=object))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        counts, written, decoded = [], [], []
        for packed in codec.packed_batch(texts):
            ids = np.frombuffer(packed, dtype="<i4")
            counts.append(len(ids))
            written.append(sha(",".join(decimal[ids].tolist()).encode()))
            decoded.append(sha(codec.decode(ids)))
        return [pa.array(counts, type=pa.int64()), pa.array(written), pa.array(decoded)]

    return _with_codec(df, path, pattern, text_col, out, make)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of the bytes that they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
