"""Packing into sequences by minimum bin slack: subset sums over bit sets pick the remaining lengths that fill each window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import in_arrow, text_slices
from loomgraph.llm.vocabularies import ByteLevel, kept, read

#: Tokens of a sequence, and the id that ends a document.
WINDOW, END = 1024, 0
#: Tokens of the documents that are packed together; a longer document is packed by itself.
BLOCK_TOKENS = 4_000_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 2_000_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length, at most as often as counts says, so that the sum is as close to room as it can be without
    passing it. Bit s of a set tells that the sum s can be reached; lengths are added from the longest, so that of equal
    fills the one with the longer pieces is found, and short ones are left for later."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n, k in counts.items() if k and n <= room), reverse=True):
        steps.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:  # multiples by doubling
            taken = min(step, left)
            reach |= (reach << (taken * length)) & mask
            left, step = left - taken, step * 2
        if reach >> room & 1:
            break
    rest, out = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> rest & 1:
            out[length] = out.get(length, 0) + 1
            rest -= length
    return out


def windows(lengths: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that hold each item's tokens once.

    Whole windows of long items come first. Each further window takes the longest remainder and those that fill the rest best
    (minimum bin slack). Where no choice fills it, the slack is cut off the longest remainder that is left, which is longer
    than the slack, or it would have been chosen. What is left at the end makes less than a window: it is cut into sequences
    whose lengths are powers of two, which need no padding.
    """
    waiting: dict[int, list[tuple[int, int]]] = {}
    for item, length in enumerate(lengths):
        whole = length - length % window
        for start in range(0, whole, window):
            yield [(item, start, window)]
        if length > whole:
            waiting.setdefault(length - whole, []).append((item, whole))
    counts = {n: len(some) for n, some in waiting.items()}

    def taken(length: int) -> tuple[int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return waiting[length].pop()

    while counts:
        longest = max(counts)
        pieces = [(*taken(longest), longest)]
        for length, times in fullest(counts, window - longest).items():
            pieces += [(*taken(length), length) for _ in range(times)]
        slack = window - sum(p[2] for p in pieces)
        if slack and counts:
            longest = max(counts)
            item, start = taken(longest)
            pieces.append((item, start, slack))
            counts[longest - slack] = counts.get(longest - slack, 0) + 1
            waiting.setdefault(longest - slack, []).append((item, start + slack))
        elif slack:
            yield from _powers(pieces, window - slack)
            return
        yield pieces


def _powers(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces laid end to end and cut into sequences of the powers of two that make up total."""
    pieces = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            some, room = [], 1 << bit
            while room:
                item, start, length = pieces.pop()
                some.append((item, start, min(length, room)))
                if length > room:
                    pieces.append((item, start + room, length - room))
                room -= min(length, room)
            yield some


_OUT = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def packed_documents(df: DataFrame, path: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most `window` tokens: doc_id, start (the document's ids before the piece),
    length, doc_tokens, sequence_id, offset (in the sequence) and ids (little-endian unsigned 32-bit).

    A document's ids are those of its text by the byte-level BPE file at path, in which special tokens' strings become these
    tokens, and END; a null text counts as empty. Each id lies in one piece, the pieces of a sequence follow each other from 0, and a
    sequence is full or has a power of two of tokens, so nothing is padded. Documents are packed in blocks of BLOCK_TOKENS as
    they lie in their partition, without a shuffle; at the end of a block at most log2(window) sequences are shorter.
    sequence_id is the partition's number times 2^32 plus the sequence's number there. Null ids and repeated rows are documents
    of their own; other columns are left out; an empty table gives no rows.
    """
    vocabulary = read(path)
    docs = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    kinds = {pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([T.StructField("_id", docs.schema["_id"].dataType), *(T.StructField(name, kinds[t]) for name, t in _OUT)])

    def packed(ids: pa.Array, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        raw = [t.tobytes() for t in tokens]
        item, start, length, sequence, offset = [], [], [], [], []
        number = first
        for pieces in windows([len(t) for t in tokens], window):
            at = 0
            for i, s, n in pieces:
                item.append(i)
                start.append(s)
                length.append(n)
                sequence.append(number)
                offset.append(at)
                at += n
            number += 1
        made = [start, length, [len(tokens[i]) for i in item], sequence, offset, [raw[i][4 * s : 4 * (s + n)] for i, s, n in zip(item, start, length)]]
        arrays = [ids.take(pa.array(item, pa.int64())), *(pa.array(x, type=t) for x, (_, t) in zip(made, _OUT))]
        return pa.RecordBatch.from_arrays(arrays, names=["_id", *(name for name, _ in _OUT)]), number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept("packing", lambda: ByteLevel(vocabulary, special=True))
        number = TaskContext.get().partitionId() << 32
        ids, tokens, size = [], [], 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for lo, hi in text_slices(texts, SLICE_BYTES):
                ids.append(batch.column(batch.schema.get_field_index("_id"))[lo:hi])
                for value in texts[lo:hi]:
                    made = codec.ids(value.as_py() or "")
                    made.append(END)
                    tokens.append(np.array(made, dtype="<u4"))
                    size += len(made)
                if size >= BLOCK_TOKENS:
                    out, number = packed(pa.concat_arrays(ids), tokens, number)
                    yield out
                    ids, tokens, size = [], [], 0
        if tokens:
            yield packed(pa.concat_arrays(ids), tokens, number)[0]

    return in_arrow(docs, run, schema, keep="packing").withColumnRenamed("_id", doc_id)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 1024 tokens, with the CRC-32 of its ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_packing": op12_packing}
