"""Cross-tokenizer alignment: the tokens of two vocabularies over the same bytes, by byte-owner arrays.

Every byte of a text has an owner in A and one in B. Where either owner changes, a new pair of overlapping tokens begins (a link);
where both change at once, both vocabularies have a boundary, and a new group begins.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import Scratch, cut, in_arrow, release, small_or_not, text_slices
from loomgraph.llm.vocabularies import ByteLevel, Pieces, kept, lengths, read

#: Bytes of text in a block of documents whose links are counted together before they are shuffled; a longer text is a block.
BLOCK_BYTES = 16_000_000
#: Bytes of text whose owner arrays are made at once.
SLICE_BYTES = 2_000_000


def owners(a_bytes: np.ndarray, b_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cut) of each link in order: the places of two tokens that overlap, and whether both begin there. a_bytes and
    b_bytes are the tokens' lengths, which have one sum."""
    a = np.repeat(np.arange(len(a_bytes), dtype=np.int32), a_bytes)
    b = np.repeat(np.arange(len(b_bytes), dtype=np.int32), b_bytes)
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.concatenate((np.zeros(min(len(a), 1), dtype=np.int64), np.flatnonzero(new_a | new_b) + 1))
    both = np.concatenate((np.ones(min(len(a), 1), dtype=bool), new_a & new_b))[at]
    return a[at], b[at], both


class Aligner:
    """Both vocabularies of a worker."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a, self.b = ByteLevel(a_file, special=False), Pieces(b_file)
        self.a_bytes, self.b_bytes = lengths(self.a.entries, self.a.size), lengths(self.b.entries, self.b.size)
        written = [str(k) for k in range(max(self.a.size, self.b.size))]
        self.followed = {end: np.array([w + end for w in written], dtype=object) for end in ",|;"}

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of " " + text in A and of text in B; none where either's bytes aren't those of " " + text."""
        if not text:
            return [], []
        want = b" " + text.encode()
        a, b = self.a.ids(" " + text), self.b.ids(text)
        if b"".join(map(self.a.entries.__getitem__, a)) != want or b"".join(map(self.b.entries.__getitem__, b)) != want:
            return [], []
        return a, b

    def aligned(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, [self.tokens(t) for t in texts])


class Aligned:
    """The links and groups of some texts, whose tokens lie one text after the other."""

    def __init__(self, aligner: Aligner, tokens: list[tuple[list[int], list[int]]]):
        flat = lambda k: np.array([i for pair in tokens for i in pair[k]], dtype=np.int64)
        self.aligner, self.a, self.b = aligner, flat(0), flat(1)
        self.n_a, self.n_b = (np.array([len(pair[k]) for pair in tokens], dtype=np.int64) for k in (0, 1))
        self.at_a, self.at_b, self.cut = owners(aligner.a_bytes[self.a], aligner.b_bytes[self.b])
        text_of = np.repeat(np.arange(len(tokens)), self.n_a)[self.at_a]
        self.n_links = np.bincount(text_of, minlength=len(tokens))
        self.n_groups = np.bincount(text_of[self.cut], minlength=len(tokens))
        self.pairs = self.a[self.at_a] * aligner.b.size + self.b[self.at_b]

    def written(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: A's and B's ids in order, group by group."""
        start_a, start_b = self.at_a[self.cut], self.at_b[self.cut]
        of_a = np.cumsum(np.bincount(start_a, minlength=len(self.a))[: len(self.a)]) - 1
        of_b = np.cumsum(np.bincount(start_b, minlength=len(self.b))[: len(self.b)]) - 1
        groups = len(start_a)
        ends = lambda of: np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, dtype=bool)
        # A group's A tokens come after all B tokens of the groups before it, its B tokens after its own A tokens.
        place_a = np.arange(len(self.a)) + start_b[of_a]
        place_b = np.arange(len(self.b)) + np.append(start_a[1:], len(self.a))[of_b] if groups else np.zeros(0, dtype=np.int64)
        said = np.empty(len(self.a) + len(self.b), dtype=object)
        follow = self.aligner.followed
        said[place_a] = np.where(ends(of_a), follow["|"][self.a], follow[","][self.a])
        said[place_b] = np.where(ends(of_b), follow[";"][self.b], follow[","][self.b])
        stops = np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))
        return ["".join(said[lo:hi].tolist())[:-1] for lo, hi in zip(stops, stops[1:])]

    def groups(self) -> list[list[dict]]:
        """Each text's groups with A's and B's ids."""
        return [[{"a": [int(i) for i in g.split("|")[0].split(",")], "b": [int(i) for i in g.split("|")[1].split(",")]} for g in s.split(";")] if s else [] for s in self.written()]


def alignments(df: DataFrame, a_path: str, b_path: str, text: str = "text", out: str = "groups") -> DataFrame:
    """df with its texts' groups, array<struct<a: array<int>, b: array<int>>>: the ids of A (a byte-level BPE file, over a space and
    the text) and of B (a piece BPE model) between two offsets at which both have a boundary. Texts that are null, empty
    or not rebuilt byte by byte have none. Rows are neither dropped nor merged; a column that is named out is replaced."""
    a_file, b_file = read(a_path), read(b_path)
    df = df.drop(out)
    ids = T.ArrayType(T.IntegerType())
    field = T.StructField(out, T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)])))
    arrow = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept("aligner", lambda: Aligner(a_file, b_file))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for lo, hi in text_slices(texts, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                made = pa.array(aligner.aligned(texts[lo:hi].to_pylist()).groups(), type=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return in_arrow(df, run, T.StructType([*df.schema.fields, field]), keep="aligner")


#: What a document's row has in the blocks' table, beside its block and id; a pair's row has block, pair, rank and n.
_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary())]
_PAIR = [("pair", pa.int64()), ("rank", pa.int64()), ("n", pa.int64())]


class _Block:
    """Documents of one task whose links are gathered; at the end a row for each document and one for each distinct pair."""

    def __init__(self, name: str):
        self.name, self.bytes, self.ids, self.docs, self.pairs = name, 0, [], [], []

    def add(self, ids: pa.Array, aligned: Aligned, size: int) -> None:
        shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in aligned.written()]
        self.ids.append(ids)
        self.docs += zip(aligned.n_a.tolist(), aligned.n_b.tolist(), aligned.n_groups.tolist(), aligned.n_links.tolist(), shas)
        self.pairs.append(aligned.pairs)
        self.bytes += size

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        pairs, rank, n = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        self.pairs = []
        order = np.argsort(-n, kind="stable")  # frequent pairs get small numbers, which compress
        new = np.empty(len(order), dtype=np.uint32)
        new[order] = np.arange(len(order), dtype=np.uint32)
        links = new[rank]
        columns = dict(zip([name for name, _ in _DOC], zip(*self.docs)))
        stops = np.concatenate(([0], np.cumsum(columns["n_links"])))
        packed = [zlib.compress(links[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for lo, hi in zip(stops, stops[1:])]
        ids = pa.concat_arrays(self.ids)
        made = {"_id": ids, "links": packed, **columns}
        yield self._batch(schema, made, len(ids))
        for lo in range(0, len(order), 50_000):
            some = order[lo : lo + 50_000]
            yield self._batch(schema, {"pair": pairs[some], "rank": np.arange(lo, lo + len(some)), "n": n[some]}, len(some))

    def _batch(self, schema: pa.Schema, made: dict, n: int) -> pa.RecordBatch:
        made["block"] = [self.name] * n
        arrays = [made[f.name] if isinstance(made.get(f.name), pa.Array) else pa.array(made[f.name], type=f.type) if f.name in made else pa.nulls(n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _blocks(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document of df (_id, text), and for each block of documents a row for each of its distinct pairs."""
    a_file, b_file = read(a_path), read(b_path)
    id_type = df.schema["_id"].dataType
    spark_type = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    fields = [T.StructField("block", T.StringType()), T.StructField("_id", id_type), *(T.StructField(name, spark_type[t]) for name, t in [*_DOC, *_PAIR])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept("aligner", lambda: Aligner(a_file, b_file))
        task, made, schema, block = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("block", pa.string()), ("_id", batch.schema.field("_id").type), *_DOC, *_PAIR])
            texts = batch.column(batch.schema.get_field_index("text"))
            for lo, hi in text_slices(texts, SLICE_BYTES):
                block = block or _Block(f"{task}-{made}")
                block.add(batch.column(batch.schema.get_field_index("_id"))[lo:hi], aligner.aligned(texts[lo:hi].to_pylist()), texts[lo:hi].nbytes)
                if block.bytes >= BLOCK_BYTES:
                    yield from block.rows(schema)
                    block, made = None, made + 1
                    release()
        if block:
            yield from block.rows(schema)

    return in_arrow(df, run, T.StructType(fields), keep="aligner")


def link_counts(pairs: DataFrame, b_size: int) -> DataFrame:
    """(pair, total, best): how many links hold each id pair, a row for each pair and block being given with its own number n,
    and whether that is the highest of the pair's B id (ties included). A pair is A's id times b_size plus B's."""
    total = cut(pairs.groupBy("pair").agg(F.sum("n").alias("total")))
    of_b = F.pmod("pair", F.lit(b_size))
    most = total.groupBy(of_b.alias("_b")).agg(F.max("total").alias("_most"))  # a row for each entry of B's vocabulary at most
    return total.join(F.broadcast(most), of_b == F.col("_b")).select("pair", "total", (F.col("total") == F.col("_most")).alias("best"))


def aligned_documents(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's doc_id with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    A is a byte-level BPE file over a space and the text, B a piece BPE model over the text. A link's count is the number of
    links in all of df that hold the same two ids; n_best are the links whose count is the highest of their B id (ties included),
    count_sum is the sum over the links. Texts that are null, empty or not rebuilt byte by byte have zeros and an empty digest, and
    no links. Null ids and repeated rows stay rows of their own; other columns are left out; an empty table gives no rows.

    Links are counted in blocks of BLOCK_BYTES before they are shuffled, so a pair has as many rows as there are blocks at most,
    however frequent it is; a block's counts come back to its documents, both of bounded size.
    """
    b_size = Pieces(read(b_path)).size
    docs = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    with Scratch(df.sparkSession) as scratch:
        blocks = scratch.written(_blocks(docs, a_path, b_path), "alignment")
        pairs = blocks.filter("pair IS NOT NULL").select("block", "pair", "rank", "n")
        answers = pairs.join(small_or_not(link_counts(pairs, b_size)), "pair").select(F.col("block").alias("_block"), "rank", "total", "best")
        rows = blocks.filter("pair IS NULL").select("block", "_id", *[name for name, _ in _DOC])
        out = T.StructType([T.StructField("_id", docs.schema["_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

        def answered(documents: pa.Table, said: pa.Table) -> pa.Table:
            total, best = np.zeros((2, said.num_rows), dtype=np.int64)
            rank = said.column("rank").to_numpy()
            total[rank], best[rank] = said.column("total").to_numpy(), said.column("best").to_numpy()
            n_best, count_sum = [], []
            for packed in documents.column("links").to_pylist():
                links = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                n_best.append(int(best[links].sum()))
                count_sum.append(int(total[links].sum()))
            kept_columns = {c: documents.column(c) for c in ("_id", "n_a", "n_b", "n_groups", "n_links")}
            return pa.table({**kept_columns, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": documents.column("groups_sha256")})

        made = rows.groupBy("block").cogroup(answers.groupBy("_block")).applyInArrow(answered, out)
        return cut(made.select(F.col("_id").alias(doc_id), *out.names[1:]))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups and links between the two vocabularies, with the links' counts in all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return aligned_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_alignment": op11_alignment}
