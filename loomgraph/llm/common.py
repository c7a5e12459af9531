"""Helpers that the corpus operators share: lineage cuts, hot keys, size-checked joins, lower-casing and hashing."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of a side that may be broadcast after they have been counted; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000
#: Least and most bits of a table that tells which ids may be among others; the most take 16 MB.
LIKELY_BITS = (16, 27)
#: A key is hot when it has more than 1 / HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 512
#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000
#: Upper-case ASCII and the lower-case letters it becomes (the contracts lower-case A-Z only).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of our own only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-checkpoints-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lineage cut for wide or large rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that an operator writes on its way; they go when it has what it needs behind a checkpoint."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            removed(self.spark, path)


def _width(f: T.StructField):
    """The bytes of a column's value, about."""
    if isinstance(f.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
    if isinstance(f.dataType, T.ArrayType | T.MapType):
        return F.greatest(F.size(f.name), F.lit(0)) * 16 + 16
    return F.lit(8)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether df has been counted to have limit (BROADCAST_ROWS) rows and BROADCAST_BYTES at most."""
    limit = BROADCAST_ROWS if limit is None else limit
    some = df.limit(limit + 1)
    rows, size = some.agg(F.count(F.lit(1)), F.sum(sum((_width(f) for f in df.schema.fields), F.lit(0)))).first()
    return rows <= limit and (size or 0) <= BROADCAST_BYTES


def small_or_not(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is small, else df for a shuffled join."""
    return F.broadcast(df) if is_small(df, limit) else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined with groups (one row for each key; keys of bounded width): by a broadcast if groups has been counted
    to have BROADCAST_ROWS at most, else by a shuffle in which hot keys are dealt over many tasks.

    size: the column of groups that holds the rows of its key; total: the rows of all. The keys with more than
    total / HOT_SHARE rows are at most HOT_SHARE by counting (where total is less, the 2 * HOT_SHARE largest are taken), so the
    number of parts that each is dealt to is a constant of the plan, and no row is joined for it; the groups of hot keys are
    repeated once for each part.
    """
    if is_small(groups):
        return rows.join(F.broadcast(groups), keys, "left")
    kinds = dict(groups.dtypes)
    hashed = F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys])
    most = groups.filter(F.col(size) * HOT_SHARE > total).select(hashed.alias("_h"), F.col(size).alias("_n")).orderBy(F.desc("_n")).limit(2 * HOT_SHARE).collect()
    if not most:
        return rows.join(groups, keys, "left")
    # In powers of two; hashes that meet only deal one key more, as rows and groups are dealt alike.
    dealt: dict[int, set[int]] = {}
    for h, n in most:
        dealt.setdefault(1 << min(-(-n * HOT_SHARE // max(total, 1)) - 1, HOT_SHARE - 1).bit_length(), set()).add(h)
    parts = F.lit(1)
    for n, some in sorted(dealt.items()):
        parts = F.when(hashed.isin(*some), F.lit(n)).otherwise(parts)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int"))
    return rows.join(groups.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "_part"], "left").drop("_part")


def table_bits(keys: int) -> int:
    """Bits of a table for so many keys, so that about one other key in 16 or less meets a bit that is set."""
    return min(max((16 * keys).bit_length(), LIKELY_BITS[0]), LIKELY_BITS[1])


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A table of fixed size (2 ** bits bits in rows of 4 KB) in which the bit of each 64-bit key is set."""
    at = F.pmod(F.col(key), F.lit(1 << bits))
    return (
        keys.select(F.shiftright(at, 15).alias("_page"), at.bitwiseAND(F.lit(32767)).alias("_bit"))
        .groupBy("_page")
        .agg(F.bitmap_construct_agg("_bit").alias("_map"))
    )


def in_bitmap(df: DataFrame, key: str, table: DataFrame, bits: int, out: str) -> DataFrame:
    """df with the boolean out: whether the key's bit is set in table, a broadcast of 2 ** bits / 8 bytes at most."""
    at = F.pmod(F.col(key), F.lit(1 << bits))
    bit = at.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return df.withColumn("_page", F.shiftright(at, 15)).join(F.broadcast(table), "_page", "left").withColumn(out, found).drop("_page", "_map")


def _marked(df: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    """df with the boolean out: false where key is none of ids, by a table of bits sized from their number."""
    bits = table_bits(ids.count())
    hashed = F.xxhash64(F.col(key).cast("string"))  # the same for an id of any type
    table = cut(bitmap(ids.select(hashed.alias("_h")), "_h", bits))
    return in_bitmap(df.withColumn("_h", hashed), "_h", table, bits, out).drop("_h")


def likely_among(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of df whose key is among ids, and few others where ids are many; wide rows aren't shuffled for it."""
    return df.join(F.broadcast(ids), key, "left_semi") if is_small(ids) else _marked(df, ids, key, "_in").filter("_in").drop("_in")


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of df whose key isn't among ids, null keys too. Where ids are many, only rows that may be among them are shuffled."""
    if is_small(ids):
        return df.join(F.broadcast(ids), key, "left_anti")
    columns = df.columns
    marked = _marked(df, ids, key, "_in")
    return marked.filter("NOT _in").select(*columns).unionByName(marked.filter("_in").drop("_in").join(ids, key, "left_anti").select(*columns))


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(modulus))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


_CLASSES: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what isn't a letter; made once in each worker."""
    if "letters" not in _CLASSES:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x30000):
            if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _CLASSES["letters"] = table
    return _CLASSES["letters"]


def kind_table() -> np.ndarray:
    """0 other, 1 lower-case or caseless letter, 2 upper-case letter, 3 digit, 4 white space, for each code point."""
    if "kinds" not in _CLASSES:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x30000):
            if not 0xD800 <= c < 0xE000:
                ch = chr(c)
                table[c] = 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit() else 4 if ch.isspace() else 0
        _CLASSES["kinds"] = table
    return _CLASSES["kinds"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, a NUL before each, and where each text's NUL is."""
    joined = "".join("\0" + t for t in texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, dtype=np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def slices(texts: list[str], chars: int = 250_000):
    """(from, to) of runs of texts of about `chars` characters; a longer text is a run of its own."""
    lo = size = 0
    for hi, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield lo, hi + 1
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def text_slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    lo = size = 0
    for hi, length in enumerate(pc.binary_length(column).to_pylist()):
        size += length or 0
        if size >= most:
            yield lo, hi + 1
            lo, size = hi + 1, 0
    if lo < len(column):
        yield lo, len(column)


class Remembered(dict):
    """A dict that knows about how many bytes it takes; its owner starts a new one when they are too many."""

    #: Of an entry, beside the key and the value.
    ENTRY = 110

    def __init__(self):
        super().__init__()
        self.bytes = 0

    def keep(self, keys: Iterable, values: Iterable) -> None:
        keys, values = list(keys), list(values)
        self.update(zip(keys, values))
        self.bytes += sum(map(sys.getsizeof, keys)) + sum(map(sys.getsizeof, values)) + self.ENTRY * len(keys)


#: Bytes of text whose words are hashed at once; a longer word is hashed by itself.
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_LOW = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def hashed_words(text: str | None) -> np.ndarray:
    """64-bit hashes (uint64) of the text's words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in order. A word's hash depends on its
    bytes alone: the sum of their values times the powers of an odd base, which is found for all words at once."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.full(_CHUNK, base, dtype=np.uint64)))
    data = (text or "").encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > _CHUNK:
            end = max(data.rfind(c, at, at + _CHUNK + 1) for c in _SPACES)
            if end < 0:  # a word that is longer
                after = [e for c in _SPACES if (e := data.find(c, at)) >= 0]
                end = min(after, default=len(data))
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].lower())], dtype=np.uint64))
                at = end
                continue
            end = max(end, at + 1)
        out.append(_hashed(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, dtype=np.uint64)])


_SPACES = [bytes([c]) for c in (9, 10, 11, 12, 13, 32)]


def _hashed(b: np.ndarray) -> np.ndarray:
    space = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = edges if space[0] else np.concatenate(([0], edges))
    if not len(edges):
        return np.zeros(0, dtype=np.uint64)
    value = _LOW[b].astype(np.uint64)
    value += np.uint64(1)
    value *= _POWERS[0][: len(b)]
    return mixed(np.add.reduceat(value, edges)[::2] * _POWERS[1][edges[::2]])


def release() -> None:
    """Gives memory that a task no longer needs back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: What a worker keeps from task to task of one kind, such as a vocabulary; it goes when a task of another kind comes.
KEPT: dict[str, object] = {}


def keep_only(kind: str | None) -> None:
    others = [k for k in KEPT if k != kind]
    for other in others:
        del KEPT[other]
    if others:
        release()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of bounded bytes, whose worker gives its memory back at the end of the task. keep:
    the kind of task, which may leave something in KEPT."""

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keep)
        pa.set_memory_pool(pa.system_memory_pool())  # whose memory release() can give back
        try:
            yield from run(batches)
        finally:
            release()

    small_batches(df.sparkSession)
    return df.mapInArrow(slim, schema)


def small_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of BATCH_ROWS rows and BATCH_BYTES bytes at most, where the session has larger ones."""
    size_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size_of(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def plain_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values, one for each value of x (uint64)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the smallest node that each reaches. Labels move along edges and jump to
    their label's label until none changes; every round is checkpointed, and nothing but counts comes to the driver."""
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).filter("node <> other").distinct())
    labels = cut(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("_near")), "other").groupBy("node").agg(F.min("_near").alias("_near"))
        moved = labels.join(near, "node").select("node", F.least("label", "_near").alias("label"), F.col("label").alias("_was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        jumped = cut(moved.join(up, "label", "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "_was"))
        changed = jumped.filter("label <> _was").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def pack(x: np.ndarray) -> bytes:
    """A sorted uint64 array as differences, by byte planes, which compress where differences are small."""
    return np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)
