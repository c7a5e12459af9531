"""N-gram Jaccard join by partitioning the universe of shingles.

Sets of like size are put on one shelf. A shelf's hash deals shingles into segments; sets that differ in U shingles at most
agree in at least one of U + 1 exact segments, or, where a segment is also indexed by its one-deletion neighbourhood, that
segment stands for two. Which segments a shelf indexes in which way is chosen by cost. Candidates are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, bitmap, components, cut, hashed_words, in_arrow, is_small, join_groups, likely_among, mixed, pack, release, small_or_not, table_bits, text_slices, unpack, without, written

#: Partners of one document that one task verifies.
PARTNERS_A_TASK = 256
#: Members of a bucket up to which its pairs are listed; larger ones are refined, LEVELS times at most. What is still large
#: then shares rare differences again and again, and is listed too.
LISTED, LEVELS = 32, 4
#: Entries that one task counts, those whose marks are packed at once, and bytes of texts whose entries are made at once.
BUCKET_ENTRIES, CHUNK_ENTRIES, SLICE_BYTES = 500_000, 300_000, 200_000
#: Places in the table of bits for each key that several sets have.
KEY_PLACES = 64
#: What looking at a pair costs, in index entries: a pair is a row of a join and two sketches, an entry some three bytes.
PAIR_COST = 20

_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct n-word shingles; of the whole sequence where there are fewer words."""
    h = hashed_words(text)
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, np.uint64(k) * np.uint64(0x2545F4914F6CDD1D), dtype=np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * (_FACTORS[i % 5] + np.uint64(2 * (i // 5)))
    total = mixed(total)
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


@lru_cache(maxsize=None)
def _bands(percent: int, most: int) -> tuple[int, ...]:
    """Least size of each band, so that a set's partners lie in its own band or a neighbouring one."""
    least = [1]
    while least[-1] <= most:
        least.append(least[-1] * 100 // percent + 1)
    return (*least, least[-1] * 100 // percent + 1, (least[-1] * 100 // percent + 1) * 100 // percent + 1)


def _band(size: int, percent: int) -> int:
    return int(np.searchsorted(_bands(percent, 1 << size.bit_length()), size, side="right")) - 1


@lru_cache(maxsize=None)
def shelf_budget(shelf: int, percent: int) -> int:
    """The most shingles in which two linked sets of a shelf (the smaller in band `shelf`) can differ."""
    most = 16
    while len(_bands(percent, most)) < shelf + 4:
        most *= 2
    small = _bands(percent, most)[shelf + 1] - 1
    return (small + small * 100 // percent) * (100 - percent) // (100 + percent)


def allocation(budget: int, size: float, sets: int) -> tuple[int, int]:
    """(exact, deletion) segments of least cost with exact + 2 * deletion > budget, for a shelf of so many sets of that size.

    The cost counts index entries and the pairs of unlike sets expected to share one: those whose segment is empty in both, or
    with a deletion holds one shingle at most. Exact segments need fewer entries, deletions fewer and larger segments.
    """
    best = None
    for deletion in {0, 1, (budget + 1) // 4, (budget + 1) // 2, -(-(budget + 1) // 2)}:
        exact = max(0, budget + 1 - 2 * deletion)
        if exact + deletion == 0:
            continue
        k = size / (exact + deletion)
        entries = sets * (exact + deletion * (k + 1))
        chance = np.exp(-2 * k)
        pairs = PAIR_COST * sets * sets / 2 * (exact * chance + deletion * chance * (1 + 2 * k))
        if best is None or entries + pairs < best[0]:
            best = (entries + pairs, exact, deletion)
    return best[1:]


@lru_cache(maxsize=256)
def _salts(shelf: int, segments: int) -> np.ndarray:
    return mixed(np.arange(segments, dtype=np.uint64) + np.uint64(shelf * int(_FACTORS[2]) & (1 << 64) - 1))


def index_keys(tokens: np.ndarray, shelf: int, exact: int, deletion: int) -> np.ndarray:
    """The keys under which a set is indexed on a shelf: a sum of hashes for each segment, and for deletion segments also
    that sum less each of the segment's shingles."""
    m = exact + deletion
    segment = (mixed(tokens + np.uint64(shelf * int(_FACTORS[0]) & (1 << 64) - 1)) >> np.uint64(20)) % np.uint64(m)
    segment = segment.astype(np.int64)
    value = mixed(tokens ^ _FACTORS[1])
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, segment, value)
    salt = _salts(shelf, m)
    keys = mixed(sums + salt)
    if deletion:
        loose = segment >= exact
        keys = np.concatenate([keys, mixed(sums[segment[loose]] - value[loose] + salt[segment[loose]])])
    return keys.view(np.int64)


def sketch(tokens: np.ndarray, shelf: int, percent: int) -> np.ndarray:
    """A parity bit for each of as many bits as three quarters of the shelf's sizes, in words of 64: two sets' sketches never
    differ in more bits than the sets do in shingles."""
    words = max(1, _bands(percent, 1 << 40)[shelf] * 3 // 4 // 64 + 1)
    at = mixed(tokens ^ _FACTORS[4]) % np.uint64(words * 64)
    bits = (np.bincount(at.astype(np.int64), minlength=words * 64) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, h1, h2): the size of each row's set and 128 bits that stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, h1, h2 = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), n)
                size.append(len(s))
                h1.append(int(mixed(s ^ _FACTORS[2]).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(mixed(s ^ _FACTORS[3]).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["id", "n", "h1", "h2"])

    return in_arrow(docs, run, "id long, n long, h1 long, h2 long")


def _entries(batches: Iterator[pa.RecordBatch], n: int, percent: int, plan: dict[int, tuple[int, int]]) -> Iterator[tuple[np.ndarray, list, list, list]]:
    """(ids, sizes, low, high) of batches (id, text): each row's keys on its own band's shelf, where it is the smaller, and on
    the shelf below. They are as large as the texts, so they are made anew where they are read, not stored; a slice of the
    rows at a time."""
    none = np.zeros(0, dtype=np.int64)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in text_slices(batch.column(1), SLICE_BYTES):
            size, low, high = [], [], []
            for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                s = shingle_set(text, n)
                band = _band(len(s), percent) if len(s) else -9
                size.append(len(s))
                for out, shelf in ((low, band), (high, band - 1)):
                    out.append(index_keys(s, shelf, *plan[shelf]) if shelf in plan else none)
            yield ids[lo:hi], size, low, high


def _sketches(docs: DataFrame, n: int, percent: int, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """(id, low_sketch, high_sketch): each row's sketches on the same two shelves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text in batch.column(1):
                s = shingle_set(text.as_py(), n)
                band = _band(len(s), percent) if len(s) else -9
                for bits, shelf in zip(out, (band, band - 1)):
                    bits.append(sketch(s, shelf, percent) if shelf in plan else ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in out)], names=["id", "low_sketch", "high_sketch"])

    return in_arrow(docs, run, "id long, low_sketch array<bigint>, high_sketch array<bigint>")


def compare(texts: DataFrame, pairs: DataFrame, n: int, percent: int, differences: bool = False) -> DataFrame:
    """(a, b, n, m, d, linked, diff) for pairs (a, b) of ids: b's and a's set size, in how many shingles the whole sets differ, whether
    they are linked, and with `differences` those shingles. Each a's text is sent once to every task that holds up to
    PARTNERS_A_TASK of its partners, and these stream past it, so no task holds more than a's set and one partner."""
    pairs = cut(pairs.distinct())
    involved = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = likely_among(texts, involved)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS_A_TASK).cast("int").alias("_parts"))
    wide = parts.filter("_parts > 1")  # at most pairs / PARTNERS_A_TASK rows
    partners = pairs.join(small_or_not(wide), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).cast("int"))
    partners = partners.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role"))
    heads = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("role"))
    rows = partners.unionByName(heads).join(texts, "id").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sets = None, []
        for batch in batches:
            out = []
            ids, owners, parts_, roles = (batch.column(i).to_pylist() for i in range(4))
            for k, text in enumerate(batch.column(4)):
                tokens = shingle_set(text.as_py(), n)
                if roles[k] == 0:
                    if head != (owners[k], parts_[k]):
                        head, sets = (owners[k], parts_[k]), []
                    sets.append(tokens)
                    continue
                for other in sets:  # more than one where rows repeat an id with different texts
                    diff = np.setxor1d(tokens, other, assume_unique=True)
                    sizes = len(tokens) + len(other)
                    linked = len(tokens) > 0 < len(other) and (100 + percent) * len(diff) <= (100 - percent) * sizes
                    out.append((owners[k], ids[k], len(tokens), len(other), len(diff), linked, diff.view(np.int64) if differences else ()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(_COMPARED)], names=["a", "b", "n", "m", "d", "linked", "diff"])

    return in_arrow(rows.select("id", "a", "part", "role", "text"), run, "a long, b long, n long, m long, d long, linked boolean, diff array<bigint>")


_COMPARED = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]


def _marks(keys: np.ndarray, bits: int) -> np.ndarray:
    """A mark of so many bits for each key."""
    return mixed(keys.view(np.uint64)) >> np.uint64(64 - bits)


def _shared_keys(docs: DataFrame, n: int, percent: int, plan: dict[int, tuple[int, int]], total: int) -> tuple[DataFrame, int]:
    """(mark, size) of the marks of keys that several sets have, one of them as the smaller, and the bits of a mark: so many
    that hardly any two of the keys have one mark, and those that do only add entries to look at. Marks are counted in packed
    sorted arrays, one for each part of a task's rows and range of marks, so a key is sent once for each part, however many
    sets have it, and in about as many bytes as tell it from the next."""
    buckets = max(16, -(-int(total) // BUCKET_ENTRIES))
    bits = min(max(int(total).bit_length() + 12, 32), 56)
    width = -(-(1 << bits) // buckets)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """The marks of some rows, each with a last bit that tells whether its set is the smaller."""
        held, size = [], 0
        for _, _, *lists in _entries(batches, n, percent, plan):
            for keys, small in zip(lists, (1, 0)):
                held.append(_marks(np.concatenate(keys), bits) << np.uint64(1) | np.uint64(small))
                size += len(held[-1])
            if size >= CHUNK_ENTRIES:
                both, held, size = np.concatenate(held), [], 0
                yield both
                del both
        if size:
            yield np.concatenate(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in gathered(batches):
            both.sort()  # in place: a mark's last entry has its bit set if any has
            last = np.flatnonzero(np.append(both[1:] ^ both[:-1] > np.uint64(1), True))
            often, small = np.diff(last, prepend=-1).astype("<u4"), both[last] & np.uint64(1) > 0
            marks = both[last] >> np.uint64(1)
            del both, last
            ends = np.searchsorted(marks, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))
            held = np.nonzero(np.diff(ends))[0].tolist()
            parts = [slice(ends[b], ends[b + 1]) for b in held]
            packed = [pack(marks[at] - np.uint64(b * width)) for b, at in zip(held, parts)]
            counts = [often[at].view(np.uint8).reshape(-1, 4).T.tobytes() for at in parts]
            bits_of = [np.packbits(small[at]).tobytes() for at in parts]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *(pa.array(c, pa.binary()) for c in (packed, counts, bits_of))], names=["bucket", "marks", "n", "small"])

    def count(rows: pa.Table) -> pa.Table:
        each = [unpack(b.as_py()) for b in rows["marks"]]
        often = np.concatenate([np.frombuffer(b.as_py(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for b in rows["n"]])
        small = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=len(e)) for b, e in zip(rows["small"], each)])
        marks = np.concatenate(each)
        del each
        order = np.argsort(marks)
        marks = marks[order]
        first = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        often, small, marks = np.add.reduceat(often[order], first, dtype=np.int64), np.maximum.reduceat(small[order], first), marks[first]
        use = (often > 1) & (small > 0)
        start = np.uint64(rows["bucket"][0].as_py() * width)
        out = pa.table({"mark": (marks[use] + start).view(np.int64), "size": often[use]})
        del order, first, marks, often, small
        release()
        return out

    asked = in_arrow(docs.select("id", "text"), ask, "bucket long, marks binary, n binary, small binary")
    return cut(asked.groupBy("bucket").applyInArrow(count, "mark long, size long")), bits


def _set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits are set at these places."""
    return table[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _shared_entries(docs: DataFrame, n: int, percent: int, plan: dict[int, tuple[int, int]], shared: DataFrame, bits: int) -> DataFrame:
    """The index's entries whose marks are shared, and hardly any others: (mark, key, id, n, index, open). A bit table, sized from the
    number of shared marks up to 16 MB, sorts out nearly all others before any row is made of them; the keys' counts decide. A mark
    has two bits there, by its lower and its upper end, so that hardly one in a thousand others meets both."""
    size = min(table_bits(shared.count() * KEY_PLACES // 16), bits)
    table = np.zeros(1 << (size - 3), dtype=np.uint8)
    ends = shared.select(F.explode(F.array("mark", F.shiftright("mark", bits - size))).alias("mark"))
    for page, found in bitmap(ends, "mark", size).collect():
        table[page * 4096 : (page + 1) * 4096] = np.frombuffer(found, dtype=np.uint8)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, low, high in _entries(batches, n, percent, plan):
            for lists, small in ((low, True), (high, False)):
                keys = np.concatenate(lists)
                marks = _marks(keys, bits).view(np.int64)
                use = np.flatnonzero(_set(table, marks & ((1 << size) - 1)))
                use = use[_set(table, marks[use] >> (bits - size))]
                row = np.repeat(np.arange(len(ids)), list(map(len, lists)))[use]
                flag = lambda v: pa.array(np.full(len(row), v))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(marks[use]), pa.array(keys[use]), pa.array(ids[row]), pa.array(np.array(sizes, dtype=np.int64)[row]), flag(small), flag(True)], names=["mark", "key", "id", "n", "index", "open"])

    return in_arrow(docs.select("id", "text"), pick, "mark long, key long, id long, n long, index boolean, open boolean")


def _live(buckets: DataFrame) -> DataFrame:
    """buckets (key, id, n, index, open), written, with their size, less those that hold no pair to look at and those that have the
    same members as another: near copies share most of their keys. Most rows go by a table of bits before any is shuffled."""
    member = F.xxhash64("id", "index", "open")
    rows = F.count(F.lit(1)).alias("size")
    kinds = buckets.groupBy("key").agg(F.bit_xor(member).alias("_x"), F.sum(member.bitwiseAND(F.lit((1 << 40) - 1))).alias("_s"), rows, F.count_if("index").alias("_i"), F.count_if("open").alias("_o"))
    first = cut(kinds.filter("size > 1 AND _i > 0 AND _o > 0").groupBy("_x", "_s", "size").agg(F.min("key").alias("key")).select("key", "size"))
    some = buckets if is_small(first) else likely_among(buckets, first.select("key"), "key")
    return join_groups(some, first, ["key"], "size", max(1, first.count())).filter("size IS NOT NULL")


def _apart(a: str, b: str) -> Column:
    """In how many bits two sketches differ, a lower bound of the shingles in which the sets do; null if one is missing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def _apart_still(buckets: DataFrame) -> DataFrame:
    """Of buckets (key, id, comp, ...) those whose members are of several components."""
    kinds = buckets.groupBy("key").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most"), F.count(F.lit(1)).alias("_rows"))
    several = cut(kinds.filter("_least <> _most").select("key", "_rows"))
    return join_groups(buckets, several, ["key"], "_rows", max(1, several.count())).filter("_rows IS NOT NULL").drop("_rows")


def _with_components(rows: DataFrame, labels: DataFrame | None, key: str = "id", out: str = "comp") -> DataFrame:
    """rows with the component of each id, the id itself where it is linked with none."""
    if labels is None:
        return rows.withColumn(out, F.col(key))
    named = labels.select(F.col("node").alias(key), F.col("label").alias("_label"))
    joined = rows.join(F.broadcast(named) if is_small(named) else named, key, "left")
    return joined.withColumn(out, F.coalesce("_label", key)).drop("_label")


def _first_links(texts: DataFrame, buckets: DataFrame, n: int, percent: int) -> DataFrame | None:
    """Links of the members of large buckets with one head each: of the most connected members of their buckets the one that is
    most connected, the original where its copies are there. Most of a group is one component after it."""
    large = buckets.filter(F.col("size") > LISTED)
    if not large.limit(1).count():
        return None
    score = cut(large.groupBy("id").agg(F.sum("size").alias("score")))
    best = F.max(F.struct("score", (-F.col("id")).alias("minus"), F.col("n").alias("head_n"), F.col("index").alias("head_index"), F.col("sketch").alias("head_sketch")))
    heads = cut(large.join(score, "id").groupBy("key").agg(best.alias("h"), F.max("size").alias("rows")))
    headed = join_groups(large, heads, ["key"], "rows", max(1, heads.count()))
    near = F.coalesce(_apart("sketch", "h.head_sketch") * (100 + percent) <= (F.col("n") + F.col("h.head_n")) * (100 - percent), F.lit(True))
    own = headed.filter(near & (-F.col("h.minus") != F.col("id"))).groupBy("id").agg(F.max(F.struct("h.score", "h.minus")).alias("h"))
    pairs = own.select((-F.col("h.minus")).alias("a"), F.col("id").alias("b"))
    return cut(compare(texts, pairs, n, percent).filter("linked").select("a", "b").distinct())


def _listed(some: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """The pairs of a member of `some` and one of `others` in one bucket, one an index entry, one open, of two components, whose
    sizes and sketches allow a link."""
    x, y = some.alias("x"), others.alias("y")
    fits = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    most = F.floor((F.col("x.n") + F.col("y.n")) * (100 - percent) / (100 + percent))
    fits = fits & F.coalesce(_apart("x.sketch", "y.sketch") <= most, F.lit(True)) & (F.col("x.comp") != F.col("y.comp"))
    wanted = (F.col("x.index") | F.col("y.index")) & (F.col("x.open") | F.col("y.open")) & (F.col("x.id") < F.col("y.id") if some is others else F.col("x.id") != F.col("y.id")) & fits
    return x.join(y, (F.col("x.key") == F.col("y.key")) & wanted).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _slots(heads: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each head's token in a table of 2 ** bits."""
    return (mixed(tokens ^ mixed(heads.view(np.uint64) ^ _FACTORS[1])) >> np.uint64(64 - bits)).astype(np.int64)


def _token_counts(compared: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each counter of a table of fixed size is met by the tokens of all members, and by those of open ones, up to
    65,535. Each task sends pages of its own table, which are summed by page."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << bits), dtype=np.uint32)
        for batch in batches:
            heads, linked, diff = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            sizes = pc.list_value_length(diff).to_numpy()
            slots = _slots(np.repeat(heads, sizes), diff.flatten().to_numpy().view(np.uint64), bits)
            for counts, some in zip(table, (slots, slots[np.repeat(~linked, sizes)])):
                at, n = np.unique(some, return_counts=True)
                counts[at] += n.astype(np.uint32)
        pages = table.reshape(2, -1, _PAGE)
        for p in np.nonzero(pages[0].any(axis=1))[0]:
            yield pa.RecordBatch.from_arrays([pa.array([int(p)]), pa.array([pages[0, p].tobytes()]), pa.array([pages[1, p].tobytes()])], names=["page", "every", "open"])

    def add(rows: pa.Table) -> pa.Table:
        sums = (np.minimum(sum(np.frombuffer(b.as_py(), "<u4").astype(np.uint64) for b in rows[c]), 65535).astype("<u2").tobytes() for c in ("every", "open"))
        return pa.table({"page": rows["page"][:1], **{c: pa.array([b], pa.binary()) for c, b in zip(("every", "open"), sums)}})

    sent = in_arrow(compared.select("a", "linked", "diff"), count, "page long, every binary, open binary")
    tables = np.zeros((2, 1 << bits), dtype=np.uint16)
    for page, *found in sent.groupBy("page").applyInArrow(add, "page long, every binary, open binary").collect():  # 2 ** bits counters in all
        for table, counts in zip(tables, found):
            table[page * _PAGE : (page + 1) * _PAGE] = np.frombuffer(counts, "<u2")
    return tables[0], tables[1]


#: Counters in a page of the table, and the least and most bits of its size.
_PAGE, TABLE_BITS = 1 << 13, (14, 22)


def _next_buckets(compared: DataFrame, percent: int) -> DataFrame | None:
    """Buckets that cover the pairs of members of one head that aren't yet decided; None if all are.

    D(x) is what x's set and the head's differ in; x and y differ in D(x) xor D(y). Of a pair one must be open, that is not
    linked to the head, nor by others (`linked` says so); heads without open members are done. U is what two linked
    sets can differ in, so x's link with any y takes |D(x)| - U common tokens, and |D(x)| - U / 2 if D(x) is the smaller; as
    an open y has |D(y)| > U(y, head), one of a linked x with it takes (|D(x)| + 1) / 2 (less where x is larger than the
    head). With o the number that it takes, and one order of the tokens, rare ones first, the first |D(x)| - o + 1 of both
    hold a common one. Only tokens that an open member and another one hold can be common. Near copies, half of whose
    differences are their own, thus share hardly any bucket, however many they are. The order and the choice come from a
    table of counters of fixed size; tokens that meet in one counter only add candidates.
    """
    busy = cut(compared.groupBy("a").agg(F.bool_or(~F.col("linked")).alias("_busy")).filter("_busy").select("a"))
    busy_heads = busy.count()
    if not busy_heads:
        return None
    compared = compared.join(small_or_not(busy), "a", "left_semi")
    tokens = compared.agg(F.sum(F.size("diff"))).first()[0] or 0
    bits = min(max(int(4 * tokens).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
    every, opened = _token_counts(compared, bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids, sizes, index, open_ = [], [], [], [], []
            for a, b, n, m, linked, diff in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                own = diff.values.to_numpy().view(np.uint64)
                slots = _slots(np.full(len(own), a, dtype=np.int64), own, bits)
                use = (every[slots] > 1) & (opened[slots] > 0)
                most = n * (100 - percent) // percent  # U, with a partner of any size that fits
                larger = -(-max(0, n - m) * (100 - percent) // (100 + percent))
                half = max(1, -(-(len(own) + 1 - larger) // 2))  # o(x), where the other is open
                common = 1 if not linked else half
                long = int(use.sum()) - (half if linked else max(1, len(own) - most)) + 1
                short = int(use.sum()) - max(common, len(own) - most // 2) + 1
                if long > 0:
                    at = np.lexsort((own[use], every[slots[use]]))[:long]
                    chosen = mixed(own[use][at] ^ mixed(np.array([a]).view(np.uint64) ^ _FACTORS[2]))
                    key.append(chosen.view(np.int64))
                    for out, value in ((ids, b), (sizes, n), (open_, not linked)):
                        out += [value] * len(at)
                    index += [k < short for k in range(len(at))]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(index, pa.bool_()), pa.array(open_, pa.bool_())], names=["key", "id", "n", "index", "open"])

    picked = in_arrow(compared.select("a", "b", "n", "m", "linked", "diff"), pick, "key long, id long, n long, index boolean, open boolean")
    return picked.distinct().withColumn("sketch", F.lit(None).cast("array<bigint>"))


def near_links(texts: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all linked ids among the representatives of different sets in `sets`: every linked pair is
    listed or joined by a path of listed ones. What is written on the way is deleted."""
    with Scratch(texts.sparkSession) as scratch:
        return _near_links(texts, sets, n, percent, scratch)


def _near_links(texts: DataFrame, sets: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    classes = cut(sets.filter("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    per_size = classes.groupBy("n").agg(F.count(F.lit(1)).alias("sets"))
    by_band = {}
    for size, count in per_size.collect():  # one row for each set size: as many as the longest text has shingles at most
        band = _band(size, percent)
        had = by_band.get(band, (0, 0))
        by_band[band] = (had[0] + count, had[1] + count * size)
    plan = {}
    for shelf, (count, total) in by_band.items():
        if budget := shelf_budget(shelf, percent):
            plan[shelf] = allocation(budget, total / count, count + by_band.get(shelf + 1, (0, 0))[0])
    for shelf in [b - 1 for b in by_band if b - 1 not in by_band]:
        plan.pop(shelf, None)  # no smaller set is on that shelf

    total = 0
    for shelf, (exact, deletion) in plan.items():
        for count, sizes in (by_band[shelf], by_band.get(shelf + 1, (0, 0))):
            total += count * (exact + deletion) + (sizes * deletion // (exact + deletion))
    known = join_groups(sets, classes, ["n", "h1", "h2"], "size", max(1, sets.count())).filter("rep IS NOT NULL")
    twins = known.groupBy("id").agg(F.bool_and(F.col("id") != F.col("rep")).alias("twin")).filter("twin").select("id")  # their representatives stand for them
    texts = texts.filter("id IS NOT NULL")
    indexed = without(texts.select("id", "text"), cut(twins))
    shared, bits = _shared_keys(indexed, n, percent, plan, total)
    entries = scratch.written(_shared_entries(indexed, n, percent, plan, shared, bits).drop("mark"), "entries")
    buckets = scratch.written(_live(entries), "buckets")
    involved = cut(buckets.select("id").distinct())
    sketches = scratch.written(_sketches(likely_among(indexed, involved), n, percent, plan), "sketches")
    repeated = sketches.groupBy("id").count().filter("count > 1").select("id")
    sketches = sketches.join(small_or_not(repeated), "id", "left_anti")  # an id with several sets has no one sketch
    buckets = buckets.join(sketches, "id", "left").withColumn("sketch", F.when(F.col("index"), F.col("low_sketch")).otherwise(F.col("high_sketch"))).drop("low_sketch", "high_sketch")
    buckets = scratch.written(buckets, "buckets")
    links, candidates = _first_links(texts, buckets, n, percent), None
    labels = None if links is None else components(links)
    buckets = _with_components(buckets, labels)
    buckets = scratch.written(buckets if links is None else _apart_still(buckets), "buckets")
    for level in range(LEVELS + 1):
        refined = F.col("size") > (LISTED if level < LEVELS else 1 << 62)
        small = buckets.filter(~refined)
        pairs = _listed(small, small, percent)
        candidates = pairs if candidates is None else candidates.unionByName(pairs)
        large = buckets.filter(refined)
        if not large.limit(1).count():
            break
        # In a large bucket, everyone near the most connected member is compared with it. Those that its sketch tells apart
        # have few partners; these are listed by their sketches.
        score = cut(large.drop("sketch").groupBy("id").agg(F.sum("size").alias("score")))
        scored = large.join(score, "id")
        best = F.max(F.struct("index", "score", (-F.col("id")).alias("minus"), F.col("n").alias("head_n"), F.col("sketch").alias("head_sketch")))
        heads = cut(scored.groupBy("key").agg(best.alias("h"), F.max("size").alias("rows")).select("key", "rows", (-F.col("h.minus")).alias("a"), "h.head_n", "h.head_sketch"))
        headed = join_groups(large, heads, ["key"], "rows", max(1, heads.count()))
        near = F.coalesce(_apart("sketch", "head_sketch") * (100 + percent) <= (F.col("n") + F.col("head_n")) * (100 - percent), F.lit(True))
        headed = scratch.written(headed.withColumn("near", near).drop("head_sketch", "rows"), "headed")
        candidates = candidates.unionByName(_listed(headed.filter("NOT near"), headed, percent))
        grouped = headed.filter("near AND a <> id").select("a", F.col("id").alias("b"))
        compared = scratch.written(compare(texts, grouped, n, percent, differences=True), "compared")
        found = compared.filter("linked").select("a", "b").distinct()
        links = found if links is None else links.unionByName(found)
        of_both = _with_components(_with_components(compared, labels, "b", "_b"), labels, "a", "_a")
        buckets = _next_buckets(of_both.withColumn("linked", F.col("linked") | (F.col("_a") == F.col("_b"))).select(*compared.columns), percent)
        if buckets is None:
            break
        buckets = _apart_still(_with_components(scratch.written(buckets, "picked"), labels))
        buckets = scratch.written(_with_components(_live(scratch.written(buckets.drop("comp"), "buckets")), labels), "buckets")
    found = compare(texts, candidates, n, percent).filter("linked").select("a", "b").distinct()
    return cut(found if links is None else links.unionByName(found).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs: its set's size and the smallest id that links reach from it.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct n-word shingles, or the whole sequence of
    fewer words; null and empty texts have an empty set and are linked with nothing. Two rows are linked when
    100 * |intersection| >= percent * |union|. Rows with one id are one document. Rows with a null id take the component of an
    equal set with an id, else their component is null. Whole texts count, every row is returned, no candidate is dropped.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(_sets(texts, n), "sets")
    links = near_links(texts, sets, n, percent)
    equal = sets.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    equal = cut(equal)
    total = max(1, sets.count())
    rows = join_groups(sets, equal, ["n", "h1", "h2"], "size", total)
    labels = components(links)
    # An id can also hold several sets, whose classes meet in it.
    twice = sets.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.count_distinct("n", "h1", "h2").alias("k")).filter("k > 1").select("id")
    if twice.limit(1).count():
        across = rows.join(twice, "id", "left_semi").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        labels = components(links.unionByName(across).distinct())
    # A representative stands for all rows of its classes: so many meet its label, and are dealt out if they are many.
    held = equal.groupBy("rep").agg(F.sum("size").alias("size2"))
    sizes = cut(labels.withColumnRenamed("node", "rep").join(held, "rep"))
    rows = join_groups(rows.drop("size"), sizes, ["rep"], "size2", total).drop("size2")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of smallest id; all columns stay, and so do rows with a null id."""
    found = jaccard_components(docs, id_col, text_col, n, percent)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return without(docs, cut(gone), id_col)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of three-word shingles and the least id that links of 0.9 reach from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs)


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
