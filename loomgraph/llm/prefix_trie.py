"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns. It belongs to its smallest member, so a conversation owns the end of its path,
from some depth on: one number for each conversation tells all its nodes. What a subtree saves is then a sum over members:
the bytes of a member's turns below the node, as far as it doesn't own them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, cut, in_arrow, join_groups, small_or_not

#: Turns that a window sums up at once; a longer conversation's parts carry on from each other.
PART = 512
#: Member ids in a piece of text that is hashed at once.
LISTED = 10_000
#: A rebuilt conversation has up to HEADS - 1 first turns of its family's first one; FAMILY ids are a family.
HEADS, FAMILY = 9, 5
_KEY = ["d", "x1", "x2"]


def _numbered(turns: DataFrame) -> DataFrame:
    """(c, t1, t2, bytes, g): the rows in order of conversation, turn (null first), role and text, numbered by ranges: no
    conversation, however long, is one task's."""
    t = turns.select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").alias("n"),
        F.coalesce("role", F.lit("")).alias("r"),
        F.coalesce("text", F.lit("")).alias("t"),
    ).filter("c IS NOT NULL")
    # Rows that are equal in all of these are one another's like: any order of them gives the same.
    order = ["c", F.asc_nulls_first("n"), "r", "t", "i"]
    t = t.withColumn("i", F.monotonically_increasing_id())
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t = t.select("c", F.xxhash64("r", "t").alias("t1"), F.xxhash64("t", "r", F.lit(1)).alias("t2"), F.octet_length("t").cast("long").alias("bytes"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    t = cut(t.withColumn("_part", F.spark_partition_id()).withColumn("_place", place))
    before, rows = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in t.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a task
        before.append((part, rows))
        rows += n
    starts = t.sparkSession.createDataFrame(before, "_part int, _before long")
    return t.join(F.broadcast(starts), "_part").select("c", "t1", "t2", "bytes", (F.col("_before") + F.col("_place")).alias("g"))


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (c, pos, t1, t2, bytes, n) with their places in the conversation, and the conversations (c, n). t1 and t2 are the
    turn's hashes. Null roles and texts become empty; turns with one number are ordered by role and text; rows without a
    conversation are left out."""
    rows = _numbered(turns)
    convs = cut(rows.groupBy("c").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")))
    total = convs.agg(F.sum("n")).first()[0] or 0
    placed = join_groups(rows, convs, ["c"], "n", total)
    return placed.select("c", (F.col("g") - F.col("first")).alias("pos"), "t1", "t2", "bytes", "n"), convs.select("c", "n")


def rebuilt(turns: DataFrame, convs: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (c, p, t1, t2, bytes) and the conversations (c, length).

    With h = crc32(decimal c) % 9, conversation c has the first h turns of the conversation c - c % 5 (all if it has fewer, none if
    there is none), then its own after its first h.
    """
    h = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(HEADS))
    convs = convs.select("c", "n", h.alias("h"), (F.col("c") - F.pmod("c", F.lit(FAMILY))).alias("s"))
    heads_of = convs.select(F.col("c").alias("s"), F.col("n").alias("_there"))
    convs = convs.join(small_or_not(heads_of), "s", "left").withColumn("m", F.least("h", F.coalesce("_there", F.lit(0))))
    convs = cut(convs.select("c", "s", "n", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = join_groups(turns.drop("n"), convs.select("c", "h", "m", "n"), ["c"], "n", total).filter("pos >= h")
    own = own.select("c", (F.col("m") + F.col("pos") - F.col("h")).alias("p"), "t1", "t2", "bytes")
    heads = turns.filter(F.col("pos") < HEADS - 1).filter(F.pmod("c", F.lit(FAMILY)) == 0).select(F.col("c").alias("s"), F.col("pos").alias("p"), "t1", "t2", "bytes")
    # A family has FAMILY members and HEADS - 1 first turns at most.
    taken = heads.join(small_or_not(convs.filter("m > 0").select("s", "c", "m")), "s").filter("p < m").select("c", "p", "t1", "t2", "bytes")
    return own.unionByName(taken), convs.select("c", "length")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth (c, d, x1, x2, y1, y2, before, bytes, length): the hash of its first d turns, that of
    the first d - 1, the bytes of the texts before the last one and of the last. Depth 0 is the root.

    A prefix's hash is the exclusive or of its turns' hashes, each mixed with its place, in 128 bits; so a conversation's parts
    are summed apart and carried on.
    """
    part = F.expr(f"p div {PART}")
    t = turns.withColumn("h1", F.xxhash64("p", "t1", "t2")).withColumn("h2", F.xxhash64("t2", "p", "t1")).withColumn("part", part).drop("t1", "t2")
    of_part = Window.partitionBy("c", "part").orderBy("p")
    t = t.select("c", "p", "part", "h1", "h2", "bytes", F.bit_xor("h1").over(of_part).alias("x1"), F.bit_xor("h2").over(of_part).alias("x2"), F.sum("bytes").over(of_part).alias("upto"))
    # Only conversations of several parts have something to carry on: the ends of their full parts.
    ends = t.filter(F.col("p") % PART == PART - 1).select("c", (F.col("part") + 1).alias("part"), "x1", "x2", "upto")
    so_far = Window.partitionBy("c").orderBy("part")
    carried = ends.select("c", "part", *[F.bit_xor(k).over(so_far).alias(f"c{k}") for k in ("x1", "x2")], F.sum("upto").over(so_far).alias("cupto"))
    t = t.join(small_or_not(carried), ["c", "part"], "left")
    x = lambda k: F.col(k).bitwiseXOR(F.coalesce(f"c{k}", F.lit(0)))
    t = t.select("c", (F.col("p") + 1).alias("d"), x("x1").alias("x1"), x("x2").alias("x2"), "h1", "h2", (F.col("upto") + F.coalesce("cupto", F.lit(0)) - F.col("bytes")).alias("before"), "bytes")
    zero = F.lit(0).cast("long")
    roots = convs.select("c", *[zero.alias(k) for k in ("d", "x1", "x2", "h1", "h2", "before", "bytes")])
    t = t.unionByName(roots)
    return t.select("c", "d", "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("y1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("y2"), "before", "bytes")


def _digests(ends: DataFrame) -> DataFrame:
    """(d, x1, x2, sha) for the nodes at which conversations (c) end: the SHA-256 of their ids, ascending and joined by commas. The ids
    are put in order by ranges and written out in pieces of LISTED; a node's digest is then taken piece by piece."""
    order = [*_KEY, "c"]
    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_piece", F.floor(place / LISTED))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = dealt.groupBy(*_KEY, "_part", "_piece").agg(listed.alias("_ids"))
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "_part", "_piece").select(*_KEY, "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([k]) for k in (*key, digest.hexdigest())], names=[*_KEY, "sha"])

    return in_arrow(pieces, run, "d long, x1 long, x2 long, sha string")


def trie(turns: DataFrame, convs: DataFrame, total: int) -> DataFrame:
    """The nodes of conversations given by their turns (c, p, t1, t2, bytes) and lengths (c, length), total turns in all.

    conv_id (the smallest member, which owns the node) and depth are a node's key; further parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (summed over its subtree:
    one less than the node's members times the bytes of its last text) and ends_sha256 (members that end there). No conversations
    make no nodes.
    """
    with Scratch(convs.sparkSession) as scratch:
        rows = scratch.written(paths(turns, convs).join(small_or_not(convs), "c"), "trie-paths")
        last = rows.filter("d = length").select("c", *_KEY, (F.col("before") + F.col("bytes")).alias("whole"))
        first = lambda *names: [F.first(k).alias(k) for k in names]
        nodes = rows.groupBy(*_KEY).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == F.col("length")).alias("ends"), *first("y1", "y2", "before"))
        nodes = scratch.written(nodes, "trie-nodes")
        # Each owner's first node k: its key, its parent's, the bytes before it; and whether its last one is childless.
        at_first = lambda *names: [F.min_by(k, "d").alias(k) for k in names]
        owned = nodes.groupBy("c").agg(F.min("d").alias("k"), *at_first("x1", "x2", "y1", "y2", "before"), F.max((F.col("n") == F.col("ends")).cast("int")).alias("leaf"))
        owned = cut(owned)
        attributes = convs.join(last.select("c", "whole"), "c").join(owned.select("c", "k", "before", "leaf"), "c", "left")
        # What a conversation doesn't own is its path before k, all of it if it owns nothing.
        attributes = attributes.select("c", "length", "k", F.coalesce("before", "whole").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("length") + 1).alias("_size"))
        every = total + convs.count()
        wide = join_groups(rows.drop("length", "y1", "y2", "bytes"), attributes, ["c"], "_size", every)
        saved = F.when(F.col("k").isNull() | (F.col("d") < F.col("k")), F.col("shared") - F.col("before")).otherwise(F.lit(0))
        child = (F.coalesce(F.col("k") <= F.col("d") + 1, F.lit(False)) & (F.col("d") < F.col("length"))).cast("long")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        members = wide.select(*_KEY, "c", saved.alias("saved"), child.alias("child"), F.col("leaf").cast("long").alias("leaf"), none("long", "parent"), none("string", "sha"))
        # The parent of an owner's first node belongs to another: a node of several members.
        above = nodes.filter("n > 1").select((F.col("d") + 1).alias("d"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("c").alias("parent"), "n")
        firsts = owned.filter("k > 0").select(F.col("k").alias("d"), "x1", "x2", "y1", "y2")
        parents = join_groups(firsts, above, ["d", "y1", "y2"], "n", every)
        no_member = [none("long", k) for k in ("c", "saved", "child", "leaf")]
        parents = parents.select(*_KEY, *no_member, "parent", none("string", "sha"))
        digests = _digests(last).select(*_KEY, *no_member, none("long", "parent"), "sha")
        out = members.unionByName(parents).unionByName(digests).groupBy(*_KEY).agg(
            F.min("c").alias("conv_id"), F.count("c").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
            F.max("parent").alias("parent"), F.max("sha").alias("sha"),
        )
        parent = F.when(F.col("d") > 0, F.coalesce("parent", "conv_id"))
        nobody = F.lit(hashlib.sha256(b"").hexdigest())
        return cut(out.select("conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", nobody).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """trie() of a table (conv_id, turn, role, text), of the rebuilt conversations unless rebuild is false.

    Turns are ordered by turn (null first), then role and text; null roles and texts become empty; repeated rows are turns of their
    own; rows with a null conv_id are left out; further columns aren't read. An empty table gives no rows.
    """
    turns, convs = ordered(conversations)
    total = convs.agg(F.sum("n")).first()[0] or 0
    if rebuild:
        turns, lengths = rebuilt(turns, convs, total)
        total = lengths.agg(F.sum("length")).first()[0] or 0
    else:
        turns, lengths = turns.select("c", F.col("pos").alias("p"), "t1", "t2", "bytes"), convs.select("c", F.col("n").alias("length"))
    return trie(turns, lengths, total)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

#: CRC-32 of the decimal ids by its table of 256 entries, whole paths as node keys, and every node's ancestors as its prefixes.
SQL = {
    "op13_prefix_trie": """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc(c, k, v) AS (
  SELECT DISTINCT conv_id, 0, CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c, crc.k + 1, xor(bits.v, crc.v >> 8) FROM crc JOIN bits ON bits.k = 8 AND bits.i = (xor(crc.v, ascii(substr(CAST(c AS VARCHAR), crc.k + 1, 1))) & 255)
  WHERE crc.k < length(CAST(c AS VARCHAR))
), heads AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE k = length(CAST(c AS VARCHAR))),
said AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), whole AS (
  SELECT said.c, coalesce(s.turns[1:h], []) || coalesce(said.turns[h + 1:], []) AS turns
  FROM said JOIN heads ON heads.c = said.c LEFT JOIN said s ON s.c = said.c - said.c % 5
), member AS (SELECT c, d, turns[1:d] AS node, len(turns) = d AS last FROM whole, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(node[d].t) END AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends
  FROM member GROUP BY node, d
), family AS (SELECT a.node, count(b.node) AS children FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND b.node[1:a.d] = a.node GROUP BY a.node),
below AS (
  SELECT node[1:k] AS node, CAST(sum(saved) AS BIGINT) AS saved, count(*) FILTER (WHERE children = 0) AS leaves
  FROM (SELECT nodes.node, saved, children, unnest(range(d + 1)) AS k FROM nodes JOIN family ON family.node = nodes.node) GROUP BY 1
)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, family.children AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN family ON family.node = a.node JOIN below ON below.node = a.node LEFT JOIN nodes p ON p.d = a.d - 1 AND p.node = a.node[1:a.d - 1]
"""
}
