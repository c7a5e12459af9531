"""Search by words and by meaning: an inverted index as tables, BM25 by joins, and the fusion of rankings.

A query's best rows are found without scoring all that hold one of its frequent words: rare words are joined first and give a
floor for the k-th best; where the frequent words together can't reach that floor, only rows near it are looked up for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.storage import BROADCAST_ROWS, cut, small_or_not

#: How fast a word's repeats saturate, and how far a text's length counts.
K1, B = 1.2, 0.75
#: A word in more than this share of the texts is frequent.
FREQUENT = 0.02
#: Rows of each ranking that are fused, and what is added to a rank before it is turned over.
FUSED, RANK_OFFSET = 100, 60
#: Digits of a score: sums in another order mustn't change a ranking.
DIGITS = 6


def words(text: Column) -> Column:
    """The words of a text: runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class TextIndex:
    """postings(term, id, tf, length, kind...): a row for each distinct word of each text; terms(term, df, idf); texts and their mean
    length. kinds: the columns by which a search may be narrowed."""

    postings: DataFrame
    terms: DataFrame
    texts: int
    mean: float
    kinds: tuple[str, ...]

    def write(self, path: str) -> None:
        """Stores the index, postings in order of their words, so that a search reads only the files that hold its words."""
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.texts, self.mean, list(self.kinds))], "texts long, mean double, kinds array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextIndex:
        about = spark.read.parquet(f"{path}/about").first()
        return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), about["texts"], about["mean"], tuple(about["kinds"]))


def index(texts: DataFrame, key: str, text: str, kinds: tuple[str, ...] = (), asked: DataFrame | None = None) -> TextIndex:
    """The index of a table of texts, each key once. Null and empty texts hold no word, and count among the texts. asked(term): the
    only words that will be looked up; postings of others aren't made, whatever else is the same."""
    kept = [F.col(k) for k in kinds]
    split = texts.select(F.col(key).alias("id"), words(F.col(text)).alias("_w"), *kept)
    sizes = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_w")).alias("mean")).first()
    each = split.select("id", F.size("_w").alias("length"), F.explode("_w").alias("term"), *kept)
    if asked is not None:
        each = each.join(small_or_not(asked.select("term").distinct()), "term", "left_semi")
    postings = cut(each.groupBy("term", "id", "length", *kinds).agg(F.count(F.lit(1)).alias("tf")))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(sizes["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return TextIndex(postings, cut(df.select("term", "df", idf.alias("idf"))), sizes["n"], sizes["mean"] or 0.0, tuple(kinds))


def _gain(mean: float) -> Column:
    """What a word adds to the score of a text that holds it."""
    norm = K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0))
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)


def bm25(queries: DataFrame, on: TextIndex, k: int = 10, query_id: str = "query_id", text: str = "text", only: dict[str, str] | None = None, frequent: float = FREQUENT) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of each query by BM25, ties by id; every distinct word of a query counts once.

    only: kind -> the column of queries that lists what it may be (null: anything); postings are narrowed before they are scored. Null
    ids and queries without a word that the index knows have no rows. Exact: a query whose frequent words might lift a text that
    holds none of its rare ones is scored in full.
    """
    only = only or {}
    asked = queries.select(F.col(query_id).alias("_q"), F.array_distinct(words(F.col(text))).alias("_w"), *[F.col(c).alias(f"_only_{kind}") for kind, c in only.items()]).filter("_q IS NOT NULL")
    limits = [f"_only_{kind}" for kind in only]
    terms = cut(asked.select("_q", F.explode("_w").alias("term"), *limits).distinct().join(on.terms, "term"))
    common = F.col("df") > F.lit(frequent * on.texts)

    def scored(some: DataFrame) -> DataFrame:
        rows = on.postings.join(small_or_not(some), "term")
        for kind in only:
            rows = rows.filter(F.col(f"_only_{kind}").isNull() | F.array_contains(f"_only_{kind}", F.col(kind)))
        return rows.withColumn("_gain", _gain(on.mean))

    # What the frequent words of a query can add at most, whatever the text.
    most = terms.groupBy("_q").agg(F.sum(F.when(common, F.col("idf") * (K1 + 1)).otherwise(0.0)).alias("_most"))
    rare = cut(scored(terms.filter(~common)).groupBy("_q", "id").agg(F.sum("_gain").alias("_part")))
    placed = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("_part").desc(), "id"))
    floors = rare.withColumn("_k", placed).filter(F.col("_k") <= k).groupBy("_q").agg(F.min("_part").alias("_floor"), F.count(F.lit(1)).alias("_n"))
    slack = 10.0**-DIGITS  # scores are rounded
    state = most.join(floors, "_q", "left").withColumn("_closed", F.coalesce((F.col("_n") >= k) & (F.col("_most") + slack < F.col("_floor")), F.lit(False)))
    state = cut(state.select("_q", "_most", "_floor", "_closed"))
    near = rare.join(small_or_not(state.filter("_closed")), "_q").filter(F.col("_part") + F.col("_most") + slack >= F.col("_floor"))
    near = cut(near.select("_q", "id", "_part"))
    frequent_terms = terms.filter(common).join(state.filter("_closed").select("_q"), "_q", "left_semi")
    lifted = scored(frequent_terms.join(near.select("_q").distinct(), "_q", "left_semi")).join(near.select("_q", "id"), ["_q", "id"], "left_semi").select("_q", "id", F.col("_gain").alias("_part"))
    whole = scored(terms.join(state.filter("NOT _closed").select("_q"), "_q", "left_semi")).select("_q", "id", F.col("_gain").alias("_part"))
    sums = near.unionByName(lifted).unionByName(whole).groupBy("_q", "id").agg(F.round(F.sum("_part"), DIGITS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), "id"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("_q").alias(query_id), "id", "score", "rank")


def words_asked(queries: DataFrame, text: str = "text") -> DataFrame:
    """(term): the distinct words of the queries."""
    return cut(queries.select(F.explode(words(F.col(text))).alias("term")).distinct())


def _alike(texts: DataFrame, asked: DataFrame, key: str, text: str, kinds: tuple[str, ...], k: int) -> DataFrame:
    """(kinds, length, held, n, ids): texts that every query scores alike, their number and their k least keys. held: which of the
    asked words they hold, and how often. Each batch is reduced in its task, so no more than its kinds of texts are shuffled."""
    import numpy as np
    import pyarrow as pa

    every = asked.agg(F.collect_list("term").alias("_terms"))
    rows = texts.select(F.col(key).cast("long").alias("id"), *kinds, words(F.col(text)).alias("_w")).crossJoin(F.broadcast(every))
    often = lambda t: F.struct(t.alias("term"), F.size(F.filter("_w", lambda w: w == t)).cast("long").alias("tf"))
    rows = rows.select("id", *kinds, F.size("_w").alias("length"), F.transform(F.array_sort(F.array_intersect("_w", "_terms")), often).alias("held"))
    same = ["length", "held", *kinds]
    rows = rows.select(F.xxhash64(*same).alias("_h"), "id", *same)

    def reduced(batches):
        for batch in batches:
            h, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            least = np.minimum(n, k)
            at = np.repeat(first, least) + np.arange(least.sum()) - np.repeat(np.cumsum(least) - least, least)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(least)).astype(np.int32)), pa.array(ids[at]))
            kept = batch.take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays([*kept.columns[2:], pa.array(n), lists], names=[*kept.schema.names[2:], "n", "ids"])

    schema = T.StructType([*rows.select(*same).schema.fields, T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])
    grouped = rows.mapInArrow(reduced, schema).groupBy(*same).agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"))
    return cut(grouped.withColumn("ids", F.slice(F.array_sort("ids"), 1, k)).withColumn("_c", F.monotonically_increasing_id()))


def bm25_alike(queries: DataFrame, texts: DataFrame, key: str, k: int = 10, query_id: str = "query_id", text: str = "text", only: dict[str, str] | None = None) -> DataFrame:
    """bm25() over texts(key, text and the kinds of only) without an index, for many short texts of few words: those that hold the
    same asked words as often and are equally long score alike, so one of each is scored and the least keys stand for it. Keys are
    whole numbers, each once. The asked words are broadcast; more than BROADCAST_ROWS of them are looked up by an index."""
    only = only or {}
    kinds = tuple(only)
    wanted = words_asked(queries.filter(F.col(query_id).isNotNull()), text)
    if wanted.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return bm25(queries, index(texts, key, text, kinds, wanted), k, query_id, text, only)
    alike = _alike(texts, wanted, key, text, kinds, k)
    sizes = alike.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("mean")).first()
    held = alike.select("_c", "n", "length", *kinds, F.inline("held"))
    df = held.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(sizes["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    limits = [F.col(c).alias(f"_only_{kind}") for kind, c in only.items()]
    asked = queries.select(F.col(query_id).alias("_q"), F.explode(words(F.col(text))).alias("term"), *limits).filter("_q IS NOT NULL").distinct()
    rows = held.join(small_or_not(cut(asked.join(df.select("term", idf.alias("idf")), "term"))), "term")
    for kind in kinds:
        rows = rows.filter(F.col(f"_only_{kind}").isNull() | F.array_contains(f"_only_{kind}", F.col(kind)))
    sums = rows.groupBy("_q", "_c", "n").agg(F.round(F.sum(_gain(sizes["mean"] or 0.0)), DIGITS).alias("score"))
    # Texts with a higher score than these: where there are k, none of these is among the best.
    above = F.sum("n").over(Window.partitionBy("_q").orderBy(F.col("score").desc())) - F.sum("n").over(Window.partitionBy("_q", "score"))
    best = sums.withColumn("_above", above).filter(F.col("_above") < k).join(alike.select("_c", F.explode("ids").alias("id")), "_c")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("_q").alias(query_id), "id", "score", "rank")


def fused(rankings: list[DataFrame], k: int = 10, query_id: str = "query_id", offset: int = RANK_OFFSET) -> DataFrame:
    """(query_id, id, score, rank) by reciprocal rank: each ranking (query_id, id, rank) gives 1 / (offset + rank); ties by id."""
    both = None
    for r in rankings:
        one = r.select(query_id, "id", (1.0 / (F.lit(offset) + F.col("rank"))).alias("_s"))
        both = one if both is None else both.unionByName(one)
    sums = both.groupBy(query_id, "id").agg(F.round(F.sum("_s"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc(), "id"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= k)


def hybrid(
    queries: DataFrame, on: TextIndex, vectors: DataFrame, k: int = 10, query_id: str = "query_id", text: str = "text", embedding: str = "embedding", key: str = "id", most: int = FUSED, kinds: dict[str, list[str]] | None = None
) -> DataFrame:
    """The k best rows of each query by words and by vector: the first `most` of either ranking, fused. vectors(key, embedding and
    the kinds) has the rows' vectors; a row without one, and a query without one, is ranked by words alone. kinds: what a row's
    kind may be, for all queries; both searches are narrowed before they rank."""
    from loomgraph.operators.search import joined_top_k

    for kind, allowed in (kinds or {}).items():
        queries = queries.withColumn(f"_{kind}", F.array(*map(F.lit, allowed)))
        vectors = vectors.filter(F.col(kind).isin(*allowed))
    by_words = bm25(queries, on, most, query_id, text, {kind: f"_{kind}" for kind in kinds or {}})
    near = joined_top_k(queries, vectors, most, query_id, key, embedding).withColumnRenamed(key, "id")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("sim").desc(), "id"))
    return fused([by_words, near.withColumn("rank", rank)], k, query_id)
