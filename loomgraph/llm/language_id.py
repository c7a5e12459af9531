"""Language identification by Bayesian evidence fusion.

Text likelihoods (letter trigrams), the declared language, the address suffix and a host prior are multiplied. All are counted
from the corpus: trigrams by declared language, the rest by the language that the text alone makes likeliest. Host priors are
smoothed towards the domain's, and those towards the whole corpus's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import code_points, cut, in_arrow, join_groups, letter_table, slices

#: Hashed letter trigrams; the model is a table of languages x BUCKETS.
BUCKETS = 1 << 14
#: Rows that declare a language before it is one of the model's, however many others there are; and languages whose counts a
#: task holds, or the driver fetches, at once.
LEAST_ROWS, LANGUAGES_AT_ONCE = 5, 64
#: Letters up to which a text's evidence grows; trigrams of one text depend on each other, so more doesn't count as more.
EVIDENCE_LETTERS = 200
#: Rows of the parent's prior that are added to a host's or a domain's own counts.
PRIOR_ROWS = 20.0
#: Texts whose likeliest language has a lower probability are rejected, and those without letters.
LEAST_CONFIDENCE = 0.5


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each character, whether it counts (a letter in the middle), and the texts' starts."""
    points, starts = code_points(texts)
    low = np.concatenate([[0], letter_table()[points], [0]]).astype(np.uint32)
    mixed = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA6B) ^ low[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64) & (BUCKETS - 1), low[1:-1] != 0, starts


def train_trigrams(docs: DataFrame, text_col: str, declared: Column) -> tuple[list[str], np.ndarray]:
    """The languages, and the log probability of each trigram bucket in each, counted over all rows."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), declared.alias("lang"))
    counted = rows.filter("lang IS NOT NULL").groupBy("lang").count().filter(F.col("count") >= LEAST_ROWS)
    languages = sorted(r[0] for r in counted.collect())
    if not languages:
        return [], np.zeros((0, BUCKETS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(languages)}
        seen: dict[int, np.ndarray] = {}

        def counted() -> pa.RecordBatch:
            cells = [(lang * BUCKETS + np.nonzero(n)[0], n[n > 0]) for lang, n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=pa.int64()) for c in zip(*cells)], names=["cell", "n"])

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([at.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
            for lo, hi in slices(texts):
                bucket, counts, starts = _trigrams(texts[lo:hi])
                lang = np.repeat(langs[lo:hi], np.diff([*starts, len(bucket)]))
                for i in np.unique(langs[lo:hi][langs[lo:hi] >= 0]).tolist():
                    if i not in seen and len(seen) >= LANGUAGES_AT_ONCE:
                        yield counted()
                    n = np.bincount(bucket[counts & (lang == i)], minlength=BUCKETS)
                    seen[i] = seen[i] + n if i in seen else n
        if seen:
            yield counted()

    sums = in_arrow(rows, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = cut(sums) if len(languages) > LANGUAGES_AT_ONCE else sums
    model = np.zeros((len(languages), BUCKETS), dtype=np.float32)
    for lo in range(0, len(languages), LANGUAGES_AT_ONCE):
        hi = min(lo + LANGUAGES_AT_ONCE, len(languages))
        part = sums.filter(F.col("cell").between(lo * BUCKETS, hi * BUCKETS - 1)).toArrow()
        table = np.full((hi - lo) * BUCKETS, 0.5)
        table[part["cell"].to_numpy() - lo * BUCKETS] += part["n"].to_numpy()
        table = table.reshape(hi - lo, BUCKETS)
        model[lo:hi] = np.log(table / table.sum(axis=1, keepdims=True))
    return languages, model


def _with_likelihoods(docs: DataFrame, text_col: str, model: np.ndarray) -> DataFrame:
    """docs with _letters and _ll, the text's log likelihood in each language, scaled to EVIDENCE_LETTERS at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index(text_col)).to_pylist()]
            for lo, hi in slices(texts):
                bucket, counts, starts = _trigrams(texts[lo:hi])
                letters = np.add.reduceat(counts.astype(np.int64), starts)
                scale = np.minimum(letters, EVIDENCE_LETTERS) / np.maximum(letters, 1)
                sums = np.stack([np.add.reduceat(np.where(counts, row[bucket], 0).astype(np.float64), starts) * scale for row in model], axis=1)
                part = batch.slice(lo, hi - lo)
                lists = pa.array(list(sums), type=pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(letters), lists], names=[*part.schema.names, "_letters", "_ll"])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("_letters", T.LongType()), T.StructField("_ll", T.ArrayType(T.DoubleType()))]))


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def identify(
    docs: DataFrame, text_col: str = "text", declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None
) -> DataFrame:
    """docs with lang_id, lang_confidence, lang_letters and lang_kept (columns so named are replaced).

    declared: the declared (markup) language; host, domain (the host's parent) and suffix: the address. Each may be null in a
    row or left out; it is then no evidence, and a row without host has its domain's prior. Rows with no letters, null texts
    too, and rows whose best language has a probability under LEAST_CONFIDENCE get lang_id 'und' and lang_kept false. Whole
    texts count; all rows stay, repeated ones alike. A language is known if LEAST_ROWS rows declare it; with
    none in the table, all rows are 'und'.
    """
    docs = docs.drop("lang_id", "lang_confidence", "lang_letters", "lang_kept")
    none = F.lit(None).cast("string")
    declared, host, domain, suffix = (none if c is None else c.cast("string") for c in (declared, host, domain, suffix))
    languages, model = train_trigrams(docs, text_col, declared)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"), declared.alias("_declared"), host.alias("_host"), domain.alias("_domain"), suffix.alias("_suffix"))
    if not languages:
        return packed.select("_row.*", F.lit("und").alias("lang_id"), F.lit(0.0).alias("lang_confidence"), F.lit(0).cast("long").alias("lang_letters"), F.lit(False).alias("lang_kept"))

    evidence = ["_declared", "_host", "_domain", "_suffix"]
    scored = _with_likelihoods(packed.select("_text", *evidence), "_text", model)
    seen = cut(scored.filter("_letters > 0").groupBy(*evidence, _argmax(F.col("_ll")).alias("_lang")).agg(F.count(F.lit(1)).alias("_n")))
    k = len(languages)
    array = lambda values: F.array(*map(F.lit, values))
    found = {r[0]: r[1] for r in seen.groupBy("_lang").agg(F.sum("_n")).collect()}
    world = [found.get(i, 0) for i in range(k)]
    total = max(1, sum(world))
    base = [(n + 1) / (total + k) for n in world]

    def counts(key: str, *more: Column) -> DataFrame:
        """_size, the rows of each value of key, and _of, these by language."""
        n = seen.filter(F.col(key).isNotNull()).groupBy(key, "_lang").agg(F.sum("_n").alias("_n"), *more)
        again = [F.max(c).alias(c) for c in n.columns[3:]]
        n = n.groupBy(key).agg(F.sum("_n").alias("_size"), F.map_from_entries(F.collect_list(F.struct("_lang", "_n"))).alias("_by"), *again)
        return n.withColumn("_of", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("_by")[i], F.lit(0)))).drop("_by")

    def likelihoods(key: str, out: str) -> DataFrame:
        """log P(value | language) for each value of the evidence, with one more row for each value and one unseen."""
        values = counts(key)
        kinds = values.count() + 1
        return cut(values.select(key, "_size", F.transform("_of", lambda n, i: F.log((n + 1) / (F.get(array(world), i) + kinds))).alias(out)))

    smooth = lambda parent: F.transform("_of", lambda n, i: (n + PRIOR_ROWS * F.get(parent, i)) / (F.col("_size") + PRIOR_ROWS))
    domains = cut(counts("_domain").select("_domain", "_size", smooth(array(base)).alias("_of_domain")))
    hosts = counts("_host", F.max("_domain").alias("_domain"))
    hosts = hosts.join(domains.select("_domain", "_of_domain"), "_domain", "left").withColumn("_of_domain", F.coalesce("_of_domain", array(base)))
    hosts = cut(hosts.select("_host", "_size", smooth(F.col("_of_domain")).alias("_of_host")))

    rows = _with_likelihoods(packed, "_text", model).drop("_text")
    for table, key in ((hosts, "_host"), (domains, "_domain"), (likelihoods("_declared", "_by_declared"), "_declared"), (likelihoods("_suffix", "_by_suffix"), "_suffix")):
        rows = join_groups(rows, table, [key], "_size", total).drop("_size")
    prior = F.coalesce("_of_host", "_of_domain", array(base))
    term = lambda c, i: F.coalesce(F.get(c, i), F.lit(0.0))
    logs = F.transform("_ll", lambda x, i: x + F.log(F.get(prior, i)) + term("_by_declared", i) + term("_by_suffix", i))
    rows = rows.select("_row", "_letters", logs.alias("_log"))
    best = F.array_max("_log")
    confidence = 1 / F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    rows = rows.select("_row", "_letters", _argmax(F.col("_log")).alias("_best"), confidence.alias("_sure"))
    kept = (F.col("_letters") > 0) & (F.col("_sure") >= LEAST_CONFIDENCE)
    name = F.when(kept, F.get(array(languages), F.col("_best"))).otherwise(F.lit("und"))
    return rows.select("_row.*", name.alias("lang_id"), F.col("_sure").alias("lang_confidence"), F.col("_letters").alias("lang_letters"), kept.alias("lang_kept"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """identify() for the columns of documents: lang is declared, source stands for the host. Where a source is an address, its
    parent and its suffix are evidence too."""
    part = lambda pattern: F.nullif(F.lower(F.regexp_extract(F.col("source"), pattern, 1)), F.lit(""))
    return identify(docs, "text", F.col("lang"), F.col("source"), part(r"([^./\s]+\.[^./\s]+)$"), part(r"\.([^./\s]+)$"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, how sure it is, its letters, and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify_documents(docs).select("doc_id", "lang_id", "lang_confidence", "lang_letters", "lang_kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages: the html element's lang attribute, the host, its domain and its last label."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    markup = F.nullif(F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    rows = pages.select("page_id", text.alias("text"), markup.alias("declared"), host.alias("host"))
    domain, suffix = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.regexp_extract("host", r"([^.]+)$", 1)
    return identify(rows, "text", F.col("declared"), F.col("host"), F.nullif(domain, F.lit("")), F.nullif(suffix, F.lit(""))).drop("text", "declared", "host")


QUERIES = {"op1_language_id": op1_language_id, "language_of_pages": language_of_pages}
