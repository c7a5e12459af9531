"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. Native operators only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bitmap, cut, in_bitmap, join_groups, table_bits

#: Characters of the prefix that the second step hashes.
PREFIX_CHARS = 64


def _narrowed(docs: DataFrame, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text).cast("long")
    prefix = F.xxhash64(F.substring(text, 1, PREFIX_CHARS), length)
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), length.alias("_len"), prefix.alias("_prefix"), *(c.alias(k) for k, c in carry.items()))


def _with_survivors(rows: DataFrame) -> DataFrame:
    """rows with _same_len and _same_prefix: whether another row may have the same length, and the same prefix too. What
    recurs goes to the next scan as a table of bits, sized from the number of keys up to 16 MB."""
    lengths = cut(rows.groupBy("_len").count().filter("count > 1").select("_len"))
    bits = table_bits(lengths.count())
    rows = in_bitmap(rows, "_len", cut(bitmap(lengths, "_len", bits)), bits, "_same_len")
    prefixes = cut(rows.filter("_same_len").groupBy("_len", "_prefix").count().filter("count > 1").select("_prefix"))
    bits = table_bits(prefixes.count())
    return in_bitmap(rows, "_prefix", cut(bitmap(prefixes, "_prefix", bits)), bits, "_same_prefix")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size (rows with that text), kept, and the carried columns.

    Step 1 counts lengths; step 2 counts (length, hash of the first PREFIX_CHARS characters) for rows whose length recurs;
    step 3 computes SHA-256 of the whole text only for rows whose (length, prefix hash) recurs. What survives a step goes to
    the next scan as a table of bits, so no step shuffles texts; a false bit only lets a row into a later step.

    Null text counts as empty. Of equal texts the row with the largest id stays, null ids last; of rows that repeat both id
    and text exactly one is kept. An empty table gives no rows. Columns of docs other than id, text and carry are ignored.
    """
    rows = _with_survivors(_narrowed(docs, id_col, text_col, carry or {}))
    extra = list(carry or {})
    survives = F.col("_same_len") & F.col("_same_prefix")

    full = cut(rows.filter(survives).select("_id", "_len", F.sha2("_text", 256).alias("_full"), F.monotonically_increasing_id().alias("_row"), *extra))
    groups = full.groupBy("_len", "_full").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    total = full.count()
    judged = join_groups(full, groups, ["_len", "_full"], "group_size", total).select(
        F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), "group_size", (F.col("_keep._row") == F.col("_row")).alias("kept"), *extra
    )
    alone = rows.filter(~survives).select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra)
    return judged.unionByName(alone)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay, and rows keep their null ids and texts.

    The rows that survive to the full hash carry their columns through one shuffle by hash; all others pass unshuffled.
    """
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("_all"))
    rows = _narrowed(packed.select("_all", F.col(f"_all.{id_col}").alias("_i"), F.col(f"_all.{text_col}").alias("_t")), "_i", "_t", {"_all": F.col("_all")})
    rows = _with_survivors(rows)
    survives = F.col("_same_len") & F.col("_same_prefix")
    # max_by keeps one row for each text: copies collapse in the tasks that read them, so a hot text moves once for each task.
    best = rows.filter(survives).groupBy("_len", F.sha2("_text", 256).alias("_full")).agg(F.max_by("_all", F.struct("_id", F.xxhash64(F.to_json("_all")))).alias("_all"))
    return best.select("_all.*").unionByName(rows.filter(~survives).select("_all.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, with the digest of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_groups(docs, carry={"text_sha256": digest})


SQL = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
}
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
