"""Result rows as text, a line or more for each row, in the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.expressions import date_text

# The words of the lines below, "Profile of", "RANKED RESULT --", "Supporting fact:", "Segment average" and their like,
# are what readers of these lines look for. Columns that are no part of a line of columns:
_SKIPPED = ("facts", "facts_a", "facts_b", "valid_ats", "pairs", "position")


def row_lines(columns: list[str], types: dict[str, str]) -> Column:
    """The text of one row. The first of these shapes that a row has decides: profile, ranked value, attribute, segment
    average, fact, facts, facts of two sides, anything else."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("string")
    s = lambda n: c(n).cast("string")
    who = F.coalesce(c("subject_name"), F.lit("?"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    dated = lambda at: F.coalesce(said(" (as of ", at, ")"), F.lit(""))
    at = dated(date_text(F.col("valid_at"))) if "valid_at" in columns else F.lit("")
    support = F.coalesce(said("\n  Supporting fact: ", F.nullif(c("fact"), F.lit("")), at), F.lit(""))
    scope = F.coalesce(said(" among ", c("graph_segment")), F.lit(" across all compared"))

    def best(key: str, word: str) -> Column:
        metric = F.coalesce(F.nullif(c("object_name"), F.lit("")), F.lit("the requested metric"))
        return said("RANKED RESULT -- ", who, f" has the {word} ", metric, scope, ", at ", s(key), ".", support)

    average = F.coalesce(said("\n  Segment average (", F.coalesce(c("segment_name"), F.lit("peer group")), ", ", F.coalesce(s("peer_count"), F.lit("0")), " others): ", s("segment_average")), F.lit("\n  No segment average is available."))
    prefix = F.when(c("subject_name").isNull() | F.startswith(F.lower(c("fact")), F.lower(c("subject_name"))), F.lit("")).otherwise(said("[", c("subject_name"), "] "))
    plain = [n for n in columns if n not in _SKIPPED and not types[n].startswith(("array", "struct", "map"))]
    header = F.concat_ws(" | ", *[said(f"{n}=", F.col(n).cast("string")) for n in plain])
    bullets = lambda n, mark: F.coalesce(F.array_join(F.transform(F.filter(F.col(n), lambda f: f.isNotNull() & (f != "")), lambda f: F.concat(F.lit(f"\n  {mark} "), f)), ""), F.lit("")) if n in columns else F.lit("")
    out = header
    if "facts_a" in columns or "facts_b" in columns:
        sides = F.concat(bullets("facts_a", "[a]"), bullets("facts_b", "[b]"))
        out = F.when(sides != "", F.concat(header, sides)).otherwise(out)
    if "facts" in columns:
        out = F.when(F.size("facts") > 0, F.concat(header, F.lit(" ("), F.size("facts").cast("string"), F.lit(" facts)"), bullets("facts", "-"))).otherwise(out)
    out = F.when(F.coalesce(c("fact"), F.lit("")) != "", said(prefix, c("fact"), at)).otherwise(out)
    if "segment_average" in columns:
        out = F.when(F.col("segment_name").isNotNull() if "segment_name" in columns else F.col("segment_average").isNotNull(), said(F.coalesce(c("fact"), said(who, "'s value is ", s("value"))), average)).otherwise(out)
    out = F.when(c("attribute").isNotNull() & c("value").isNotNull(), said(who, "'s ", c("attribute"), " is ", s("value"))).otherwise(out)
    for key, word in (("min_value", "LOWEST"), ("max_value", "HIGHEST")):
        if key in columns:
            out = F.when(F.col(key).isNotNull(), best(key, word)).otherwise(out)
    return F.when(F.coalesce(c("profile"), F.lit("")) != "", said("Profile of ", who, ": ", c("profile"))).otherwise(out)


def with_lines(rows: DataFrame, position: str) -> DataFrame:
    """rows with line, the text of each, numbered by position."""
    types = dict(rows.dtypes)
    number = F.row_number().over(Window.orderBy(position))
    return rows.withColumn("line", F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), row_lines([c for c in rows.columns if c != position], types)))


def hop_text(rows: DataFrame, position: str) -> str:
    """The text of the few rows of an answer."""
    return "\n".join(r["line"] for r in with_lines(rows, position).orderBy(position).select("line").collect())
