"""Scalar functions as native column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.graph import VALUES

# Patterns that decide which facts and numbers count.
FACT_NUMBER = r"(?<!\d)(-?\d[\d,]*\.?\d*)\s*%"
GROWTH_FACT = r"(?i)\bgrowth\b|\bgrew\b|\brose\b|\bincreased?\b|\bdeclined?\b|\bfell\b|\bup\s+[\d.]+\s*%|\bdown\s+[\d.]+\s*%|\byear[- ]on[- ]year\b|\byoy\b|\bY/Y\b"
WANTS_GROWTH = r"(?i)\bgrowth\b|\bgrew\b|\bfastest\b|\bincrease\b|\byear[- ]on[- ]year\b"
ASKS_LOWEST = r"(?i)\blowest\b|\bminimum\b|\bsmallest\b|\bweakest\b"
ASKS_ACROSS = r"(?i)\bwhich\b(?:\s+\w+){0,3}\s+(?:bank|banks|company|companies)\b"
TEXT_NUMBER = r"(\d[\d,]*(?:\.\d+)?%?)"
GLUED_NUMBER = r"[A-Za-z]\d[\d,]*(?:\.\d+)?%?"
KEYWORD = r"([a-z][a-z\-]{3,})"
SOURCE_GROWTH = r"(?i)(deposits?|advances|loan book)[^.]{0,80}?up\s+([\d.]+)\s*%|(deposits?|advances)\s+([\d.]+)\s*%"
DATE_WORD = r"(?i)\b(date|dated|period)\b"
#: Fixed values, for equal results: phrases by which a summary admits that something is missing.
GAP_PHRASES = [
    "not cover", "do not contain", "does not contain", "not disclos",
    "not available", "not found", "not provide", "not specified", "not confirmed",
    "no data", "not reported", "not mention", "not identify", "cannot be determined",
    "cannot be made", "fails to", "unable to", "not include", "not state", "not indicate",
    "insufficient", "not address", "lacks the", "lack the", "not determined", "does not detail",
    "not detail", "no information", "not clear from", "not explicitly", "genuinely unclear",
    "was not found", "were not found", "not verified", "could not be confirmed",
]
#: Fixed values, for equal results: what marks a question as one of judgement, and one about attributes.
ANALYTICAL = (
    r"(?i)\b(competitive advantage|key strength|main (?:weakness|vulnerability)|primary (?:weakness|strength|advantage)|opportunit(?:y|ies)|"
    r"\bthreats?\b|valuation[- ]relevant|risk driver)\b"
)
ATTRIBUTE_STYLE = r"(?i)\bticker\b|\bexchange(?:s)?\b|\blegal name\b|\blisted\b|\bheadquarter|\bincorporated\b|\bfounded\b|\bfounding\b|\bstock symbol\b"
#: Fixed values, for equal results: bookkeeping properties that an attribute lookup leaves out.
BOOKKEEPING = ["uuid", "name", "name_embedding", "group_id", "created_at", "summary", "labels"]
#: A percentage can't be larger.
LARGEST_PERCENTAGE = 100


def screaming_snake(name: Column) -> Column:
    """PascalCase as SCREAMING_SNAKE_CASE; null for names that are in another case already."""
    return F.when(name.rlike("[a-z]") & ~name.contains("_"), F.upper(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_")))


def casing_variants(names: Column) -> Column:
    """The names, each once, followed by those of their other casings that aren't among them."""
    return F.array_distinct(F.concat(names, F.filter(F.transform(names, screaming_snake), lambda x: x.isNotNull())))


def number_from_fact(fact: Column) -> Column:
    """The first number before a per cent sign, without its thousands separators."""
    return F.nullif(F.replace(F.regexp_extract(fact, FACT_NUMBER, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def usable_value(raw: Column, fact: Column) -> Column:
    """raw, unless it is missing or too large for a percentage; then what the fact says."""
    return F.when(raw.isNull() | (F.abs(raw) > LARGEST_PERCENTAGE), number_from_fact(fact)).otherwise(raw)


def segment_of(company: Column, tag: Column, real: Iterable[str], known: dict[str, str]) -> Column:
    """The tag if it is a real segment, else the company's entry in a static table."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    return F.when(tag.isin(*real), tag).otherwise(F.try_element_at(table, company) if table is not None else F.lit(None))


def is_growth(fact: Column) -> Column:
    return F.coalesce(fact.rlike(GROWTH_FACT), F.lit(False))


def value_of(columns: list[str], default: float | None = None) -> Column:
    """The first numeric property that isn't null."""
    found = [F.col(v) for v in VALUES if v in columns]
    return F.coalesce(*found, F.lit(default).cast("double"))


def name_contains(a: Column, b: Column, ratio: bool = False) -> Column:
    """Either lower-cased name contains the other; with ratio also b without ' ratio'."""
    a, b = F.lower(a), F.lower(b)
    either = a.contains(b) | b.contains(a)
    return either | a.contains(F.replace(b, F.lit(" ratio"), F.lit(""))) if ratio else either


def specific_label(labels: Column) -> Column:
    return F.get(F.filter(labels, lambda x: x != "Entity"), F.lit(0))


def has_label(labels: Column, kind: Column, wanted: str) -> Column:
    """Whether a label or the bucketed type is `wanted`, in any case."""
    return F.array_contains(F.transform(labels, lambda x: F.upper(x)), wanted.upper()) | (F.upper(kind) == wanted.upper())


def six_digits(v: Column) -> Column:
    """A number with six significant digits and no trailing zeros; scientific from a million and below 0.0001. The double itself
    is rounded, as it is in binary, and exact halves go to the even digit."""
    form = lambda x: F.call_function("format_number", x, F.lit("0.#####E00"))
    said = F.when(v.between(1e6, 1e19), form(v.cast("decimal(30,10)"))).otherwise(form(v))  # whole halves of large doubles aren't seen as such
    mantissa, power = F.split_part(said, F.lit("E"), F.lit(1)), F.split_part(said, F.lit("E"), F.lit(2))
    e = power.cast("int")
    plain = F.regexp_replace(F.regexp_replace(said.try_cast("decimal(20,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(mantissa, F.when(e < 0, F.lit("e")).otherwise(F.lit("e+")), power)
    return F.when(v == 0, F.lit("0")).when(v == float("inf"), F.lit("inf")).when((e < -4) | (e >= 6), scientific).otherwise(plain)


def extract_numbers(text: Column) -> Column:
    """The distinct numbers of a text that matter: not glued to letters, and if below ten then not whole, or a percentage. What is
    glued to a letter goes as a whole, with its thousands and decimals, so no part of it is left as a number."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), GLUED_NUMBER, "A"), F.lit(TEXT_NUMBER), F.lit(1))
    as_number = lambda x: F.regexp_replace(x, "[,%]", "").cast("double")
    kept = F.filter(found, lambda x: x.endswith("%") | (as_number(x) >= 10) | (as_number(x) != F.floor(as_number(x))))
    return F.array_distinct(F.transform(kept, lambda x: six_digits(as_number(x))))


def quoted_pattern(literal: str) -> str:
    """A Java pattern that matches the literal, whatever it holds."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def mask_terms(text: Column, terms: list[str], with_: str = " ") -> Column:
    """text without the terms, longest first, in any case; white space collapsed."""
    quoted = [quoted_pattern(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t))]
    out = F.regexp_replace(text, "(?iu)" + "|".join(quoted), with_) if quoted else text
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def mask_types(text: Column, entities: list[tuple[str, str]]) -> Column:
    """text in which each (name, type) is replaced by <TYPE>, longest names first."""
    for name, kind in sorted({e for e in entities if e[0]}, key=lambda e: (-len(e[0]), e[0])):
        text = F.regexp_replace(text, rf"(?iu)(?<!\w){quoted_pattern(name)}(?!\w)", f"<{kind}>")
    return text


def date_text(at: Column) -> Column:
    """A date where the timestamp is a midnight; others are bookkeeping and give null."""
    return F.when(F.date_trunc("day", at) == at, F.date_format(at, "yyyy-MM-dd"))


def keywords(text: Column, stop: Iterable[str] = ()) -> Column:
    """Distinct lower-case words of four letters or more."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if list(stop) else found


def threshold(text: Column) -> Column:
    """The first number of a question; 0.5 for 'half'."""
    number = F.regexp_extract(text, r"\b(\d+(?:\.\d+)?)\s*%?", 1)
    return F.when(number != "", number.cast("double")).when(F.lower(text).contains("half"), F.lit(0.5))


def growth_amount(text: Column) -> Column:
    """The first percentage by which a text says that deposits, advances or the loan book grew."""
    group = lambda k: F.nullif(F.regexp_extract(text, SOURCE_GROWTH, k), F.lit(""))
    return F.coalesce(group(2), group(4)).try_cast("double")


def name_variants(name: Column) -> Column:
    """A name, and behind it the name without article and legal suffix where that has three letters and two words."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\s+(?:limited|ltd\.?|pvt\.?\s*ltd\.?)\s*$", ""), r"(?i)^\s*the\s+", "")
    distinctive = (bare != name) & (F.length(bare) >= 3) & (F.size(F.split(F.trim(bare), r"\s+")) >= 2)
    return F.when(distinctive, F.array(name, bare)).otherwise(F.array(name))


def outcome(label: Column, rows: Column, recall: Column, hit: float = 0.99) -> Column:
    """Which stage a failed answer is due to."""
    return (
        F.when(label == "Relevant", "answered").when(F.coalesce(rows, F.lit(0)) == 0, "no_retrieval").when(recall.isNull(), "unscored")
        .when(recall >= hit, "generation_miss").when(recall == 0, "retrieval_miss").otherwise("partial_retrieval")
    )


def real_gap(summary: Column, phrases: list[str] = GAP_PHRASES) -> Column:
    """Whether a summary admits a gap. A sentence in which only a date is missing doesn't count, unless it is all there is."""
    missing = "(?i)" + "|".join(map(quoted_pattern, phrases))
    said = F.split(F.regexp_replace(summary, r"^\s+|\s+$", ""), r"(?<=[.!?])\s+")
    left = F.array_join(F.filter(said, lambda s: ~(s.rlike(missing) & s.rlike(DATE_WORD))), " ")
    return F.when(F.trim(left) == "", F.lit(True)).otherwise(left.rlike(missing))


def row_text(columns: list[str]) -> Column:
    """The text that a result row is judged by: facts and values, or the triple where there are none."""
    c = lambda n: F.col(n) if n in columns else F.lit(None).cast("string")
    parts = [F.nullif(c("fact"), F.lit("")), F.nullif(c("profile"), F.lit(""))]
    parts.append(F.when(c("attribute").isNotNull() & c("value").isNotNull(), F.concat(F.coalesce(c("subject_name"), F.lit("")), F.lit(" "), c("attribute"), F.lit(" "), c("value").cast("string"))))
    for key in ("max_value", "min_value", "avg_value", "segment_average"):
        if key in columns:
            about = F.coalesce(F.nullif(c("object_name"), F.lit("")), c("segment_name"), F.lit(""))
            parts.append(F.when(F.col(key).isNotNull(), F.trim(F.concat(F.coalesce(c("subject_name"), F.lit("")), F.lit(" "), about, F.lit(" "), F.col(key).cast("string")))))
    for key in ("facts_a", "facts_b", "facts"):
        if key in columns:
            parts.append(F.nullif(F.array_join(F.filter(F.col(key), lambda x: x != ""), " "), F.lit("")))
    triple = F.concat_ws(" ", *[F.nullif(c(k), F.lit("")) for k in ("subject_name", "relationship", "object_name")])
    said = F.concat_ws(" ", *parts)
    return F.trim(F.when(said != "", said).otherwise(triple))
