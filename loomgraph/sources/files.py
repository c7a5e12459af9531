"""Readers and writers: CSV and JSON lines with resume, graph scripts, knowledge-base JSON, text episodes and web articles."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import PropertyGraph

#: Characters of an episode.
EPISODE_CHARS = 6000
#: Characters from which a paragraph of an article counts.
PARAGRAPH_CHARS = 50
#: Fields of a result record, in the order in which they are written.
RESULT_FIELDS = (
    "query ground_truth gold_label predicted_template template_confidence template_id template_match entities resolved_entities masked_query cypher_parameters triplet_slots cypher_strategy "
    "kg_row_count kg_hop_path summary judge_label judge_rationale retrieval_recall retrieval_tokens_wanted retrieval_tokens_found outcome error"
).split()


def read_queries(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None, text: str = "text") -> DataFrame:
    """Questions of CSV files with header, numbered (query_idx) in the order of the files' paths and of the rows in each, from
    offset on, limit of them at most. Rows without a question take a number, but aren't returned. A file is read by one task
    as its rows may hold line breaks, and numbered there; the files before it are added."""
    columns = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    rows = rows.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each file
    rows = rows.join(starts.drop("_n"), "_file").withColumn("query_idx", F.col("_before") + F.col("_at") - F.col("_first"))
    wanted = (F.col("query_idx") >= offset) & F.col(text).isNotNull()
    wanted = wanted if limit is None else wanted & (F.col("query_idx") < offset + limit)
    return rows.filter(wanted).select(*columns, "query_idx")


def without_done(queries: DataFrame, done: DataFrame, text: str = "text") -> DataFrame:
    """Questions that have no result yet."""
    return queries.join(done.select(F.col("query").alias(text)).distinct(), text, "left_anti")


def write_results(rows: DataFrame, path: str, form: str = "json", mode: str = "append", ordered: bool = False) -> None:
    """Appends result records; nested fields are JSON text in CSV. ordered sorts by query_idx first, by ranges, so files hold
    the rows in order."""
    rows = rows.orderBy("query_idx") if ordered else rows
    if form == "csv":
        nested = [f.name for f in rows.schema if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)]
        rows.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        rows.write.mode(mode).format(form).save(path)


def rewrite_ordered(spark: SparkSession, path: str, to: str, schema: T.StructType | str, form: str = "json") -> None:
    """The records that were appended as they were ready, written anew to another folder in the order of the questions."""
    write_results(spark.read.schema(schema).format(form).load(path), to, form, "overwrite", ordered=True)


def read_catalogue(spark: SparkSession, path: str) -> dict:
    """A JSON catalogue, such as templates or aliases, wherever Spark can read it. It is one small document."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def aliases_of(catalogue: dict[str, dict[str, str]]) -> dict[str, tuple[str, str]]:
    """phrase -> (id, type) of an alias catalogue, whose entries hold id and type (and a name)."""
    return {phrase: (entry["id"], entry["type"]) for phrase, entry in catalogue.items()}


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def knowledge_base(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a knowledge-base document: entities, relationships, metric_values, claims, evidence."""
    kb = spark.read.json(path, multiLine=True)
    return {name: kb.select(F.explode(name).alias("r")).select("r.*") for name in ("entities", "relationships", "metric_values", "claims", "evidence") if name in kb.columns}


# -- graph scripts ----------------------------------------------------------------------------------------------------
_MAP = re.compile(r"\{((?:[^{}'\"]|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")*)\}")
_FIELD = re.compile(r"(\w+)\s*:\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\[[^\]]*\]|[^,\s}]+)")


def _value(raw: str):
    if raw[:1] in "'\"":
        return re.sub(r"\\(.)", r"\1", raw[1:-1])
    if raw[:1] == "[":
        return [_value(x.strip()) for x in re.findall(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,\[\]\s]+", raw[1:-1])]
    return None if raw.lower() == "null" else raw


def parse_script(text: str) -> tuple[list[dict], list[dict]]:
    """(node maps, edge maps) of a script that loads a graph with UNWIND [ {...}, ... ]: maps with id are nodes, maps with
    s, t and r are edges; a sector field makes a CONTAINS edge from the sector to the node."""
    nodes, edges = [], []
    for m in _MAP.finditer(re.sub(r"(?m)^\s*//.*$", "", text)):
        record = {k: _value(v) for k, v in _FIELD.findall(m[1])}
        if {"s", "t", "r"} <= record.keys():
            edges.append(record)
        elif "id" in record and ("label" in record or "type" in record):
            nodes.append(record)
            if record.get("sector"):
                edges.append({"s": record["sector"], "t": record["id"], "r": "CONTAINS"})
    return nodes, edges


def thematic_graph(spark: SparkSession, text: str) -> PropertyGraph:
    """The graph of a script. Of repeated ids the last one counts; edges need both ends."""
    nodes, edges = parse_script(text)
    last = {n["id"]: n for n in nodes}
    rows = [(i, n.get("label"), n.get("type") or "COMPANY", ["Entity", n.get("type") or "COMPANY"], n.get("note"), {k: str(v) for k, v in n.items() if k not in ("id", "label", "type", "note", "themes") and v is not None}, n.get("themes"), None) for i, n in last.items()]
    ends = [e for e in edges if e["s"] in last and e["t"] in last]
    table = [(k, e["s"], e["t"], e["r"], int(e["o"]) if e.get("o") else None, e.get("sign"), e.get("ch")) for k, e in enumerate(ends)]
    schema = "id string, name string, type string, labels array<string>, summary string, props map<string,string>, themes array<string>, embedding array<float>"
    return PropertyGraph.of(spark.createDataFrame(rows, schema), spark.createDataFrame(table, "edge_id long, src string, dst string, rel string, `order` int, sign string, channel string"))


# -- texts ------------------------------------------------------------------------------------------------------------
def _packed(paragraphs: Column, most: int) -> Column:
    """Paragraphs joined by blank lines into chunks of `most` characters at most; a longer paragraph is a chunk of its own."""
    last = lambda chunks: F.element_at(chunks, -1)
    fits = lambda chunks, p: (F.size(chunks) > 0) & (F.length(last(chunks)) + F.length(p) + 2 <= most)
    start = F.array().cast("array<string>")
    joined = lambda c, p: F.concat(F.slice(c, 1, F.size(c) - 1), F.array(F.concat(last(c), F.lit("\n\n"), p)))
    return F.aggregate(paragraphs, start, lambda c, p: F.when(fits(c, p), joined(c, p)).otherwise(F.concat(c, F.array(p))))


def episodes(texts: DataFrame, text: str = "value", most: int = EPISODE_CHARS) -> DataFrame:
    """(name, content) of the entries of texts with === part === banners and --- separators.

    The first line of an entry is its title and isn't part of the content, but its (ticker ...) is. Long entries are split
    between paragraphs. Without banners the whole text is one part."""
    banner = r"(?m)^=+[ \t]*\n(.+?)\n=+[ \t]*$"
    marked = F.regexp_replace(F.trim(F.col(text)), banner, "\u0001$1\u0002")
    parts = texts.select(F.explode(F.split(marked, "\u0001")).alias("part"))
    titled = parts.select(F.when(F.col("part").contains("\u0002"), F.trim(F.substring_index("part", "\u0002", 1))).otherwise(F.lit("Preamble")).alias("title"), F.substring_index("part", "\u0002", -1).alias("body"))
    entry = titled.select("title", F.posexplode(F.split("body", r"\n-{3,}\n"))).select("title", "pos", F.trim(F.regexp_replace("col", r"^\s+|\s+$", "")).alias("entry")).filter("entry <> ''")
    head = F.trim(F.split("entry", "\n", 2)[0])
    rest = F.regexp_replace(F.coalesce(F.get(F.split("entry", "\n", 2), F.lit(1)), F.lit("")), r"^\s+|\s+$", "")
    ticker = F.regexp_extract(head, r"(?i)\(ticker[^)]*\)", 0)
    content = F.when(ticker != "", F.concat(ticker, F.lit("\n\n"), rest)).otherwise(rest)
    chunks = entry.select("title", head.alias("head"), _packed(F.split(content, "\n\n"), most).alias("chunks"))
    each = chunks.select("title", "head", F.size("chunks").alias("n"), F.posexplode("chunks").alias("k", "content")).filter("content <> ''")
    suffix = F.when(F.col("n") > 1, F.format_string(" (part %d/%d)", F.col("k") + 1, F.col("n"))).otherwise(F.lit(""))
    return each.select(F.concat(F.lit("["), "title", F.lit("] "), "head", suffix).alias("name"), "content")


def sections(texts: DataFrame, text: str = "value") -> DataFrame:
    """(company, ticker, section) of texts with headings NAME (ticker X: each section is its heading with all up to the next."""
    marked = F.regexp_replace(F.col(text), r"(?m)^(?=[A-Z][A-Z&.' ]{3,60}\s*\(ticker\s+[A-Z0-9&]+)", "\u0001")
    parts = texts.select(F.explode(F.slice(F.split(marked, "\u0001"), 2, 1_000_000_000)).alias("section"))
    head = lambda k: F.regexp_extract("section", r"^([A-Z][A-Z&.' ]{3,60})\s*\(ticker\s+([A-Z0-9&]+)", k)
    return parts.select(F.initcap(F.trim(head(1))).alias("company"), head(2).alias("ticker"), "section")


def facts_in(texts: DataFrame, pattern: str, rel: str, text: str = "content") -> DataFrame:
    """(subject, rel, object, fact): what a pattern with groups subject and object finds in texts; the default extractor."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("fact"))
    part = lambda k: F.trim(F.regexp_extract("fact", pattern, k))
    return found.select(part(1).alias("subject"), F.lit(rel).alias("rel"), part(2).alias("object"), "fact")


def ingested(texts: DataFrame, extract: Callable[[DataFrame], DataFrame], known: PropertyGraph | None = None) -> PropertyGraph:
    """The graph of the facts (subject, rel, object, fact) that extract() finds in episodes, merged into a known graph. Nodes
    are one for each name in any case, edges one for each triple and fact; ids are hashes, so the same episode again changes
    nothing."""
    key = lambda name: F.concat(F.lit("N"), F.hex(F.xxhash64(F.lower(name))))
    facts = extract(texts).filter("subject <> '' AND object <> ''").select("subject", "rel", "object", "fact").distinct()
    names = facts.select(F.explode(F.array("subject", "object")).alias("name"))
    nodes = names.groupBy(key(F.col("name")).alias("id")).agg(F.min("name").alias("name")).withColumn("type", F.lit("ENTITY"))
    edges = facts.select(key(F.col("subject")).alias("src"), key(F.col("object")).alias("dst"), "rel", "fact").distinct()
    edges = edges.withColumn("edge_id", F.xxhash64("src", "rel", "dst", "fact"))
    fresh = PropertyGraph.of(nodes, edges)
    if known is None:
        return fresh
    old = PropertyGraph.of(known.nodes, known.edges)
    more = fresh.nodes.join(old.nodes.select("id"), "id", "left_anti").select(*old.nodes.columns)
    added = fresh.edges.join(old.edges.select("edge_id"), "edge_id", "left_anti").select(*old.edges.columns)
    return PropertyGraph(old.nodes.unionByName(more), old.edges.unionByName(added))


def article_paragraphs(html: str = "html") -> Column:
    """The paragraphs of a page that are longer than PARAGRAPH_CHARS, joined by blank lines."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|</div>|\z)"), F.lit(1))
    plain = F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "(?s)<[^>]*>", ""), r"\s+", " ")))
    return F.array_join(F.filter(plain, lambda p: F.length(p) > PARAGRAPH_CHARS), "\n\n")
