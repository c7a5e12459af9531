"""URL filtering: rules first, then a path-template tree for each host whose templates are judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, UPPER, cut, join_groups

#: (verdict, host, path) of the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Levels of the tree; what lies deeper is one wildcard.
DEPTH = 4
#: A segment stays literal if it has this many rows and this share of its parent's; so a node has 1 / share literals at most.
LITERAL_ROWS, LITERAL_SHARE = 8, 0.02
#: Sibling branches merge if their labelled block rates differ by less than this many standard errors.
SIMILAR_Z = 1.96
#: Rows of the parent's expectation that are added to a node's own labels, and the purity from which a template is rejected.
PRIOR_ROWS, REJECT = 2.0, 0.8
#: A row without a label counts as so much of an allowed one: where rules block a part of a host, the rest isn't guilty by it.
UNLABELLED = 0.25


def with_address(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path: empty for null urls and those without '://'."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return df.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits a host or a domain above it and the start of the path, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _branches(rows: DataFrame) -> DataFrame:
    """(host, template, seg) -> branch and size, for the segments that stay literal at one level of the tree."""
    node = ["host", "template"]
    seen = rows.filter("seg IS NOT NULL").groupBy(*node, "seg").agg(F.count(F.lit(1)).alias("size"), F.sum("blocked").alias("blocked"), F.count("blocked").alias("labelled"))
    nodes = seen.groupBy(*node).agg(F.sum("size").alias("node_size"))
    literal = seen.filter(F.col("size") >= LITERAL_ROWS).join(nodes, node).filter(F.col("size") >= LITERAL_SHARE * F.col("node_size"))
    # Smoothed rates, unlabelled branches at one half; neighbours in this order merge while no gap is significant.
    rate = (F.coalesce("blocked", F.lit(0)) + 1) / (F.col("labelled") + 2)
    order = Window.partitionBy(*node).orderBy("rate", "seg")
    rated = literal.withColumn("rate", rate).withColumn("error", F.col("rate") * (1 - F.col("rate")) / (F.col("labelled") + 3))
    gap = (F.col("rate") - F.lag("rate").over(order)) / F.sqrt(F.col("error") + F.lag("error").over(order))
    labels_differ = (F.col("labelled") > 0) != (F.lag("labelled").over(order) > 0)
    grouped = rated.withColumn("_new", F.coalesce(((gap >= SIMILAR_Z) | labels_differ).cast("int"), F.lit(0))).withColumn("_group", F.sum("_new").over(order))
    same = Window.partitionBy(*node, "_group")
    return grouped.select(*node, "seg", "size", F.array_join(F.array_sort(F.collect_list("seg").over(same)), "|").alias("branch"))


def _purities(rows: DataFrame) -> DataFrame:
    """(host, template) -> size, labelled and purity, from the whole table down to the templates."""
    levels = [f"_branch{k}" for k in range(DEPTH)]
    blocked = F.coalesce(F.sum("blocked"), F.lit(0))
    leaves = rows.groupBy("host", *levels, "template").agg(F.count(F.lit(1)).alias("size"), F.count("blocked").alias("labelled"), blocked.alias("_blocked"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    leaves = cut(leaves.withColumn("_domain", F.when(domain != "", domain).otherwise(F.col("host"))))
    counts = [F.sum("_blocked").alias("_b"), (F.sum("labelled") + UNLABELLED * (F.sum("size") - F.sum("labelled"))).alias("_n")]
    whole = leaves.agg(*counts).first()  # nulls for an empty table
    # Each level is counted from the leaves, so the plan has one aggregate and one join a level. A node has one parent: what it
    # expects is learnt from the parent's other rows; a parent without other rows is the same node and only hands its own on.
    out, prior, above = leaves, F.lit(0.5), (F.lit(whole["_b"]), F.lit(whole["_n"]))
    for k, key in enumerate((["_domain"], ["host"], *(["host", *levels[: k + 1]] for k in range(DEPTH)), ["host", *levels, "template"])):
        nodes = leaves.groupBy(*key).agg(*counts)
        out = out.join(nodes.select(*key, F.col("_b").alias(f"_b{k}"), F.col("_n").alias(f"_n{k}")), key)
        own = (F.col(f"_b{k}"), F.col(f"_n{k}"))
        prior = (above[0] - own[0] + PRIOR_ROWS * prior) / (above[1] - own[1] + PRIOR_ROWS)
        above = own
    purity = (above[0] + PRIOR_ROWS * prior) / (above[1] + PRIOR_ROWS)
    return out.select("host", "template", "size", "labelled", purity.alias("purity"))


def judge_urls(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """df with host, path, rule, template, labelled, purity and verdict.

    The rules' verdicts are the labels. Level by level, each host's tree keeps frequent segments, generalises all others to
    '*' and merges branches whose label rates don't differ. A template's purity is its blocked share, rows without a label
    counting UNLABELLED as allowed, smoothed by PRIOR_ROWS rows of what its parent expects. A node expects the blocked share of
    its rows outside the child, smoothed in the same way by what the node above expects: template, the branches above it, host,
    domain, the whole table, one half. So no row counts twice, and nodes with the same rows are one. A row gets its rule's
    verdict, else block if its template's purity is REJECT or more, else allow. Null, empty and malformed urls have an empty host and path and are judged alike; every row stays, repeated ones
    too. Columns of df named like those that are added are replaced.
    """
    new = ["host", "path", "rule", "verdict", "template", "labelled", "purity"]
    packed = df.select(F.struct(*[c for c in df.columns if c not in new]).alias("_row"), F.col(url).alias("_url"))
    rows = with_address(packed, "_url").withColumn("_rule", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    rows = rows.withColumn("blocked", F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("int")))
    rows = rows.withColumn("_segs", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("template", F.lit("")).drop("_url")
    total = rows.count()
    for level in range(DEPTH):
        rows = rows.withColumn("seg", F.when(F.col("path") != "", F.get("_segs", F.lit(level))))
        rows = join_groups(rows, cut(_branches(rows)), ["host", "template", "seg"], "size", total).drop("size")
        step = F.when(F.col("seg").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit("*"))))
        rows = rows.withColumn("template", F.concat("template", step)).withColumn(f"_branch{level}", F.col("template")).drop("seg", "branch")
    rows = rows.withColumn("template", F.when(F.size("_segs") > DEPTH, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("_segs")
    rows = join_groups(rows, cut(_purities(rows)), ["host", "template"], "size", total)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("_row.*", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "labelled", "purity")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict by the production rules, with its template, labels and purity."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).drop("url")


QUERIES = {"op8_url_filter": op8_url_filter}
