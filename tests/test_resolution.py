"""Entity resolution and logs of facts against plain versions."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.components import components
from loomgraph.sources import resolution
from loomgraph.streaming.factlog import FactLog


def plain_of(name):
    words = [w for w in re.sub(r"[\W_]+", " ", name.lower()).split(" ") if w]
    return " ".join([w for w in words if w not in resolution.LEGAL_FORMS] or words)


def runs_of(name):
    line = f" {name} "
    return {line[i : i + 3] for i in range(max(len(line) - 2, 1))}


def plain_resolved(names, share):
    uses = collections.Counter(n for n in names if n and n.strip())
    plain = sorted({plain_of(n) for n in uses} - {""})
    group = {p: {p} for p in plain}

    def join(a, b):
        if group[a] is not group[b]:
            both = group[a] | group[b]
            for p in both:
                group[p] = both

    for a, b in itertools.combinations(plain, 2):
        x, y = runs_of(a), runs_of(b)
        if len(x & y) >= share * len(x | y) - 1e-9:
            join(a, b)
    short = collections.defaultdict(list)
    for p in plain:
        words = [w for w in p.split(" ") if w not in resolution.SMALL_WORDS]
        if len(words) >= 3:
            short["".join(w[0] for w in words)].append(p)
    before = {p: min(group[p]) for p in plain}
    for p in plain:
        if len({before[x] for x in short.get(p, ())}) == 1:
            join(p, short[p][0])
    out = {}
    for n in uses:
        members = [m for m in uses if plain_of(n) and plain_of(m) in group[plain_of(n)]] or [n]
        out[n] = min(members, key=lambda m: (-uses[m], -len(m), m))
    return out


@pytest.mark.parametrize("share", [0.5, 0.7, 0.9])
def test_names_equal_a_plain_resolution(spark, share):
    rng = random.Random(11)
    names = ["State Bank of India", "SBI", "State Bank Of India Ltd.", "STATE BANK INDIA", "Axis Bank", "Axis Bank Limited", "Axis Banks", "The Company", "Co.", "...", "", None, "  ", "a", "ab", "A", "Bank of Baroda", "BB", "Bank of Barodaa"]
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    for stem in stems:
        names += [stem, stem.title() + rng.choice([" Ltd", " Inc", ""]), stem[:-1] + rng.choice("xyz"), stem + " " + rng.choice(stems)]
    names += ["Axis Bank"] * 3
    got = {r.name: r.canonical for r in resolution.resolved(spark.createDataFrame([(n,) for n in names], "name string"), share).collect()}
    assert got == plain_resolved(names, share)
    if share < 0.9:
        assert got["SBI"] == got["STATE BANK INDIA"] == got["State Bank of India"] != got["Axis Bank"]
    assert resolution.resolved(spark.createDataFrame([], "name string")).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (7, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_later_facts_end_those_that_they_contradict(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    facts = [
        ("Acme Ltd", "LED_BY", "Ann", "Ann leads", day(1)), ("ACME", "LED_BY", "Bob", "Bob leads", day(9)), ("Acme", "LED_BY", "Ann", "Ann leads still", day(5)), ("Acme", "LED_BY", "Ann", "Ann again", day(5)),
        ("Acme", "OWNS", "Mill", "a mill", day(1)), ("Acme", "OWNS", "Mine", "a mine", day(2)), ("", "OWNS", "x", "", day(1)), (None, "OWNS", "x", "", day(1)), ("Acme", None, "x", "", day(1)), ("Acme", "OWNS", "Mill", "a mill", day(1)),
    ]
    df = spark.createDataFrame(facts, "subject string, rel string, object string, fact string, valid_at string").withColumn("valid_at", F.to_timestamp("valid_at"))
    for rows in (df, df.orderBy(F.desc("valid_at")).repartition(3)):
        g, names = resolution.resolved_graph(rows, ["LED_BY"])
        canonical = {r.name: r.canonical for r in names.collect()}
        assert canonical["Acme Ltd"] == canonical["ACME"] == "Acme"
        node = {r.id: r.name for r in g.nodes.collect()}
        got = {(node[r.src], r.rel, node[r.dst], r.valid_at.day, r.invalid_at and r.invalid_at.day, r.fact) for r in g.edges.collect()}
        assert got == {("Acme", "LED_BY", "Ann", 1, 9, "Ann leads"), ("Acme", "LED_BY", "Ann", 5, None, "Ann again"), ("Acme", "LED_BY", "Bob", 9, None, "Bob leads"), ("Acme", "OWNS", "Mill", 1, None, "a mill"), ("Acme", "OWNS", "Mine", 2, None, "a mine")}


SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("src", T.StringType()), ("rel", T.StringType()), ("valid_at", T.TimestampType()), ("edge_id", T.LongType()), ("value", T.DoubleType()))])


@pytest.mark.parametrize("history", [False, True])
def test_a_log_equals_one_batch_however_rows_come(spark, tmp_path, history):
    rng = random.Random(2)
    rows = [(f"n{rng.randint(0, 9)}", rng.choice("xy"), rng.randint(0, 30), k, float(k)) for k in range(120)]
    rows += rng.sample(rows, 20)  # repeats
    rng.shuffle(rows)  # and late ones
    make = lambda some: spark.createDataFrame(some, "src string, rel string, s long, edge_id long, value double").select("src", "rel", F.timestamp_seconds("s").alias("valid_at"), "edge_id", "value")
    log = FactLog(str(tmp_path / f"log-{history}"), SCHEMA, ("src", "rel"), history=history, fanout=3)
    assert log.newest(spark).count() == 0
    cuts = list(range(0, len(rows), 10))
    for number, lo in enumerate(cuts):
        log.sink(make(rows[lo : lo + 10]), number)
        if number == 4:
            log.sink(make(rows[lo : lo + 10]), number)  # run again
    log.sink(make(rows[:10]), 0)  # run again when it has long been merged
    best = {}
    for r in rows:
        best[r[:2]] = max(best.get(r[:2], r), r, key=lambda x: (x[2], x[3]))
    assert {(r.src, r.rel, r.edge_id) for r in log.newest(spark).collect()} == {(r[0], r[1], r[3]) for r in best.values()}
    spans = log.runs(spark)
    assert spans[0][0] == 0 and spans[-1][1] == len(cuts) - 1 and len(spans) <= 6
    if history:
        want = set()
        for key in best:
            of_key = sorted({r[2:4] for r in rows if r[:2] == key})
            want |= {(*key, e, after[0] if after else None) for (_, e), after in zip(of_key, [*of_key[1:], None])}
        assert {(r.src, r.rel, r.edge_id, r.invalid_at and int(r.invalid_at.timestamp())) for r in log.facts(spark).collect()} == want
    else:
        with pytest.raises(ValueError):
            log.facts(spark)


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    log = FactLog(str(tmp_path / "log"), SCHEMA, ("src", "rel"), fanout=4)
    make = lambda lo, n: spark.range(lo, lo + n).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("x").alias("rel"), F.timestamp_seconds("id").alias("valid_at"), F.col("id").alias("edge_id"), F.lit(0.0).alias("value"))
    log.sink(make(0, 20_000), 0)
    log.sink(make(5, 3), 1)
    small = spark.read.parquet(f"{log.path}/run=1-1")
    assert small.count() == 3 and log.newest(spark).count() == 20_000


def test_a_stream_is_followed_and_taken_up_again(spark, tmp_path):
    source = tmp_path / "source"
    make = lambda some, part: spark.createDataFrame(some, "src string, rel string, valid_at timestamp, edge_id long, value double").coalesce(1).write.mode("append").parquet(str(source))
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    log = FactLog(str(tmp_path / "log"), SCHEMA, ("src", "rel"), history=True)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    make([("a", "x", at(5), 1, 1.0)], 0)
    make([("a", "x", at(2), 2, 2.0)], 1)
    log.follow(stream(), str(tmp_path / "state"))
    make([("a", "x", at(9), 3, 3.0), ("b", "x", at(1), 4, 4.0)], 2)
    log.follow(stream(), str(tmp_path / "state"))
    log.follow(stream(), str(tmp_path / "state"))
    assert {(r.edge_id, r.invalid_at) for r in log.facts(spark).collect()} == {(2, at(5)), (1, at(9)), (3, None), (4, None)}
    assert {r.edge_id for r in log.newest(spark).collect()} == {3, 4}
