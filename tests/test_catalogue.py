"""Registered queries of the graph operators against their SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
CORE = [
    "graph_node_index", "neighbors_simple", "log_intersection", "log_difference", "count_atleast", "quant_max", "segment_rank_max", "comp_to_group_avg", "shortest_path_hops", "causal_trails",
    "vec_diversified", "merge_rank_cap", "casing_drift", "value_recovery", "ontology_conformance", "majority_vote", "route_rules", "asof_latest_fact", "stream_tumbling", "episodes_chunk", "gazetteer_link", "parameterised_sql", "csv_questions", "results_rewritten", "stream_append", "sections_parsed", "episode_ingest",
    "graph_conforming", "thematic_ownershipstructure", "thematic_single", "stock_impact", "causal_chain_to", "thematic_parameters", "gazetteer_candidates", "alias_links", "resolved_entities", "merged_matches",
    "matched_companies", "relations_inferred", "entity_positions", "slots_filled", "vec_join", "hybrid_supplement", "enumeration_supplement", "row_lines", "contract_verdict", "kb_validation", "classifier_report", "shuffled_split",
]


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = con.execute(catalogue.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())


def _equal(spark, name, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    rows = catalogue.QUERIES[name](spark, str(sf_dir))
    cols = sorted(rows.columns)
    out = con.execute(catalogue.SQL[name])
    at = [[d[0] for d in out.description].index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in out.fetchall())


def test_full_rows_gain_nothing(spark, tmp_path):
    """More rows than an answer takes: the first by key stay, as in the query's SQL."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype("float32").tolist(), 3 if i % 2 else 4) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    _equal(spark, "hybrid_supplement", tmp_path)


def test_part_keys_beyond_a_million(spark, tmp_path):
    for t, shift in (("part", "p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1000000 ELSE 0 END"), ("orders", None), ("lineitem", None)):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        (rows.selectExpr(*[f"{shift} AS {c}" if shift and c == "p_partkey" else c for c in rows.columns])).write.parquet(f"{tmp_path}/{t}.parquet")
    _equal(spark, "kb_validation", tmp_path)


def test_every_query_has_a_known_name():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) >= 80
