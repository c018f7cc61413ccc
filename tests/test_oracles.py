"""Queries against their SQL at the smallest scale; a choice that covers every module of queries."""

import os
from glob import glob

import duckdb
import pytest

from stratagraph.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
CHOSEN = ["edge_rules", "degree_centrality", "season_summary", "risk_ranking", "topk_jaccard", "interval_expand", "interval_overlap", "negative_samples", "score_rotate", "filtered_ranks", "novel_threats", "closure", "causal_effect", "weighted_tree_loss", "its_poisson", "did_bootstrap", "lag_discovery", "annual_rollup", "norm_update", "fact_features_16", "recommend_topk", "season_weight", "score_inductive"]


def plain(rows):
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert plain(found.select(columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())
