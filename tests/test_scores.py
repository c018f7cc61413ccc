"""Score queries of a stated set against all vectors, each with its SQL and the number of pairs."""

import os
from glob import glob

import duckdb
import pytest

from stratagraph.plans import ORACLES, QUERIES
from tests.test_oracles import DATA, plain

WHOLE = ["score_tcomplex", "score_complex", "score_distmult", "score_transe", "score_rotate", "score_tuckert", "score_attr_bonus"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_every_tail_is_scored(spark, name):
    con = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    columns = ["h", "r", "tau", "t", "score"]
    got = QUERIES[name](spark, DATA).select(columns).collect()
    relations = QUERIES["relation_ids"](spark, DATA).count()
    n, heads = con.sql("select count(*), count(*) filter (vec_id%20=0) from embeddings").fetchall()[0]
    assert len(got) == heads * relations * 2 * n
    assert plain(got) == plain(con.sql(ORACLES[name]).select(*columns).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_cosine(spark):
    """Not the nearest alone: a row for every vector of the stated set with every vector."""
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    got = QUERIES["attribute_cosine"](spark, DATA).select("a", "b", "cos").collect()
    n, asked = con.sql("select count(*), count(*) filter (vec_id%20=0) from embeddings").fetchall()[0]
    assert len(got) == asked * n and {r.a for r in got} == set(range(0, n, 20))
    assert plain(got) == plain(con.sql(ORACLES["attribute_cosine"]).select("a", "b", "cos").fetchall())
