"""Scores as columns against numpy, ranking and intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import kg, scoring

R = np.random.default_rng(0)


def columns(spark, **vectors):
    names = list(vectors)
    return spark.createDataFrame([[v.tolist() for v in vectors.values()]], ", ".join(f"{n} array<double>" for n in names))


def test_scores(spark):
    v = {n: R.normal(size=6) for n in ("hr", "hi", "rr", "ri", "vr", "vi", "tr", "ti")}
    df = columns(spark, **v)
    h, r, t, tau = v["hr"] + 1j * v["hi"], v["rr"] + 1j * v["ri"], v["tr"] + 1j * v["ti"], v["vr"] + 1j * v["vi"]
    want = {
        "tcomplex": (h * (r + tau) * t.conj()).sum().real, "complex": (h * r * t.conj()).sum().real, "transe": -np.abs(v["hr"] + v["rr"] - v["tr"]).sum(),
        "distmult": (v["hr"] * v["rr"] * v["tr"]).sum(), "rotate": -(np.abs(h * r / np.abs(r) - t) ** 2).sum(), "tucker": (v["hr"] * (v["rr"] + v["vr"]) * v["tr"]).sum(),
    }
    got = df.select(
        scoring.tcomplex("hr", "hi", "rr", "ri", "vr", "vi", "tr", "ti").alias("tcomplex"), scoring.complex_score("hr", "hi", "rr", "ri", "tr", "ti").alias("complex"), scoring.transe("hr", "rr", "tr").alias("transe"),
        scoring.distmult("hr", "rr", "tr").alias("distmult"), scoring.rotate("hr", "hi", "rr", "ri", "tr", "ti").alias("rotate"), scoring.tucker_t("hr", "rr", "vr", "tr").alias("tucker"),
        scoring.attribute_bonus(F.lit(0.0), F.col("hr"), F.col("tr")).alias("bonus"),
    ).first()
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=1e-9), k
    assert got.bonus == pytest.approx(0.1 * v["hr"] @ v["tr"] / np.linalg.norm(v["hr"]) / np.linalg.norm(v["tr"]))


def test_empty_metrics(spark):
    got = kg.rank_metrics(spark.createDataFrame([], "rank int")).first()
    assert set(got) == {0.0}


def test_filtered_ranks(spark):
    """Ties count for the target, known tails are left out, repeated rows stay; a candidate that nothing points at counts too."""
    candidates = spark.createDataFrame([(c, [s]) for c, s in enumerate((0.9, 0.8, 0.8, 0.1))], "id int, c array<double>")
    queries = spark.createDataFrame([(0, 0, 0, [1.0])], "h int, r int, tau int, q array<double>")
    quads = lambda rows: spark.createDataFrame([(0, 0, t, 0) for t in rows], "h int, r int, t int, tau int")
    ranks = lambda test, known: sorted((r.t, r["rank"]) for r in kg.filtered_ranks(quads(test), queries, candidates, quads(known)).collect())
    assert ranks([1, 3], []) == [(1, 2), (3, 4)]
    assert ranks([1, 1], [0]) == [(1, 1), (1, 1)]
    assert ranks([3], [0, 3]) == [(3, 3)]
    assert ranks([], [0]) == []


def test_names_and_relations_present(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "name string, id int")
    rows = spark.createDataFrame([(0, 1), (1, 7)], "h int, t int")
    assert sorted(map(tuple, kg.decode(rows, ids, {"h": "hn", "t": "tn"}).select("h", "t", "hn", "tn").collect())) == [(0, 1, "a", "b"), (1, 7, "b", None)]
    quads = spark.createDataFrame([(0, 1, 1, 0)], "h int, r int, t int, tau int")
    assert [tuple(r) for r in kg.relations_present(quads, ids, ["b", "a", "zzz"]).collect()] == [("b", 1)]
    assert kg.relations_present(quads, ids, ["zzz"]).count() == 0


def test_intervals(spark):
    facts = spark.createDataFrame([("a", "r", "b", None, None), ("a", "r", "c", 2, None), ("a", "r", "d", -1, 1), ("a", "r", "e", 3, 9), ("a", "r", "e", 3, 3), ("a", "r", "e", 3, 3)], "h string, r string, t string, tb int, te int")
    got = sorted((r.t, r.tau) for r in kg.expand_intervals(facts, 4).collect())
    assert got == [("b", 0), ("b", 1), ("b", 2), ("b", 3), ("c", 2), ("c", 3), ("d", 0), ("d", 1), ("e", 3), ("e", 3), ("e", 3)]
    heads = facts.select("h").distinct()
    assert kg.deployed_at(facts.where("t = 'b'"), heads, "r", 1).first().deployed is False
    assert kg.deployed_at(facts.where("t = 'c'"), heads, "r", 3).first().deployed is True


def test_interval_join_counts_each_pair_once(spark):
    rng = np.random.default_rng(1)
    spans = [(i, int(a), int(a + b)) for i, (a, b) in enumerate(zip(rng.integers(-50, 50, 40), rng.integers(0, 40, 40), strict=True))]
    df = spark.createDataFrame(spans, "id int, lo int, hi int")
    got = sorted((r.a_id, r.b_id) for r in kg.interval_join(df, df, 7).collect())
    assert got == sorted((a, b) for a, l, h in spans for b, m, k in spans if l <= k and h >= m)


def test_novel_links_leave_known_pairs_out(spark):
    s = spark.createDataFrame([(0, 1, 9.0), (0, 2, 8.0), (0, 3, -9.0), (1, 1, 2.0), (1, 1, 4.0)], "h int, cand int, score double")
    known = spark.createDataFrame([(0, 1)], "h int, t int")
    assert [(r.h, r.cand) for r in kg.novel_links(s, known, 0.3, 10).collect()] == [(0, 2), (1, 1)]


def test_grids_take_all_facts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from stratagraph.operators import kg, training
    from stratagraph.plans import graphs

    quads = spark.createDataFrame([(h, r, t, tau) for h in range(4) for r in range(4) for t in range(5, 8) for tau in range(7)], "h int, r int, t int, tau int")

    class Small:
        def __init__(self, spark, d):
            self.quads, self.entities, self.relations = quads, spark.range(8), spark.range(4)

    seen = []
    monkeypatch.setattr(graphs, "Graph", Small)
    monkeypatch.setattr(training, "run_grid", lambda q, *rest: seen.append(q) or q)
    graphs.train_models(spark, "")
    want = quads.withColumn("split", kg.split_label(F.col("tau"), 4, 5, 6)).where("split IS NOT NULL")
    assert seen[0].exceptAll(want).count() == 0 and want.exceptAll(seen[0]).count() == 0
