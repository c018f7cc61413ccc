"""Descent as relations: gradients against finite differences, an epoch against numpy, models that differ, features from facts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import descent, features, kg

R = np.random.default_rng(5)
MODELS = ("tcomplex", "complex", "distmult", "tuckert", "transe", "rotate", "eai_tcomplex", "chkg", "inductive")


@pytest.mark.parametrize("model", ["tcomplex", "distmult", "transe", "rotate"])
def test_gradients(model):
    h, w, t = (R.normal(size=(3, 6)) for _ in range(3))
    _, *grads = descent.pair_gradients(model, h, w, t)
    for k, g in enumerate(grads):
        for i, j in np.ndindex(3, 6):
            moved = [h.copy(), w.copy(), t.copy()]
            moved[k][i, j] += 1e-6
            up = descent.pair_gradients(model, *moved)[0][i]
            moved[k][i, j] -= 2e-6
            assert (up - descent.pair_gradients(model, *moved)[0][i]) / 2e-6 == pytest.approx(g[i, j], abs=1e-5)


@pytest.fixture(scope="module")
def world(spark):
    """Ten entities in a ring, facts at three times, one of them twice; features, two trees."""
    quads = [(h, h % 2, (h + 1 + h % 3) % 10, k) for h in range(10) for k in range(3)] + [(0, 0, 1, 0)]
    f = R.normal(size=(10, 3))
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    tree, norm = [1, 1, 1, 1, 2, 2, 2, 2, -8, -9], R.uniform(0, 0.9, 10)
    rows = [(i, f[i].tolist(), tree[i], float(norm[i]), i % 5 != 4) for i in range(10)]
    entities = spark.createDataFrame(rows, "id int, f array<double>, tree long, norm double, seen boolean")
    return spark.createDataFrame(quads, "h int, r int, t int, tau int"), entities, spark.range(2).select(F.col("id").cast("int").alias("id")), rows


def numpy_epoch(params, rows, batches, config, model, negatives, margin, lr=0.1, reg=0.001, weight=0.1):
    """The same steps on dictionaries, a pair at a time."""
    v = {(r.kind, r.id): np.array(r.v) for r in params if r.config == config}
    acc = {k: np.zeros_like(x) for k, x in v.items()}
    of = {r[0]: r for r in rows}

    def bonus(h, t):
        if model == "eai_tcomplex":
            return weight * np.dot(of[h][1], of[t][1])
        return weight * max(0, 1 - abs(of[h][3] - of[t][3])) if model == "chkg" and of[h][2] == of[t][2] else 0

    for batch in batches:
        sums, n = {}, 0
        for x in batch:
            if x.j >= negatives or model == "inductive" and not all(of[i][4] for i in (x.h, x.t, x.neg)):
                continue
            n += 1
            h, w = v["E", x.h], v["R", x.r] + (v["T", x.tau] if model in descent.TIMED else 0)
            (p, ph, pw, pt), (q, nh, nw, nt) = (tuple(g[0] for g in descent.pair_gradients(model, h[None], w[None], v["E", t][None])) for t in (x.t, x.neg))
            if margin + q - p + bonus(x.h, x.neg) - bonus(x.h, x.t) > 0:
                for key, g in ((("E", x.h), nh - ph), (("E", x.t), -pt), (("E", x.neg), nt), (("R", x.r), nw - pw), (("T", x.tau), nw - pw)):
                    if key in v:
                        sums[key] = sums.get(key, 0) + g
        for key, g in sums.items():
            s = g / (n / negatives) + reg * v[key]
            acc[key] += s**2
            v[key] = v[key] - lr * s / (np.sqrt(acc[key]) + 1e-8)
        if model == "transe":
            v |= {k: x / (np.linalg.norm(x) if np.linalg.norm(x) >= 1e-8 else 1) for k, x in v.items() if k[0] == "E"}
    return v


def test_an_epoch_equals_numpy(spark, world):
    quads, entities, relations, rows = world
    configs = spark.createDataFrame([(m, m, 3 + i % 2, 2 + i % 2, 1.0) for i, m in enumerate(MODELS)], descent.CONFIG)
    params = descent.initial(configs, entities, relations, 3)
    start = params.collect()
    assert all(len(r.v) == (3 + MODELS.index(r.config) % 2) * (1 if r.model in descent.REAL else 2) for r in start)
    parts = descent.batches(quads, entities, 1, 2, 3)
    dealt = [b.collect() for b in parts]
    assert sum(map(len, dealt)) == 31 * 3 and all(dealt)
    for part in parts:
        params, _ = descent.one_step(params, configs, part, entities, 8)
    got = {(r.config, r.kind, r.id): r.v for r in params.collect()}
    for i, m in enumerate(MODELS):
        for (kind, k), x in numpy_epoch(start, rows, dealt, m, m, 2 + i % 2, 1.0).items():
            assert got[m, kind, k] == pytest.approx(x.tolist(), abs=1e-9), (m, kind, k)


def test_models_differ_and_learn(spark, world):
    quads, entities, relations, _ = world
    configs = spark.createDataFrame([(m, m, 4, 4, 1.0) for m in ("tcomplex", "eai_tcomplex", "inductive", "chkg")], descent.CONFIG)
    params, history = descent.train(quads, configs, entities, relations, 3, 2)
    assert all(history[-1][m] < history[0][m] for m in history[0])
    start = {r.id: r.v for r in descent.initial(configs, entities, relations, 3).where("config = 'inductive' AND kind = 'E'").collect()}
    end = {r.id: r.v for r in params.where("config = 'inductive' AND kind = 'E'").collect()}
    assert start.keys() == end.keys() and start[4] != end[4] and len(end[4]) == 8  # made from features, not trained
    ranks = set()
    for m in ("tcomplex", "chkg"):
        q, c, how = descent.vectors(params, m, m, entities, quads.select("h", "r", "tau").distinct())
        found = kg.filtered_ranks(quads, q, c, quads, how)
        assert found.count() == 31
        ranks.add(tuple(kg.rank_metrics(found).first()))
    assert len(ranks) == 2 and len(set(history[-1].values())) == 4


def test_effect_in_ranks(spark):
    """The effect counts for candidates of the head's tree alone."""
    q = spark.createDataFrame([(0, 0, 0, [1.0, 0.5, 7.0, 0.4])], "h int, r int, tau int, q array<double>")
    c = spark.createDataFrame([(0, [0.1, 7.0, 0.4]), (1, [0.3, 8.0, 0.4]), (2, [0.2, 7.0, 0.1])], "id int, c array<double>")
    test = spark.createDataFrame([(0, 0, t, 0) for t in (0, 1, 2)], "h int, r int, t int, tau int")
    assert sorted((r.t, r["rank"]) for r in kg.filtered_ranks(test, q, c, test.where("t > 5"), "dot_effect").collect()) == [(0, 1), (1, 3), (2, 2)]


def test_features_from_facts(spark):
    facts = spark.createDataFrame([("a", "r", "b", 0, None), ("a", "r", "c", None, None), ("b", "s", "a", 1, 2)], "h string, r string, t string, tb int, te int")
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "name string")
    slots = [((F.col("r") == "r") & (F.col("side") == "h"), 4.0), (F.col("te") > 1, 1.0), (F.col("other") == "a", 1.0)]
    got = {r.name: r.f for r in features.fact_features(names, facts, slots, 5).collect()}
    n = (0.25 + 1) ** 0.5
    assert got["a"] == pytest.approx([0.5 / n, 1 / n, 0, 0, 0]) and got["b"] == pytest.approx([0, 2**-0.5, 2**-0.5, 0, 0]) and got["z"] == [0, 0, 0, 0, 1.0]
    with pytest.raises(ValueError):
        features.fact_features(names, facts, slots, 3)
