"""Series analyses and the hyperbolic operators against numpy and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.functions import special
from stratagraph.operators import causal, hyperbolic as hyp
from stratagraph.sources import synth


def test_special_functions(spark):
    """Student's law against a sum over its density, for few and many points, odd and even."""
    rows = [(-0.535, 27), (0.3, 3), (0.3, 4), (0.9, 5), (-0.1, 40), (0.05, 1001), (1.0, 9), (0.0, 8), (None, 9), (0.5, 2)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", special.correlation_p(F.col("r"), F.col("n")).alias("p"), special.normal_tail(F.lit(1.959963985)).alias("tail")).collect()
    for x in got:
        assert x.tail == pytest.approx(0.025, abs=1e-7)
        if x.r is None or x.n < 3:
            assert x.p is None
            continue
        # the sine of the angle has density cos ** (n - 4) over (-1, 1)
        angle = (np.arange(200_000) + 0.5) / 200_000 * math.pi / 2
        density = np.cos(angle) ** (x.n - 3)
        assert x.p == pytest.approx(density[np.sin(angle) > abs(x.r)].sum() / density.sum(), abs=1e-4), x


def test_quarters(spark):
    s = {r.t: r.period for r in synth.fault_series(spark).where("series = 'treated'").collect()}
    assert len(s) == 29 and s[24] == "2023-Q1" and s[27] == "2023-Q4"


def test_poisson_fit(spark):
    rng = np.random.default_rng(3)
    t = np.arange(24)
    y = rng.poisson(np.exp(2.0 - 0.02 * t - 0.6 * (t >= 12)))
    got = causal.its_poisson(spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, y, strict=True)], "series string, t int, y double"), 12, 24).first()
    x = np.stack([np.ones(24), t, t >= 12], axis=1).astype(float)
    b = np.zeros(3)
    for _ in range(50):
        mu = np.exp(np.clip(x @ b, -10, 10))
        b = np.linalg.solve(x.T @ (mu[:, None] * x), x.T @ (mu * (x @ b + (y + 1e-6 - mu) / mu)))
    assert [got.b0, got.b1, got.b2] == pytest.approx(list(b), abs=1e-6)
    assert got.se2 == pytest.approx(math.sqrt(np.linalg.inv(x.T @ (np.exp(x @ b)[:, None] * x))[2, 2]), abs=1e-6)


def test_did_and_bootstrap(spark):
    rows = [("a", t, float(v)) for t, v in enumerate([4, 6, 1, 1])] + [("b", t, float(v)) for t, v in enumerate([3, 3, 2, 4])]
    s = spark.createDataFrame(rows, "series string, t int, y double")
    assert causal.did(s, "a", "b", (0, 1), (2, 3)).first().did == -4.0
    b = causal.did_bootstrap(s, "a", "b", (0, 1), (2, 3), 300).first()
    assert b.low <= -4 <= b.high


def test_lagged_correlation_and_constant_series(spark):
    y = [1.0, 3.0, 2.0, 5.0, 4.0, 6.0, 8.0, 7.0]
    rows = [("x", t, v) for t, v in enumerate(y)] + [("y", t + 2, v) for t, v in enumerate(y)] + [("c", t, 1.0) for t in range(10)]
    s = spark.createDataFrame(rows, "series string, t int, y double")
    got = {r.lag: r for r in causal.lagged_correlation(s, "x", "y").collect()}
    assert got[2].r == pytest.approx(1.0) and got[2].p == pytest.approx(0.0, abs=1e-6)
    assert causal.lagged_correlation(s, "c", "y").count() == 0


def test_poincare(spark):
    df = spark.createDataFrame([([0.1, 0.2], [0.3, -0.4]), ([3.0, 4.0], [0.0, 0.0])], "x array<double>, y array<double>")
    r = df.select(hyp.distance(F.col("x"), F.col("y")).alias("d"), hyp.distance(F.col("y"), F.col("x")).alias("e"), hyp.distance(F.col("y"), F.col("y")).alias("z"), hyp.project(F.col("x")).alias("p")).collect()
    assert r[0].d == r[0].e and r[0].z == 0 and r[0].d == pytest.approx(math.acosh(1 + 2 * 0.4 / (0.95 * 0.75 + 1e-12)))
    assert np.linalg.norm(r[1].p) < 1 and list(r[0].p) == [0.1, 0.2]


def test_counterfactual_moves_scores(spark):
    closed = spark.createDataFrame([("t", "r", "a"), ("t", "r", "b"), ("t", "r", "c"), ("t", "a", "c")], "hierarchy string, anc string, desc string")
    pts = spark.createDataFrame([("r", [0.0, 0.1]), ("a", [0.2, 0.0]), ("b", [0.0, 0.5]), ("c", [0.4, 0.1])], "node string, x array<double>")
    names = spark.createDataFrame([(x,) for x in "rabc"], "h string")
    pairs = hyp.sharing(names.crossJoin(names.toDF("t")), closed)
    assert pairs.count() == 6
    scores = pairs.withColumn("score", F.lit(1.0))
    after = hyp.shifted(pts, closed, "a", [0.3, 0.0])
    moved = {(r.h, r.t): r.delta for r in hyp.counterfactual(scores, pairs, pts, after, 0.1).collect()}
    assert moved["a", "b"] != 0 and moved["a", "b"] == moved["b", "a"]
    assert all(r.delta == 0 for r in hyp.counterfactual(scores, pairs, pts, after, 0.1, faithful=True).collect())


def test_bootstrap_of_forty_points(spark):
    """Cells of over sixteen points share no draws; the interval equals numpy's on the same draws."""
    from stratagraph.functions.columns import A, C, FOLD, M

    rng = np.random.default_rng(1)
    y = {s: rng.normal(size=80) for s in "ab"}
    df = spark.createDataFrame([(s, t, float(v)) for s in "ab" for t, v in enumerate(y[s])], "series string, t int, y double")
    got = causal.did_bootstrap(df, "a", "b", (0, 39), (40, 79), 300).first()
    cells = [y["a"][:40], y["a"][40:], y["b"][:40], y["b"][40:]]
    i = np.arange(300)[:, None] * 160 + np.arange(160)
    u = ((((i % M + FOLD * (i >> 31)) % M * A + C) % M * A + C) % M) / M
    assert len(np.unique(u)) == u.size
    m = [c[np.floor(u[:, 40 * k : 40 * k + 40] * 40).astype(int)].mean(1) for k, c in enumerate(cells)]
    d = (m[1] - m[0]) - (m[3] - m[2])
    assert (got.low, got.high, got["mean"]) == (pytest.approx(np.percentile(d, 2.5)), pytest.approx(np.percentile(d, 97.5)), pytest.approx(d.mean()))


def test_norm_update(spark):
    """One round equals numpy's product of factors; the loss falls in every accepted round; weight 0 moves nothing."""
    rng = np.random.default_rng(2)
    up = {i: (i - 1) // 2 for i in range(1, 20)}
    closed = []
    for i in up:
        j = i
        while j:
            j = up[j]
            closed.append(("t", f"n{j:02d}", f"n{i:02d}"))
    pts = {f"n{i:02d}": rng.uniform(-0.6, 0.6, 2) for i in range(20)}
    cdf = spark.createDataFrame(closed, "hierarchy string, anc string, desc string")
    pdf = spark.createDataFrame([(k, x.tolist()) for k, x in pts.items()], "node string, x array<double>")
    factor = dict.fromkeys(pts, 1.0)
    size = {k: np.linalg.norm(x) for k, x in pts.items()}
    for _, a, b in closed:
        by = 0.005 if size[a] >= size[b] - 0.1 else 0.0005
        factor[a] *= 1 - by
        factor[b] *= 1 + by
    got = {r.node: r.x for r in hyp.scaled(pdf, hyp.norm_factors(cdf, pdf, {"t": 1.0})).collect()}
    assert got.keys() == pts.keys() and all(got[k] == pytest.approx((pts[k] * factor[k]).tolist(), abs=1e-12) for k in pts)
    _, losses = hyp.fit_norms(cdf, pdf, {"t": 0.3, "other": 0.0}, 4, rate=0.02)
    assert len(losses) > 2 and all(b < a for a, b in zip(losses, losses[1:], strict=False))
    after, losses = hyp.fit_norms(cdf, pdf, {"t": 0.0}, 4)
    assert losses == [0.0] and {r.node: r.x for r in after.collect()} == {k: x.tolist() for k, x in pts.items()}


def test_fits_settle(spark):
    """A series that needs more than twelve steps, one that never meets the step, one of zeros, beside an easy one."""
    t = np.arange(24)
    y = {"easy": 20 + t % 3, "jump": np.where(t < 11, 0, np.where(t == 11, 1, 1000)), "short": 5 + t[:10], "zero": 0 * t}
    df = spark.createDataFrame([(k, int(i), float(v)) for k, x in y.items() for i, v in enumerate(x)], "series string, t int, y double")
    got = {r.series: r for r in causal.its_poisson(df, 12, 24, most=16).collect()}
    assert got.keys() == y.keys() and [k for k in y if not got[k].settled] == ["zero"]
    for k, x in y.items():
        n = len(x)
        design = np.stack([np.ones(n), t[:n], t[:n] >= 12], axis=1).astype(float)
        b, steps = np.array([np.log(np.mean(x + 1e-6)), 0, 0]), 0
        for steps in range(1, 51):  # noqa: B007
            eta = design @ b
            mu = np.exp(np.clip(eta, -10, 10))
            new = np.linalg.pinv(design.T @ (mu[:, None] * design), rcond=1e-13, hermitian=True) @ design.T @ (mu * (eta + (x + 1e-6 - mu) / np.maximum(mu, 1e-6)))
            b, off = new, np.abs(new - b).max()
            if off < 1e-6:
                break
        assert k != "jump" or steps > 12
        if off < 1e-6:
            assert got[k].settled and [got[k].b0, got[k].b1, got[k].b2] == pytest.approx(list(b), abs=1e-3), k
    easy = got["easy"]
    assert easy.p1 == pytest.approx(math.erfc(abs(easy.z1) / math.sqrt(2)), abs=1e-6) and easy.c1 == pytest.approx(2 * (1 - math.sqrt(math.erf(abs(easy.z1) / math.sqrt(2)))), abs=1e-6)
    assert got["short"].b2 == pytest.approx(0, abs=1e-9)


def test_discovery(spark):
    rng = np.random.default_rng(4)
    y = [(("o"), t, float(5 + 3 * ((t - 1) % 4 < 2) + rng.normal(0, 0.1))) for t in range(28)]
    s = spark.createDataFrame(y, "series string, t int, y double")
    periods = spark.createDataFrame([(t, f"{2017 + t // 4}-Q{t % 4 + 1}") for t in range(28)], "t int, period string")
    got = {(r.source, r.lag): r for r in causal.discovery(s, "o", 12, periods).collect()}
    assert len(got) == 8 and got["breeding_season", 1].r > 0.99 and got["breeding_season", 1].significant and not got["measure", 1].significant
    assert {k[0] for k in got} == {r[0] for r in causal.discovery(s, "o", 12, periods).select("source").collect()}
    assert causal.discovery(s, "o", 99, periods).count() == 4  # a step that never comes does not vary
    assert [r[0] for r in spark.createDataFrame([("2020-Q3",), ("2020Q3",), ("2020-Q5",), (None,)], "p string").select(causal.period_quarter(F.col("p"))).collect()] == [3, None, None, None]


def test_rounds_of_a_fit_stay_small(spark, monkeypatch):
    """Counts over exp(10) never settle: after many rounds the estimated size of a round's table is still that of its few rows."""
    made = []
    for name in ("step", "written"):
        f = getattr(causal, name, None)
        if f:
            monkeypatch.setattr(causal, name, lambda df, f=f: (made.append(f(df)), made[-1])[1])
    df = spark.createDataFrame([("a", t, 60_000.0 + 500 * (t % 5)) for t in range(24)], "series string, t int, y double")
    got = causal.its_poisson(df, 12, 24, most=6).collect()
    assert [r.settled for r in got] == [False] and len(made) > 6
    assert max(int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in made) < 1 << 40
