"""Blocked scores, places in an order, projections and effects along trees, each against plain numpy or all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import blocks, graph, hyperbolic as hyp, kg, ordinals, projection

R = np.random.default_rng(7)


def frame(spark, x, name, ids="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{ids} long, {name} array<double>")


def pairwise(q, c, how):
    if how == "dot":
        return q @ c.T
    off = q[:, None, :] - c[None, :, :]
    return -(np.abs(off) if how == "l1" else off**2).sum(axis=2)


@pytest.mark.parametrize("how", ["dot", "l1", "l2"])
def test_best_and_counts(spark, how):
    """More candidates than a block holds, over several partitions; equal scores by id; fewer candidates than places."""
    q, c = R.integers(-2, 3, (9, 3)).astype(float), R.integers(-2, 3, (blocks.CANDIDATES + 700, 3)).astype(float)
    s = pairwise(q, c, how)
    queries, candidates = frame(spark, q, "q", "a"), frame(spark, c, "c").repartition(3)
    got = {}
    for r in blocks.best(queries, ["a"], candidates, 7, how).collect():
        got.setdefault(r.a, []).append((-r.score, r.id))
    assert got.keys() == set(range(9))
    for a, rows in got.items():
        assert sorted(rows) == [(-s[a, i], i) for i in np.lexsort((np.arange(len(c)), -s[a]))[:7]]
    few = blocks.best(queries, ["a"], candidates.where("id < 3"), 7, how)
    assert few.count() == 27 and few.agg(F.max("id")).first()[0] == 2
    own = queries.withColumn("own", F.lit(-1.0))
    for r in blocks.against_all(own, ["a"], candidates, how).collect():
        assert (r.better, r.n) == ((s[r.a] > -1).sum(), len(c)) and r.hinge == pytest.approx(np.maximum(0, 2 + s[r.a]).sum())


@pytest.mark.parametrize("how", ["dot", "l1", "l2"])
def test_every_pair(spark, how):
    """One row for each pair, over several blocks; a pair without a vector has no score; empty sides give no rows."""
    q, c = R.normal(size=(37, 3)), R.normal(size=(blocks.CANDIDATES + 300, 3))
    s = np.round(pairwise(q, c, how), 6)
    queries, candidates = frame(spark, q, "q", "a"), frame(spark, c, "c").repartition(3)
    x = blocks.every(queries, ["a"], candidates, how).toPandas()
    assert len(x) == s.size and not x.duplicated(["a", "id"]).any()
    assert np.allclose(x.score, s[x.a, x.id], rtol=0, atol=1e-12)
    less = blocks.every(queries.withColumn("q", F.when(F.col("a") > 2, F.col("q"))), ["a"], candidates.where("id < 9").withColumn("c", F.when(F.col("id") > 0, F.col("c"))), how)
    assert less.count() == 37 * 9 and less.where("score IS NOT NULL").count() == 34 * 8 and less.distinct().count() == 37 * 9
    assert blocks.every(queries.where("a < 0"), ["a"], candidates, how).count() == 0 == blocks.every(queries, ["a"], candidates.where("id < 0"), how).count()


def test_best_without_rows(spark):
    q, c = frame(spark, np.ones((2, 2)), "q", "a"), frame(spark, np.ones((3, 2)), "c")
    assert blocks.best(q.where("a > 5"), ["a"], c, 2).count() == 0
    assert blocks.best(q, ["a"], c.where("id > 5"), 2).count() == 0
    assert blocks.best(q, ["a"], c.withColumn("c", F.when(F.col("id") == 1, F.col("c"))), 5).select("id").distinct().count() == 1


def test_places_and_running_sums(spark):
    rows = [(i % 7, i, float(i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, k int, v double").repartition(6)
    got = ordinals.numbered(df, ["g", "k"], start=10).collect()
    assert [(r.g, r.k) for r in sorted(got, key=lambda r: r.id)] == sorted(r[:2] for r in rows) and {r.id for r in got} == set(range(10, 1010))
    total, want = 0.0, {}
    for g, k, v in sorted(rows):
        total += v
        want[k] = total
    assert {r.k: r.s for r in ordinals.running(df, ["g", "k"], "v", "s").collect()} == want
    assert ordinals.numbered(df.where("k < 0"), ["k"]).count() == 0


def test_many_entities_do_not_share_draws(spark):
    """Numbers beyond the generator's modulus neither overflow nor meet small ones."""
    from stratagraph.functions.columns import uniform

    ids = [*range(50), *(2**31 + i for i in range(50)), *(10**12 + i for i in range(50)), 3 * 10**17]
    u = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(uniform(F.col("i"))).collect()]
    assert len(set(u)) == len(ids) and all(0 <= x < 1 for x in u)


def test_projection(spark):
    """Moments over partitions, the solution and one step of descent equal numpy's; a feature that never varies does no harm."""
    f, w = np.column_stack([R.normal(size=(300, 4)), np.full(300, 2.0)]), R.normal(size=(6, 3))
    y = np.column_stack([np.ones(300), f]) @ w + 0.01 * R.normal(size=(300, 3))
    rows = [(i, f[i].tolist(), y[i].tolist() if i % 5 else None) for i in range(300)] + [(900, None, [1.0] * 3)]
    df = spark.createDataFrame(rows, "id long, f array<double>, y array<double>").repartition(4)
    m = projection.moments(df, "f", "y")
    seen = np.arange(300) % 5 != 0
    x = np.column_stack([np.ones(240), f[seen]])
    assert m.n == 240 and np.allclose(m.gram, x.T @ x) and np.allclose(m.cross, x.T @ y[seen])
    best = projection.solved(m)
    assert np.allclose(x @ best, x @ np.linalg.lstsq(x, y[seen], rcond=None)[0], atol=1e-6)
    assert np.allclose(projection.aligned(m, 1, 0.1, 0.5), 0.1 * x.T @ y[seen] / 240)
    made = {r.id: r.y for r in projection.project(df, "f", "y", best).collect()}
    assert max(np.abs(np.array(made[i]) - y[i]).max() for i in range(0, 300, 5)) < 0.1 and made[1] == y[1].tolist()
    with pytest.raises(ValueError):
        projection.moments(df.where("id < 0"), "f", "y")


def tree(spark, n, equal):
    """Two trees of ``n`` nodes; with ``equal`` many nodes have one norm."""
    edges = [(name, f"{name}{(i - 1) // 3:03d}", f"{name}{i:03d}") for name in "ab" for i in range(1, n)]
    points = [(f"{name}{i:03d}", [float(R.choice([0.1, 0.2, 0.3])) if equal else float(R.uniform(-0.9, 0.9)), 0.0]) for name in "ab" for i in range(n)]
    return graph.closure(spark.createDataFrame(edges, "hierarchy string, parent string, child string")), points, spark.createDataFrame(points, "node string, x array<double>")


@pytest.mark.parametrize("equal", [False, True])
def test_effects_equal_all_pairs(spark, equal):
    closed, points, df = tree(spark, 40, equal)
    up = {}
    for r in closed.collect():
        up.setdefault(r.desc, set()).add(r.anc)
    size = {name: round(abs(x[0]), 6) for name, x in points}
    effects = {h: sorted((round(-max(0, 1 - abs(size[h] - size[t])), 6), t) for t in up if t != h and up[h] & up[t]) for h in up}
    got = {}
    for r in hyp.nearest_effects(closed, df, F.col("node").startswith("a"), 4).collect():
        got.setdefault(r.h, []).append((-r.ce, r.t))
    assert {h: sorted(x) for h, x in got.items()} == {h: x[:4] for h, x in effects.items() if h.startswith("a")}
    exact = {h: [1 - abs(abs(dict(points)[h][0]) - abs(dict(points)[t][0])) for _, t in x] for h, x in effects.items()}
    sums = {r.node: r for r in hyp.effect_sums(closed, df).collect()}
    assert sums.keys() == exact.keys()
    for h, x in exact.items():
        assert (sums[h].pairs, sums[h].effects, sums[h].squares, sums[h].most) == (len(x), pytest.approx(sum(x)), pytest.approx(sum(v * v for v in x)), pytest.approx(max(x)))


def test_path_of_a_hundred_nodes(spark):
    """Paths of any length: a chain of 100 nodes both ways, with a shortcut that many edges beat."""
    rows = [(i, i + 1, 2.0) for i in range(99)] + [(0, 99, 1 / 60)]
    edges = spark.createDataFrame([("s", f"{a:03d}", f"{b:03d}", w) for a, b, w in rows] + [("s", f"{b:03d}", f"{a:03d}", w) for a, b, w in rows], "season string, src string, dst string, w double")
    d = {(int(r.src), int(r.dst)): r.d for r in graph.shortest_paths(edges).collect()}
    assert len(d) == 9900 and all(x == pytest.approx(abs(a - b) / 2) for (a, b), x in d.items())
    assert graph.shortest_paths(edges.where("w > 5")).count() == 0


def test_margin_loss_over_blocks(spark):
    q, c = R.normal(size=(3, 4)), R.normal(size=(20, 4))
    facts = [(h, 0, t, 0) for h in range(3) for t in (1, 5)]
    queries = spark.createDataFrame([(h, 0, 0, q[h].tolist()) for h in range(3)], "h int, r int, tau int, q array<double>")
    s = np.round(q @ c.T, 6)
    want = np.mean([max(0, 1 + s[h, o] - s[h, t]) for h, _, t, _ in facts for o in range(20) if o != t])
    got = kg.all_margin_loss(spark.createDataFrame(facts * 2, "h int, r int, t int, tau int"), queries, frame(spark, c, "c")).first()
    assert got.loss == pytest.approx(want, abs=1e-6)


def test_cells_grow_with_rows_not_with_partitions(spark):
    """Few rows in many partitions are one block and one task."""
    queries, candidates = frame(spark, R.normal(size=(60, 3)), "q", "a").repartition(30), frame(spark, R.normal(size=(50, 3)), "c").repartition(20)
    cells = blocks._cells(queries, ["a"], candidates)
    assert cells.rdd.getNumPartitions() == 1 and cells.count() == 1


def test_gathered_vectors_multiply_no_partitions(spark, tmp_path):
    """Vectors that lie in many files make no more partitions of the queries that heads, relations and times are multiplied to."""
    import os

    from stratagraph.plans import graphs

    for f in os.listdir("/root/testdata/sf0.001"):
        if f != "embeddings.parquet":
            os.symlink(f"/root/testdata/sf0.001/{f}", tmp_path / f)
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(9).write.parquet(str(tmp_path / "embeddings.parquet"))
    g = graphs.Vectors(spark, str(tmp_path))
    assert g.queries("tcomplex", g.nations).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("how", ["dot", "l1", "l2"])
def test_kept_over_blocks(how):
    """The best of several blocks in turn, with ties, values that are no numbers, and scores that differ by less than rounding."""
    q, c = R.normal(size=(20, 5)), R.normal(size=(900, 5)).round(1)
    c[100:140], c[700], c[300] = c[3], np.nan, c[5] + 1e-9
    want = np.round(pairwise(q, c, how), 6)
    want[np.isnan(want)] = -np.inf
    kept = None
    for at in (0, 4, 300, 600):
        to = {0: 4, 4: 300, 300: 600, 600: 900}[at]
        kept = blocks._kept(q, c[at:to], np.arange(at, to), how, 12, 6, kept)
    order = np.lexsort((np.broadcast_to(np.arange(900), want.shape), -want), axis=1)[:, :12]
    assert (kept[0] == order).all() and np.allclose(kept[1], np.take_along_axis(want, order, 1), atol=1.1e-6)


def test_effects_of_every_node(spark):
    """Not suppliers alone: each node of the trees that shares an ancestor with another has effects."""
    from stratagraph.plans import graphs

    d = "/root/testdata/sf0.001"
    closed = graph.closure(graphs.tree_edges(spark, d))
    asked = {r.h for r in graphs.near_pairs(spark, d, closed, graphs.points(spark, d)).select("h").distinct().collect()}
    assert asked == {r.desc for r in closed.select("desc").distinct().collect()}
