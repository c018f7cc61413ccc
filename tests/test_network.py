"""Network measures: invariants, the demonstration network, and small cases by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.operators import graph, network as net
from stratagraph.sources import synth

S = synth.SEASONS


@pytest.fixture(scope="module")
def demo(spark):
    d = synth.generate(spark)
    edges = net.supra_edges(d.rules).cache()
    return d, d.nodes.cache(), edges


def dense(edges, nodes, season):
    names = sorted(r.node for r in nodes.collect())
    at = {x: i for i, x in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for r in edges.where(f"season = '{season}'").collect():
        a[at[r.src], at[r.dst]] = r.w
    return names, a


def test_sizes(demo):
    d, nodes, _ = demo
    assert nodes.count() == 63
    assert d.rules.where("prio = 2").select("a", "b").distinct().count() >= 26
    assert d.rules.where("prio IN (5, 7)").select("a", "b").distinct().count() == 270


def test_symmetric_without_loops(demo):
    _, nodes, edges = demo
    _, a = dense(edges, nodes, "summer")
    assert (a == a.T).all() and (np.diag(a) == 0).all()


def test_last_rule_wins(spark):
    rules = spark.createDataFrame([("s", "a", "b", 0.9, 5), ("s", "a", "b", 0.2, 7), ("s", "a", "c", 0.3, 1)], "season string, a string, b string, w double, prio int")
    assert {(r.a, r.b): r.w for r in net.last_write_wins(rules).collect()} == {("a", "b"): 0.2, ("a", "c"): 0.3}


def test_measures_match_numpy(demo):
    _, nodes, edges = demo
    names, a = dense(edges, nodes, "spring")
    n = len(names)
    deg = {r.node: r.degree for r in net.degree_centrality(edges, nodes, n, S).where("season = 'spring'").collect()}
    assert all(abs(deg[x] - a[i].sum() / (n - 1)) < 1e-4 for i, x in enumerate(names))
    assert abs(net.weighted_density(edges, n).where("season = 'spring'").first().density - a.sum() / 2 / (n * (n - 1) / 2)) < 1e-9
    x = np.full(n, 1 / n)
    for _ in range(20):
        x = a @ x
        x /= x.sum() + 1e-12
    got = {r.node: r.eigenvector for r in graph.eigenvector_centrality(edges, nodes, n, S).where("season = 'spring'").collect()}
    assert all(abs(got[k] - x[i]) < 2e-6 for i, k in enumerate(names))
    assert abs(sum(got.values()) - 1) < 1e-4


def test_paths_and_betweenness(demo):
    _, nodes, edges = demo
    names, a = dense(edges, nodes, "winter")
    n = len(names)
    with np.errstate(divide="ignore"):
        d = np.where(a > 0, 1 / a, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    one = edges.where("season = 'winter'")
    paths = graph.shortest_paths(one)
    got = {(r.src, r.dst): r.d for r in paths.collect()}
    want = {(names[i], names[j]): d[i, j] for i in range(n) for j in range(n) if i != j and np.isfinite(d[i, j])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    count = {v: 0 for v in names}
    for v in range(n):
        for s in range(n):
            for t in range(n):
                if s != t and v not in (s, t) and np.isfinite(d[s, v] + d[v, t] + d[s, t]) and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-6:
                    count[names[v]] += 1
    ours = {r.node: r.betweenness for r in graph.path_betweenness(paths, nodes, n, ["winter"]).collect()}
    assert all(abs(ours[v] - count[v] / ((n - 1) * (n - 2))) < 1e-6 for v in names)


def move_gain(a, home, x, c):
    """What modularity gains if node x alone goes to community c."""
    k, m = a.sum(1), a.sum() / 2
    value = lambda c: a[x, home == c].sum() / m - (k[home == c].sum() - (k[x] if home[x] == c else 0)) * k[x] / (2 * m * m)
    return value(c) - value(home[x])


def in_order(a):
    """Modularity after moves one by one in node order; a move must gain over leaving, not over staying."""
    k, m, home = a.sum(1), a.sum() / 2, np.arange(len(a))
    for _ in range(50):
        before = home.copy()
        for x in range(len(a)):
            best, most = home[x], 1e-15
            rest = np.arange(len(a)) != x
            for c in sorted(set(home[(a[x] > 0) & rest]) - {home[x]}):
                gain = a[x, home == c].sum() / m - k[(home == c) & rest].sum() * k[x] / (2 * m * m)
                if gain > most:
                    best, most = c, gain
            home[x] = best
        if (before == home).all():
            break
    return sum(a[np.ix_(home == c, home == c)].sum() / (2 * m) - (k[home == c].sum() / (2 * m)) ** 2 for c in set(home))


def test_communities(demo):
    _, nodes, edges = demo
    two = edges.where("season IN ('spring', 'winter')")
    groups = graph.communities(two, nodes, ["spring", "winter"]).cache()
    assert groups.count() == groups.select("season", "node").distinct().count() == 63 * 2
    q = {r.season: r.modularity for r in net.modularity(two, groups).collect()}
    for season in ("spring", "winter"):
        names, a = dense(edges, nodes, season)
        found = {r.node: r.community for r in groups.where(F.col("season") == season).collect()}
        home = np.array([found[x] for x in names])
        assert set(home) == set(range(len(set(home))))
        assert q[season] >= 0.98 * in_order(a)
        assert all(move_gain(a, home, x, c) < 1e-9 for x in range(len(names)) for c in set(home[a[x] > 0]))


def test_communities_of_small_cases(spark):
    pairs = [(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "d", "e"), (1, "e", "f"), (1, "d", "f"), (1, "c", "d"), (1, "a", "a")]
    star = [(2, "a", f"l{i:02}") for i in range(40)]
    e = spark.createDataFrame([(s, *p, 1.0) for s, x, y in pairs + star for p in {(x, y), (y, x)}], "season int, src string, dst string, w double")
    nodes = spark.createDataFrame([(x,) for x in [*"abcdefg", *(f"l{i:02}" for i in range(40))]], "node string")
    for parts in (1, 5):
        rows = graph.communities(e.repartition(parts), nodes, [1, 2, 3]).collect()
        at = {s: {r.node: r.community for r in rows if r.season == s} for s in (1, 2, 3)}
        assert at[1]["a"] == at[1]["b"] == at[1]["c"] != at[1]["d"] == at[1]["e"] == at[1]["f"] and len(set(at[1].values())) == 43
        assert len({at[2][f"l{i:02}"] for i in range(40)} | {at[2]["a"]}) == 1 and len(set(at[2].values())) == 7
        assert sorted(at[3].values()) == list(range(47))


def test_jaccard_and_blocks(demo):
    _, nodes, edges = demo
    assert net.block(edges, "b", "t").where("src LIKE 't:%'").count() == 0
    with pytest.raises(ValueError):
        net.block(edges, "b", "x")


def test_modularity_without_edges(spark):
    e = spark.createDataFrame([], "season int, src string, dst string, w double")
    g = spark.createDataFrame([(1, "a", 0)], "season int, node string, community int")
    assert net.modularity(e, g).count() == 0
