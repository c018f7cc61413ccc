"""Iterative graph operators: power iteration, min-plus paths, closure, communities.

Loops write each step's table to the checkpoint folder, so plans stay short and a lost executor
costs one step. Their tables hold nodes or pairs of nodes, not the edges they came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.ordinals import numbered
from stratagraph.sources.steps import drop_written, step, written


def eigenvector_centrality(edges: DataFrame, nodes: DataFrame, n: int, seasons, iterations: int = 20, every: int = 5) -> DataFrame:
    """Power iteration from the uniform vector, normalised to sum 1 after every few steps: scaling commutes with a step."""
    x = nodes.select("node", F.explode(F.array(*map(F.lit, seasons))).alias("season"), F.lit(1.0 / n).alias("x"))
    e = step(edges.select("season", F.col("src").alias("node"), "dst", "w"))
    for i in range(iterations):
        x = e.join(x, ["season", "node"]).groupBy("season", F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        if i % every == every - 1 or i == iterations - 1:
            x = step(x)
            total = x.groupBy("season").agg(F.sum("x").alias("t"))
            x = x.join(total, "season").select("node", "season", (F.col("x") / (F.col("t") + 1e-12)).alias("x"))
    return nodes.select("node", F.explode(F.array(*map(F.lit, seasons))).alias("season")).join(x, ["node", "season"], "left").select("season", "node", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("eigenvector"))


def shortest_paths(edges: DataFrame) -> DataFrame:
    """``season, src, dst, d``: least sums of 1/w over paths of any length.

    Each round joins the pairs that became shorter in the last one with all pairs, on both sides, so the edges of a
    path double; it ends when no pair became shorter. Weights are positive.
    """
    keys = ["season", "src", "dst"]
    d = step(edges.where("src <> dst").groupBy(*keys).agg(F.min(1 / F.col("w")).alias("d")))
    fresh = d
    while not fresh.isEmpty():
        left = lambda x: x.select("season", "src", F.col("dst").alias("mid"), F.col("d").alias("d1"))
        right = lambda x: x.select("season", F.col("src").alias("mid"), "dst", F.col("d").alias("d2"))
        meet = lambda a, b: left(a).join(right(b), ["season", "mid"]).where("src <> dst").select(*keys, (F.col("d1") + F.col("d2")).alias("d"))
        longer = meet(fresh, d) if fresh is d else meet(fresh, d).unionByName(meet(d, fresh))
        longer = longer.groupBy(*keys).agg(F.min("d").alias("new"))
        both = step(d.join(longer, keys, "full").select(*keys, F.least("d", "new").alias("d"), F.coalesce(F.col("new") < F.col("d") * (1 - 1e-12), F.col("d").isNull()).alias("shorter")))
        # sums of the same edges in another order differ in their last digits and are no news
        d, fresh = both.select(*keys, "d"), both.where("shorter").select(*keys, "d")
    return d


def path_betweenness(paths: DataFrame, nodes: DataFrame, n: int, seasons) -> DataFrame:
    """Share of ordered pairs with a shortest path through a node."""
    sv = paths.select("season", F.col("src").alias("s"), F.col("dst").alias("v"), F.col("d").alias("d1"))
    vt = paths.select("season", F.col("src").alias("v"), F.col("dst").alias("t"), F.col("d").alias("d2"))
    st = paths.select("season", F.col("src").alias("s"), F.col("dst").alias("t"), F.col("d").alias("d"))
    hits = sv.join(vt, ["season", "v"]).where("s <> t").join(st, ["season", "s", "t"]).where(F.abs(F.col("d1") + F.col("d2") - F.col("d")) < 1e-6)
    count = hits.groupBy("season", F.col("v").alias("node")).agg(F.count("*").alias("c"))
    every = nodes.select("node", F.explode(F.array(*map(F.lit, seasons))).alias("season"))
    return every.join(count, ["season", "node"], "left").select("season", "node", F.round(F.coalesce("c", F.lit(0)) / max((n - 1) * (n - 2), 1), 6).alias("betweenness"))


def closure(edges: DataFrame, by: str = "hierarchy", most: int = 64) -> DataFrame:
    """Transitive closure ``by, anc, desc`` of ``by, parent, child``, by doubling; a node is not its own ancestor."""
    found = step(edges.select(by, F.col("parent").alias("anc"), F.col("child").alias("desc")).where("anc <> desc").distinct())
    size = found.count()
    for _ in range(most):
        longer = found.withColumnRenamed("desc", "mid").join(found.withColumnRenamed("anc", "mid"), [by, "mid"]).where("anc <> desc").select(by, "anc", "desc")
        found = step(found.unionByName(longer).distinct())
        new = found.count()
        if new == size:
            break
        size = new
    return found


def communities(edges: DataFrame, nodes: DataFrame, seasons, gamma: float = 1.0) -> DataFrame:
    """Communities by single-level modularity moves of many nodes at once, until no node gains by one; numbered from 0 in a season.

    Each node asks for the community, of those its neighbours are in, that gains it most over staying (ties: the first
    by name). The best request that touches a community decides whether nodes leave or enter it in this round. Moves
    out of or into one community then take at most gamma k k' / 2m² for each pair of movers from each other's gains; a
    node goes if its gain exceeds its half of that over all who ask. Where nobody's does, those go whose request is the
    best of their target and of their source: each community has one mover then, and gains add up. So every round
    raises modularity, the loop ends, and no node could gain by a move after it.

    Weights count to ten decimal places and are added exactly, so the result doesn't depend on partitioning. Edges are
    symmetric, one row a direction; loops are left out. Nodes without edges are communities of their own.
    """
    e = written(edges.where("src <> dst").select("season", "src", "dst", "w"))
    k = e.groupBy("season", F.col("src").alias("node")).agg(_exact("w", "k"))
    m = k.groupBy("season").agg(_exact("k", "k2")).select("season", (F.col("k2") / 2).alias("m"))
    at = written(k.join(m, "season").where("k > 0").select("season", "node", "k", "m", F.col("node").alias("home")))
    while True:
        ask = written(_requests(e, at, gamma))
        if ask.isEmpty():
            break
        marked = written(_marked(ask, gamma))
        some = marked.groupBy("season").agg(F.max("free").alias("some"))
        goes = marked.join(some, "season").where("free OR (NOT some AND alone)").select("season", "node", F.col("to").alias("new"))
        before = at
        at = written(at.join(goes, ["season", "node"], "left").select("season", "node", "k", "m", F.coalesce("new", "home").alias("home")))
        drop_written(before, ask, marked)
    drop_written(e, ask)
    every = nodes.select("node", F.explode(F.array(*map(F.lit, seasons))).alias("season"))
    named = every.join(at.select("season", "node", "home"), ["season", "node"], "left").withColumn("home", F.coalesce("home", "node"))
    placed = numbered(named.select("season", "home").distinct(), ["season", "home"], "place")
    start = placed.groupBy("season").agg(F.min("place").alias("start"))
    numbers = placed.join(start, "season").select("season", "home", (F.col("place") - F.col("start")).cast("int").alias("community"))
    return named.join(numbers, ["season", "home"]).select("season", "node", "community")


def _exact(value: str, name: str):
    """A sum that no order of its rows changes."""
    return F.sum(F.col(value).cast("decimal(28,10)")).cast("double").alias(name)


def _requests(e: DataFrame, at: DataFrame, gamma: float) -> DataFrame:
    """``season, node, k, m, home, to, delta``: nodes that gain ``delta`` if they alone go to ``to``."""
    own = at.select("season", "node", F.col("home").alias("to"), F.lit(0.0).alias("w"))
    near = e.join(at.select("season", F.col("node").alias("dst"), F.col("home").alias("to")), ["season", "dst"]).select("season", F.col("src").alias("node"), "to", "w")
    into = near.unionByName(own).groupBy("season", "node", "to").agg(_exact("w", "w"))
    total = at.groupBy("season", F.col("home").alias("to")).agg(_exact("k", "total"))
    each = into.join(at, ["season", "node"]).join(total, ["season", "to"])
    stays = F.col("to") == F.col("home")
    others = F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)
    each = each.withColumn("gain", F.col("w") / F.col("m") - gamma * others * F.col("k") / (2 * F.col("m") * F.col("m")))
    found = each.groupBy("season", "node", "k", "m", "home").agg(
        F.max(F.when(stays, F.col("gain"))).alias("stay"), F.min(F.when(~stays, F.struct((-F.col("gain")).alias("loss"), "to"))).alias("best"))
    return found.select("season", "node", "k", "m", "home", F.col("best.to").alias("to"), (-F.col("best.loss") - F.col("stay")).alias("delta")).where("delta > 1e-12")


def _marked(ask: DataFrame, gamma: float) -> DataFrame:
    """``season, node, to, free, alone``: the requests a round allows; the free ones, or else those alone, together raise modularity."""
    ask = ask.withColumn("place", F.struct((-F.col("delta")).alias("loss"), "node"))
    sides = [ask.select("season", F.col(c).alias("c"), "place", F.lit(c).alias("side")) for c in ("home", "to")]
    role = sides[0].unionByName(sides[1]).groupBy("season", "c").agg(F.min(F.struct("place", "side")).alias("first")).select("season", "c", "first.side")
    for c in ("home", "to"):
        ask = ask.join(role.where(F.col("side") == c).select("season", F.col("c").alias(c)), ["season", c], "left_semi")
    for c in ("home", "to"):
        ask = ask.join(ask.groupBy("season", c).agg(_exact("k", f"{c}_k"), F.min("place").alias(f"{c}_first")), ["season", c])
    others = F.col("home_k") + F.col("to_k") - 2 * F.col("k")
    ask = ask.withColumn("free", F.col("delta") > gamma * F.col("k") * others / (4 * F.col("m") * F.col("m")))
    alone = (F.col("home_first") == F.col("place")) & (F.col("to_first") == F.col("place"))
    return ask.withColumn("alone", alone).select("season", "node", "to", "free", "alone")
