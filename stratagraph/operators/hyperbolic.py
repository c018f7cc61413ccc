"""Hierarchies in the Poincare ball: distances, effects along shared ancestors, ordering losses, counterfactuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.functions.columns import dot, norm, sub, uniform
from stratagraph.operators import ordinals
from stratagraph.sources.steps import step

EPS = 1e-5


def project(x: Column) -> Column:
    """A point outside the open unit ball is drawn just inside."""
    n = norm(x)
    return F.when(n >= 1, F.transform(x, lambda v: v / (n + EPS) * (1 - EPS))).otherwise(x)


def distance(x: Column, y: Column) -> Column:
    d = sub(x, y)
    return F.acosh(1 + 2 * dot(d, d) / ((1 - dot(x, x)) * (1 - dot(y, y)) + 1e-12))


def sharing(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Those of the pairs ``h, t`` that have an ancestor in common in some hierarchy. A pair meets its own ancestors only."""
    up = closed.select("hierarchy", "anc", "desc")
    both = pairs.select("h", "t").distinct().join(up.withColumnRenamed("desc", "h"), "h").join(up.withColumnRenamed("desc", "t"), ["hierarchy", "anc", "t"])
    return both.where("h <> t").select("h", "t").distinct()


def nearest_effects(closed: DataFrame, points: DataFrame, asked: Column, k: int, digits: int = 6) -> DataFrame:
    """``h, t, ce``: the k largest effects of every asked ``node`` with nodes that share an ancestor with it, equal ones by name.

    Below every ancestor nodes are put in order of their norms, rounded to ``digits``. The k nearest of a node are among the k
    places from its own norm on, and the k before it, so rows are 2k for each pair of a node and an ancestor of it, and
    pairs of nodes are never written.
    """
    group = ["hierarchy", "anc"]
    size = F.round(norm(F.col("x")), digits)
    below = closed.join(points.select(F.col("node").alias("desc"), size.alias("n")), "desc").select(*group, F.col("desc").alias("node"), "n")
    near = []
    for sign in (1.0, -1.0):
        # equal norms by name in both directions
        placed = ordinals.numbered(below.withColumn("at", F.col("n") * sign), [*group, "at", "node"], "place")
        first = placed.groupBy(*group, "at").agg(F.min("place").alias("from"))
        asks = placed.where(asked).join(first, [*group, "at"]).select(*group, F.col("node").alias("h"), F.col("n").alias("nh"), F.explode(F.sequence(F.col("from"), F.col("from") + k)).alias("place"))
        met = asks.join(placed.select(*group, "place", F.col("node").alias("t"), F.col("n").alias("nt")), [*group, "place"])
        near.append(met.where("h <> t").select("h", "t", F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("nh") - F.col("nt"))), digits).alias("ce")))
    order = W.partitionBy("h").orderBy(F.desc("ce"), "t")
    found = near[0].unionByName(near[1]).distinct()
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def effect_sums(closed: DataFrame, points: DataFrame) -> DataFrame:
    """For every node ``node, pairs, effects, squares, most``: how many nodes share its tree's topmost ancestor, and the sum, the
    sum of squares and the largest of its effects with them. Norms are below 1, as in the ball, so every effect is positive.

    Sums over differences of norms come from running sums in order of the norms. A hierarchy is a forest: a node has one topmost ancestor.
    """
    group = ["hierarchy", "anc"]
    top = closed.join(closed.select("hierarchy", F.col("desc").alias("anc")).distinct(), group, "left_anti")
    rows = top.join(points.select(F.col("node").alias("desc"), norm(F.col("x")).alias("n")), "desc").select(*group, F.col("desc").alias("node"), "n")
    order = [*group, "n", "node"]
    placed = step(ordinals.running(ordinals.numbered(rows, order, "place"), order, "n", "upto"))
    whole = placed.groupBy(*group).agg(F.min("place").alias("first"), F.count("*").alias("m"), F.sum("n").alias("sum"), F.sum(F.col("n") * F.col("n")).alias("sum2"), F.min_by(F.col("upto") - F.col("n"), "place").alias("before"))
    near = placed.select(*group, F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"), F.col("n").alias("other"))
    gap = placed.join(near, [*group, "place"], "left").groupBy(*group, "place", "node", "n", "upto").agg(F.min(F.abs(F.col("n") - F.col("other"))).alias("gap"))
    rows = gap.join(whole, group)
    below, above = F.col("place") - F.col("first"), F.col("first") + F.col("m") - 1 - F.col("place")
    under = F.col("upto") - F.col("n") - F.col("before")
    over = F.col("sum") - under - F.col("n")
    apart = F.col("n") * below - under + over - F.col("n") * above
    apart2 = F.col("m") * F.col("n") * F.col("n") - 2 * F.col("n") * F.col("sum") + F.col("sum2")
    pairs = F.col("m") - 1
    return rows.where("m > 1").select("node", pairs.alias("pairs"), (pairs - apart).alias("effects"), (pairs - 2 * apart + apart2).alias("squares"), (1 - F.col("gap")).alias("most"))


def causal_effect(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """``h, t, ce``: 1 less the difference of norms, not under 0, for pairs that share an ancestor."""
    size = points.select("node", norm(F.col("x")).alias("n"))
    both = pairs.join(size.select(F.col("node").alias("h"), F.col("n").alias("nh")), "h").join(size.select(F.col("node").alias("t"), F.col("n").alias("nt")), "t")
    return both.select("h", "t", F.greatest(F.lit(0.0), 1 - F.abs(F.col("nh") - F.col("nt"))).alias("ce"))


def closure_norms(closed: DataFrame, points: DataFrame) -> DataFrame:
    size = points.select("node", norm(F.col("x")).alias("n"))
    return closed.join(size.select(F.col("node").alias("anc"), F.col("n").alias("na")), "anc").join(size.select(F.col("node").alias("desc"), F.col("n").alias("nd")), "desc")


def ordering_loss(closed: DataFrame, points: DataFrame, margin: float = 0.1) -> DataFrame:
    """Mean hinge by hierarchy: ancestors lie nearer the origin than their descendants."""
    return closure_norms(closed, points).groupBy("hierarchy").agg(F.avg(F.greatest(F.lit(0.0), F.col("na") - F.col("nd") + margin)).alias("loss"))


def weighted_loss(closed: DataFrame, points: DataFrame, weights: dict[str, float], margin: float = 0.1) -> DataFrame:
    """``loss``: the ordering losses of the named hierarchies by weight, summed; weights of 0 or less and absent hierarchies add nothing."""
    used = {k: w for k, w in weights.items() if w > 0}
    share = F.lit(0.0)
    for name, w in used.items():
        share = F.when(F.col("hierarchy") == name, F.lit(float(w))).otherwise(share)
    losses = ordering_loss(closed, points, margin)
    return losses.agg(F.coalesce(F.sum(share * F.col("loss")), F.lit(0.0)).alias("loss"))


def ordering_validity(closed: DataFrame, points: DataFrame) -> DataFrame:
    """By hierarchy: the share of pairs in order, how far these are apart, the least norm of an ancestor, the largest of a descendant, and the pairs."""
    ok = F.col("na") < F.col("nd")
    return closure_norms(closed, points).groupBy("hierarchy").agg(F.avg(ok.cast("double")).alias("valid"), F.avg(F.when(ok, F.col("nd") - F.col("na"))).alias("mean_gap"), F.min("na").alias("least_norm"), F.max("nd").alias("most_norm"), F.count("*").alias("n"))


def shifted(points: DataFrame, closed: DataFrame, node: str, delta: list[float], decay: float = 0.5) -> DataFrame:
    """Points after an intervention at a node: it moves by delta, each descendant by a share that falls with distance."""
    move = F.array(*map(F.lit, delta))
    plus = lambda x, f: F.zip_with(x, move, lambda a, b: a + f * b)
    origin = points.where(F.col("node") == node).select(project(plus(F.col("x"), F.lit(1.0))).alias("o"))
    below = closed.where(F.col("anc") == node).select(F.col("desc").alias("node")).distinct().withColumn("below", F.lit(True))
    rows = points.join(below, "node", "left").crossJoin(origin)
    return rows.select("node", F.when(F.col("node") == node, F.col("o")).when(F.col("below"), project(plus(F.col("x"), decay * F.exp(-distance(F.col("o"), F.col("x")))))).otherwise(F.col("x")).alias("x"))


def counterfactual(scores: DataFrame, pairs: DataFrame, points: DataFrame, after: DataFrame, beta: float, faithful: bool = False) -> DataFrame:
    """Score with the effect before and after an intervention, and the difference; ``faithful`` leaves the effect as it was."""
    before = causal_effect(pairs, points)
    new = before if faithful else causal_effect(pairs, after)
    both = scores.join(before.withColumnRenamed("ce", "ce0"), ["h", "t"], "left").join(new.withColumnRenamed("ce", "ce1"), ["h", "t"], "left")
    return both.select("h", "t", (F.col("score") + beta * F.coalesce("ce0", F.lit(0.0))).alias("factual"), (F.col("score") + beta * F.coalesce("ce1", F.lit(0.0))).alias("counterfactual")).withColumn("delta", F.col("counterfactual") - F.col("factual"))


def norm_factors(closed: DataFrame, points: DataFrame, weights: dict[str, float], margin: float = 0.1, rate: float = 0.005, share: float = 1.0, draw: int = 0) -> DataFrame:
    """``node, factor``: how one round of the update scales nodes. Pairs that break the order by norms move fully, others a tenth.

    An ancestor is drawn in, a descendant pushed out. What several pairs ask of a node is multiplied, and held between a half and
    two. ``share`` of the pairs is drawn, by a hash of their names and ``draw``. Hierarchies of no positive weight move nothing.
    """
    used = [k for k, w in weights.items() if w > 0]
    pairs = closure_norms(closed.where(F.col("hierarchy").isin(used)), points)
    if share < 1:
        pairs = pairs.where(uniform(F.pmod(F.xxhash64(F.lit(draw), "hierarchy", "anc", "desc"), F.lit(1 << 30))) < share)
    by = F.when(F.col("na") >= F.col("nd") - margin, F.lit(rate)).otherwise(rate / 10)
    moves = F.array(F.struct(F.col("anc").alias("node"), F.log(1 - by).alias("f")), F.struct(F.col("desc").alias("node"), F.log(1 + by).alias("f")))
    sums = pairs.select(F.explode(moves).alias("m")).groupBy("m.node").agg(F.sum("m.f").alias("f"))
    return sums.select("node", F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.exp("f"))).alias("factor"))


def scaled(points: DataFrame, factors: DataFrame) -> DataFrame:
    """Points times their factors, held in the ball; points without a factor stay."""
    rows = points.join(factors, "node", "left")
    return rows.select("node", F.when(F.col("factor").isNull(), F.col("x")).otherwise(project(F.transform("x", lambda v: v * F.col("factor")))).alias("x"))


def fit_norms(closed: DataFrame, points: DataFrame, weights: dict[str, float], rounds: int, margin: float = 0.1, rate: float = 0.005, share: float = 1.0, enough: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """Points after up to ``rounds`` rounds that each lower the weighted ordering loss, and the losses, the first before any.

    A round that does not lower the loss is taken back and tried at half the rate; the loop ends when the loss falls by less than
    ``enough``, when the rate is under a thousandth of the first, or after ``rounds`` tries. Every round is checkpointed.
    """
    loss = lambda pts: weighted_loss(closed, pts, weights, margin).first().loss
    closed, now = step(closed), step(points)
    losses, least = [loss(now)], rate / 1000
    for draw in range(rounds):
        if losses[-1] <= 0 or rate < least:
            break
        after = step(scaled(now, norm_factors(closed, now, weights, margin, rate, share, draw)))
        found = loss(after)
        if found >= losses[-1]:
            rate /= 2
            continue
        now, fell = after, losses[-1] - found
        losses.append(found)
        if fell < enough:
            break
    return now, losses
