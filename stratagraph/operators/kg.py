"""Temporal knowledge graphs: facts with validity intervals, dictionary encoding, ranking and recommendation.

Facts are ``h, r, t, tb, te`` (strings, nullable whole numbers); quads are ``h, r, t, tau`` as a bag.
Dictionaries and candidate sets are joined by key without a hint: they are broadcast only while
their measured size is under the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.functions.columns import dot, sigmoid, uniform, valid_at
from stratagraph.operators import blocks, ordinals


def _numbered(names: DataFrame, start: int = 0) -> DataFrame:
    """``name, id``: distinct names by sorted name, ids as whole numbers of 32 bits from ``start``."""
    return ordinals.numbered(names.select("name").distinct(), ["name"], start=start).withColumn("id", F.col("id").cast("int"))


def entity_ids(facts: DataFrame) -> DataFrame:
    return _numbered(facts.select(F.explode(F.array("h", "t")).alias("name")))


def relation_ids(facts: DataFrame) -> DataFrame:
    return _numbered(facts.select(F.col("r").alias("name")))


def extended_ids(ids: DataFrame, more: DataFrame) -> DataFrame:
    """Names that the dictionary lacks get ids after its last one, by sorted name."""
    last = ids.agg(F.max("id")).first()[0]
    return ids.select("name", "id").unionByName(_numbered(more.select("name").join(ids, "name", "left_anti"), 0 if last is None else last + 1))


def expand_intervals(facts: DataFrame, n: int) -> DataFrame:
    """A row for each point in time at which a fact holds: undated facts always, open ends to the last point, ends clamped."""
    begin = F.when(F.col("tb").isNull() & F.col("te").isNull(), 0).otherwise(F.greatest(F.coalesce("tb", F.lit(0)), F.lit(0)))
    end = F.least(F.coalesce("te", F.lit(n - 1)), F.lit(n - 1))
    spans = facts.select("h", "r", "t", begin.alias("lo"), end.alias("hi")).where("lo <= hi")
    return spans.select("h", "r", "t", F.explode(F.sequence("lo", "hi")).alias("tau"))


def encode(quads: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Names to ids; rows with unknown names drop out, repeated rows stay."""
    for side, ids in (("h", entities), ("r", relations), ("t", entities)):
        quads = quads.join(ids.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id")), side)
    return quads.select(F.col("h_id").alias("h"), F.col("r_id").alias("r"), F.col("t_id").alias("t"), "tau")


def split_label(tau: Column, train_to: int, valid: int, test_from: int, train_from: int | None = None) -> Column:
    train = tau <= train_to if train_from is None else tau.between(train_from, train_to)
    return F.when(train, "train").when(tau == valid, "valid").when(tau >= test_from, "test")


def leave_one_out(quads: DataFrame, entity: Column | str, train_to: int) -> DataFrame:
    """Rows that touch the entity are test rows whenever they hold; others train up to ``train_to``."""
    touches = (F.col("h") == entity) | (F.col("t") == entity)
    return quads.withColumn("split", F.when(touches, "test").when(F.col("tau") <= train_to, "train")).where("split IS NOT NULL")


def interval_join(ranges: DataFrame, bands: DataFrame, width: int) -> DataFrame:
    """Pairs of closed intervals (``lo, hi``) that overlap, by bins of ``width``: an equi-join with a check, not a nested loop.

    A pair that meets in several bins is kept in the first of them.
    """
    bins = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns], F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("bin"))
    both = bins(ranges, "a").join(bins(bands, "b"), "bin")
    return both.where((F.col("a_lo") <= F.col("b_hi")) & (F.col("a_hi") >= F.col("b_lo")) & (F.col("bin") == F.floor(F.greatest("a_lo", "b_lo") / width))).drop("bin")


def deployed_at(facts: DataFrame, heads: DataFrame, relation: str, tau: int) -> DataFrame:
    """Which heads have a dated fact of the relation that holds at tau."""
    on = facts.where((F.col("r") == relation) & valid_at(F.col("tb"), F.col("te"), tau)).select("h").distinct().withColumn("deployed", F.lit(True))
    return heads.join(on, "h", "left").select("h", F.coalesce("deployed", F.lit(False)).alias("deployed"))


def tail_counts(quads: DataFrame, entities: DataFrame) -> DataFrame:
    count = quads.groupBy(F.col("t").alias("id")).agg(F.count("*").alias("n"))
    return entities.join(count, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def negative_probabilities(quads: DataFrame, entities: DataFrame) -> DataFrame:
    """Smoothed sampling probabilities of tails: (count + 1)**0.75 over the sum."""
    w = tail_counts(quads, entities).withColumn("w", F.pow(F.col("n") + 1, 0.75))
    return w.crossJoin(w.agg(F.sum("w").alias("total"))).select("id", "n", (F.col("w") / F.col("total")).alias("p"))


def negative_samples(positives: DataFrame, probabilities: DataFrame, per_positive: int, bins: int = 1024) -> DataFrame:
    """Tails drawn for each positive (``pos_id``) by inverting the cumulative probabilities at hash-uniform points.

    A tail owns the interval between its predecessor's cumulative probability and its own; points meet
    their interval in bins of the unit line, an equi-join with a check.
    """
    owned = ordinals.running(probabilities.select("id", "p"), ["id"], "p", "hi").select("id", (F.col("hi") - F.col("p")).alias("lo"), "hi")
    owned = owned.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.floor(F.col("hi") * bins))))
    draws = positives.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1)))).withColumn("u", uniform(F.col("pos_id") * per_positive + F.col("j")))
    met = draws.withColumn("bin", F.floor(F.col("u") * bins)).join(owned, "bin").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.select("pos_id", "j", F.col("id").alias("neg"))


def margin_loss(scored: DataFrame, margin: float) -> DataFrame:
    """Mean hinge of (``pos``, ``neg``) score pairs, each negative against its own positive; 0 without pairs."""
    return scored.agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), margin + F.col("neg") - F.col("pos"))), F.lit(0.0)).alias("loss"))


def decode(rows: DataFrame, ids: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds names: ``columns`` maps a column of ids to the name's column. Unknown ids get no name; their rows stay."""
    for column, name in columns.items():
        rows = rows.join(ids.select(F.col("id").alias(column), F.col("name").alias(name)), column, "left")
    return rows


def filtered_ranks(test: DataFrame, queries: DataFrame, candidates: DataFrame, known: DataFrame, how: str = "dot") -> DataFrame:
    """Rank of each test row's tail among all candidates, other known tails left out; ties count in its favour.

    ``test`` and ``known`` have ``h, r, t, tau``; ``queries`` has a vector ``q`` for each (h, r, tau), ``candidates`` (``id, c``)
    those of tails. Candidates are counted block by block; known tails, which are as many as facts, are scored one by one
    and their counts taken off. Test rows without a query's or a tail's vector are left out; repeated rows stay.
    """
    keys = ["h", "r", "tau"]
    tails = candidates.select(F.col("id").alias("t"), "c")
    score = lambda df: df.join(queries, keys).join(tails, "t").withColumn("score", F.round(blocks_score(F.col("q"), F.col("c"), how), 6) + 0.0).drop("c")
    tested = score(test.groupBy(*keys, "t").agg(F.count("*").alias("times"))).withColumnRenamed("score", "own")
    over = blocks.against_all(tested.select(*keys, "t", "q", "own"), [*keys, "t"], candidates, how)
    # of the known tails of a query, those of a better score: sums over distinct scores, best first
    by_score = score(known.select(*keys, "t").distinct()).groupBy(*keys, "score").agg(F.count("*").alias("k"), F.lit(True).alias("is_known"))
    levels = by_score.unionByName(tested.select(*keys, F.col("own").alias("score")).distinct().select("*", F.lit(0).cast("long").alias("k"), F.lit(False).alias("is_known")))
    levels = levels.groupBy(*keys, "score").agg(F.sum("k").alias("k"))
    above = W.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    better = levels.select(*keys, F.col("score").alias("own"), F.coalesce(F.sum("k").over(above), F.lit(0)).alias("known_better"))
    out = tested.drop("q").join(over.select(*keys, "t", "better"), [*keys, "t"]).join(better, [*keys, "own"])
    return out.select(*keys, "t", (1 + F.col("better") - F.col("known_better")).alias("rank"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_")).drop("_")


def blocks_score(q: Column, c: Column, how: str) -> Column:
    """The score of one pair, as ``blocks.scores`` has it."""
    if how == "dot":
        return dot(q, c)
    if how == "dot_effect":
        at = F.element_at
        effect = F.when(at(q, -2) == at(c, -2), F.greatest(F.lit(0.0), 1 - F.abs(at(q, -1) - at(c, -1)))).otherwise(0.0)
        return dot(F.slice(q, 1, F.size(q) - 3), F.slice(c, 1, F.size(c) - 2)) + at(q, -3) * effect
    return -F.aggregate(F.zip_with(q, c, lambda x, y: F.abs(x - y) if how == "l1" else (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def all_margin_loss(facts: DataFrame, queries: DataFrame, candidates: DataFrame, margin: float = 1.0, how: str = "dot") -> DataFrame:
    """Mean hinge of every distinct fact (``h, r, t, tau``) against every other candidate, summed block by block; 0 without pairs."""
    keys = ["h", "r", "tau"]
    rows = facts.select(*keys, "t").distinct().join(queries, keys).join(candidates.select(F.col("id").alias("t"), "c"), "t")
    rows = rows.select(*keys, "t", "q", (F.round(blocks_score(F.col("q"), F.col("c"), how), 6) + 0.0).alias("own"))
    sums = blocks.against_all(rows, [*keys, "t"], candidates, how, margin)
    # a fact against itself has the margin as hinge
    return sums.agg(F.coalesce(F.sum(F.col("hinge") - margin) / F.sum(F.col("n") - 1), F.lit(0.0)).alias("loss"))


def rank_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MRR, Hits@1/3/10 and mean rank; zeros without rows."""
    hits = lambda k: F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"hits{k}")
    aggs = [F.coalesce(F.avg(1 / F.col("rank")), F.lit(0.0)).alias("mrr"), hits(1), hits(3), hits(10), F.coalesce(F.avg("rank"), F.lit(0.0)).alias("mean_rank")]
    return ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)


def threat_probabilities(scores: DataFrame) -> DataFrame:
    return scores.withColumn("prob", sigmoid(F.col("score")))


def relations_present(quads: DataFrame, relations: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted relations (names) that the quads have, as ``name, id``; none of them is an empty table, not an error."""
    return relations.where(F.col("name").isin(wanted)).join(quads.select(F.col("r").alias("id")).distinct(), "id", "left_semi").select("name", "id")


def novel_links(scores: DataFrame, known: DataFrame, threshold: float, k: int) -> DataFrame:
    """Likely pairs (h, t) that the known rows lack, best first; a pair's scores at several times are averaged."""
    fresh = scores.join(known.select("h", F.col("t").alias("cand")).distinct(), ["h", "cand"], "left_anti")
    mean = fresh.groupBy("h", "cand").agg(F.avg("score").alias("score"))
    return mean.withColumn("prob", F.round(sigmoid(F.col("score")), 6)).where(F.col("prob") > threshold).orderBy(F.desc("prob"), "h", "cand").limit(k).select("h", "cand", "prob")


def recommend(scores: DataFrame, deployed: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best heads, of each group of ``by`` or of all, with whether they are deployed already."""
    by = by or []
    ranked = scores.withColumn("score", F.round("score", 6))
    if by:
        ranked = ranked.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "h"))).where(F.col("_k") <= k).drop("_k")
    else:
        ranked = ranked.orderBy(F.desc("score"), "h").limit(k)
    return ranked.join(deployed, [*by, "h"], "left").select(*by, "h", "score", F.coalesce("deployed", F.lit(False)).alias("deployed"))
