"""Operators over layered temporal networks held as edge lists.

Edges are ``season, src, dst, w`` with both directions present; a node's layer is what stands before
the colon of its name. Nothing is made dense: every measure is an aggregate by season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def layer_of(node: str | Column) -> Column:
    return F.substring_index(F.col(node) if isinstance(node, str) else node, ":", 1)


def last_write_wins(rules: DataFrame) -> DataFrame:
    """The weight of the highest prio for each season and pair; one hash aggregate, no sort."""
    return rules.groupBy("season", "a", "b").agg(F.max_by("w", "prio").alias("w"))


def symmetrise(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, without a second evaluation of the pairs."""
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select("season", "w", both.alias("x")).select("season", "x.src", "x.dst", "w")


def supra_edges(rules: DataFrame) -> DataFrame:
    return symmetrise(last_write_wins(rules))


def block(edges: DataFrame, one: str, other: str, layers=("n", "b", "t")) -> DataFrame:
    """Edges from one layer to another (or within one)."""
    for x in (one, other):
        if x not in layers:
            raise ValueError(f"unknown layer {x!r}")
    return edges.where((layer_of("src") == one) & (layer_of("dst") == other))


def all_nodes(nodes: DataFrame, seasons) -> DataFrame:
    return nodes.withColumn("season", F.explode(F.array(*map(F.lit, seasons))))


def degree_centrality(edges: DataFrame, nodes: DataFrame, n: int, seasons) -> DataFrame:
    """Weighted degree over n - 1, rounded to 4 places; nodes without edges have 0."""
    deg = edges.groupBy("season", F.col("src").alias("node")).agg((F.sum("w") / (n - 1)).alias("d"))
    return all_nodes(nodes, seasons).join(deg, ["season", "node"], "left").select("season", "layer", "node", F.round(F.coalesce("d", F.lit(0.0)), 4).alias("degree"))


def intra_layer_total(edges: DataFrame) -> DataFrame:
    """Total weight within each layer; each edge counts in both directions."""
    return edges.where(layer_of("src") == layer_of("dst")).groupBy("season", layer_of("src").alias("layer")).agg(F.sum("w").alias("total"))


def cross_layer_coupling(edges: DataFrame) -> DataFrame:
    """Weight between layers, each pair of nodes once."""
    return edges.where(layer_of("src") < layer_of("dst")).groupBy("season").agg(F.sum("w").alias("coupling"))


def weighted_density(edges: DataFrame, n: int) -> DataFrame:
    return edges.groupBy("season").agg((F.sum("w") / 2 / (n * (n - 1) / 2)).alias("density"), (F.count("*") / 2).cast("long").alias("n_edges"))


def top_k(scores: DataFrame, by: list[str], value: str, k: int, tie: str = "node") -> DataFrame:
    """The k best of each group with their rank; ties go by name."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), tie))).where(F.col("rank") <= k)


def season_summary(edges: DataFrame, degree: DataFrame, n: int, k: int = 5) -> DataFrame:
    """Edges, density, coupling, mean degree and the top nodes of each season."""
    best = top_k(degree, ["season"], "degree", k).groupBy("season").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]), ",").alias("top_nodes"))
    mean = degree.groupBy("season").agg(F.avg("degree").alias("mean_degree"))
    return weighted_density(edges, n).join(cross_layer_coupling(edges), "season").join(mean, "season").join(best, "season")


def by_maximum(scores: DataFrame, value: str, by: str = "season") -> Column:
    return F.col(value) / (F.max(value).over(W.partitionBy(by)) + 1e-12)


def risk_ranking(edges: DataFrame, degree: DataFrame, *, exposed: str = "b", source: str = "n", cover: str = "t", alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2) -> DataFrame:
    """Composite risk of the exposed layer: degree, coupling to the source layer, and lack of cover."""
    own = edges.where(layer_of("dst") == exposed).groupBy("season", F.col("dst").alias("node")).agg(
        F.sum(F.when(layer_of("src") == source, F.col("w"))).alias("coupling"), F.sum(F.when(layer_of("src") == cover, F.col("w"))).alias("cover"))
    rows = degree.where(F.col("layer") == exposed).join(own, ["season", "node"], "left").select("season", "node", "degree", F.coalesce("coupling", F.lit(0.0)).alias("coupling"), F.coalesce("cover", F.lit(0.0)).alias("cover"))
    rows = rows.select("season", "node", "degree", by_maximum(rows, "coupling").alias("coupling"), (1 - by_maximum(rows, "cover")).alias("vulnerability"))
    return rows.select("season", "node", F.round(alpha * F.col("degree") + beta * F.col("coupling") + gamma * F.col("vulnerability"), 4).alias("risk"), F.round("coupling", 6).alias("coupling"), F.round("vulnerability", 6).alias("vulnerability"))


def degree_variance(degree: DataFrame) -> DataFrame:
    return degree.groupBy("layer", "node").agg(F.round(F.var_pop("degree"), 6).alias("variance"))


def degree_dynamics(degree: DataFrame, seasons) -> DataFrame:
    """A row for each node, a column for each season."""
    return degree.groupBy("layer", "node").agg(*[F.max(F.when(F.col("season") == s, F.col("degree"))).alias(f"s{s}") for s in seasons])


def topk_jaccard(degree: DataFrame, layer: str, ks, seasons) -> DataFrame:
    """Jaccard likeness of the top k nodes of each season and the next one, the last followed by the first."""
    best = top_k(degree.where(F.col("layer") == layer), ["season"], "degree", max(ks))
    sets = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("k", "season").agg(F.collect_set("node").alias("own"))
    following = sets.select("k", (((F.col("season") - seasons[0] - 1 + len(seasons)) % len(seasons)) + seasons[0]).alias("season"), F.col("own").alias("next"))
    return sets.join(following, ["k", "season"]).select("k", "season", F.round(F.size(F.array_intersect("own", "next")) / F.size(F.array_union("own", "next")), 6).alias("jaccard"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Newman modularity of a given partition (``season, node, community``): inner weight less the expected; 0 without edges."""
    g1, g2 = groups.select("season", F.col("node").alias("src"), F.col("community").alias("c1")), groups.select("season", F.col("node").alias("dst"), F.col("community").alias("c2"))
    flow = edges.join(g1, ["season", "src"]).join(g2, ["season", "dst"])
    each = flow.groupBy("season", "c1").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inner"))
    total = each.groupBy("season").agg(F.sum("tot").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("tot") * F.col("tot")).alias("sq"))
    return total.select("season", F.when(F.col("m2") > 0, F.col("inner") / F.col("m2") - F.col("sq") / (F.col("m2") * F.col("m2"))).otherwise(0.0).alias("modularity"))


def layer_mix(groups: DataFrame) -> DataFrame:
    """Communities of each season and how many span two layers or more."""
    each = groups.groupBy("season", "community").agg(F.count_distinct(layer_of("node")).alias("layers"))
    return each.groupBy("season").agg(F.count("*").alias("n_communities"), F.count_if(F.col("layers") >= 2).alias("n_mixed"))
