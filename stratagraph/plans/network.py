"""Queries over the layered network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.columns import mapped
from stratagraph.operators import graph, network as net
from stratagraph.plans.registry import query
from stratagraph.sources import tables
from stratagraph.sources.steps import step
from stratagraph.sources.tables import EDGES_SQL, RULES_SQL, SEASONS

E = "WITH " + EDGES_SQL
LAYER = "split_part({0},':',1)"
DEGREE_SQL = EDGES_SQL + """,
deg AS (SELECT season, layer, node, round(coalesce(d,0),4) AS degree FROM (SELECT season, layer, node FROM nodes, seasons) LEFT JOIN (SELECT season, src AS node, sum(w)/((SELECT n FROM n)-1) AS d FROM e GROUP BY ALL) USING (season, node)),
coup AS (SELECT season, sum(w) AS coupling FROM e WHERE split_part(src,':',1)<split_part(dst,':',1) GROUP BY ALL),
dens AS (SELECT season, sum(w)/2/((SELECT n FROM n)*((SELECT n FROM n)-1)/2) AS density, (count(*)/2)::BIGINT AS n_edges FROM e GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY season, layer ORDER BY degree DESC, node) AS rank FROM deg)
"""
D = "WITH " + DEGREE_SQL


class Net:
    """Edges, nodes and degrees of one input; the edges are the result of one scan, read by all that follows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.nodes = tables.nodes(spark, sf_dir)
        self.n = self.nodes.count()
        self.edges = net.supra_edges(tables.edge_rules(spark, sf_dir))
        self.degree = net.degree_centrality(self.edges, self.nodes, self.n, SEASONS)


@query("WITH " + RULES_SQL + " SELECT season, a, b, w, prio FROM rules")
def edge_rules(spark, d):
    return tables.edge_rules(spark, d)


@query(E + " SELECT season, src, dst, w FROM e")
def coo_edges(spark, d):
    return Net(spark, d).edges


@query(E + " SELECT src, dst, round(avg(w),10) AS mean_w, round(max(w) FILTER (season=1),10) AS first_w FROM e GROUP BY src, dst")
def season_weight(spark, d):
    """An edge's weight over its seasons, and in the first; null where it has none there."""
    m = Net(spark, d).edges.groupBy("src", "dst").agg(F.map_from_entries(F.collect_list(F.struct("season", "w"))).alias("m"))
    return m.select("src", "dst", F.round(mapped(F.col("m")), 10).alias("mean_w"), F.round(mapped(F.col("m"), F.lit(1)), 10).alias("first_w"))


@query(E + " SELECT season, src, dst, w FROM e WHERE split_part(src,':',1)='n' AND split_part(dst,':',1)='b'")
def layer_block(spark, d):
    return net.block(Net(spark, d).edges, "n", "b")


@query("WITH " + RULES_SQL + " SELECT layer, node, idx FROM nodes")
def node_index(spark, d):
    return tables.nodes(spark, d)


@query(E + " SELECT season, split_part(src,':',1) AS layer, round(sum(w),6) AS total FROM e WHERE split_part(src,':',1)=split_part(dst,':',1) GROUP BY ALL")
def intra_total_weight(spark, d):
    return net.intra_layer_total(Net(spark, d).edges).withColumn("total", F.round("total", 6))


@query(D + " SELECT season, layer, node, degree FROM deg")
def degree_centrality(spark, d):
    return Net(spark, d).degree


@query(D + " SELECT season, round(coupling,7) AS coupling FROM coup")
def cross_layer_coupling(spark, d):
    return net.cross_layer_coupling(Net(spark, d).edges).withColumn("coupling", F.round("coupling", 7))


@query(D + " SELECT season, round(density,6) AS density, n_edges FROM dens")
def weighted_density(spark, d):
    x = Net(spark, d)
    return net.weighted_density(x.edges, x.n).withColumn("density", F.round("density", 6))


@query(D + """, best AS (SELECT season, string_agg(node, ',' ORDER BY rank) AS top_nodes FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY degree DESC, node) AS rank FROM deg) WHERE rank<=5 GROUP BY ALL)
SELECT season, round(density,6) AS density, n_edges, round(coupling,7) AS coupling, round(mean_degree,9) AS mean_degree, top_nodes FROM dens JOIN coup USING (season) JOIN (SELECT season, avg(degree) AS mean_degree FROM deg GROUP BY ALL) USING (season) JOIN best USING (season)""")
def season_summary(spark, d):
    x = Net(spark, d)
    edges = x.edges.cache()
    out = net.season_summary(edges, net.degree_centrality(edges, x.nodes, x.n, SEASONS), x.n)
    return out.select("season", F.round("density", 6).alias("density"), "n_edges", F.round("coupling", 7).alias("coupling"), F.round("mean_degree", 9).alias("mean_degree"), "top_nodes")


@query(D + " SELECT season, layer, node, degree, rank::INTEGER AS rank FROM ranked WHERE rank<=8")
def topk_nodes(spark, d):
    return net.top_k(Net(spark, d).degree, ["season", "layer"], "degree", 8)


RISK_SQL = DEGREE_SQL + """,
own AS (SELECT season, dst AS node, sum(w) FILTER (split_part(src,':',1)='n') AS coupling, sum(w) FILTER (split_part(src,':',1)='t') AS cover FROM e WHERE split_part(dst,':',1)='b' GROUP BY ALL),
filled AS (SELECT season, node, degree, coalesce(coupling,0) AS coupling, coalesce(cover,0) AS cover FROM deg LEFT JOIN own USING (season,node) WHERE layer='b'),
norm AS (SELECT season, node, degree, coupling/(max(coupling) OVER (PARTITION BY season)+1e-12) AS coupling, 1-cover/(max(cover) OVER (PARTITION BY season)+1e-12) AS vulnerability FROM filled),
risk AS (SELECT season, node, round(0.5*degree+0.3*coupling+0.2*vulnerability,4) AS risk, round(coupling,6) AS coupling, round(vulnerability,6) AS vulnerability FROM norm)
"""


@query("WITH " + RISK_SQL + " SELECT season, node, risk, coupling, vulnerability FROM risk")
def risk_ranking(spark, d):
    x = Net(spark, d)
    return net.risk_ranking(x.edges, x.degree)


@query("WITH " + RISK_SQL + " SELECT node, risk FROM risk WHERE season=2 ORDER BY risk DESC, node LIMIT 10")
def risk_top(spark, d):
    x = Net(spark, d)
    return net.risk_ranking(x.edges, x.degree).where("season = 2").orderBy(F.desc("risk"), "node").limit(10).select("node", "risk")


@query("WITH " + RISK_SQL + " SELECT node, max(risk) FILTER (season=1) AS s1, max(risk) FILTER (season=2) AS s2, max(risk) FILTER (season=3) AS s3, max(risk) FILTER (season=4) AS s4 FROM risk GROUP BY ALL")
def risk_heatmap(spark, d):
    x = Net(spark, d)
    return net.risk_ranking(x.edges, x.degree).groupBy("node").agg(*[F.max(F.when(F.col("season") == s, F.col("risk"))).alias(f"s{s}") for s in SEASONS])


@query(D + " SELECT layer, node, round(var_pop(degree),6) AS variance FROM deg GROUP BY ALL")
def degree_variance(spark, d):
    return net.degree_variance(Net(spark, d).degree)


@query(D + " SELECT layer, node, max(degree) FILTER (season=1) AS s1, max(degree) FILTER (season=2) AS s2, max(degree) FILTER (season=3) AS s3, max(degree) FILTER (season=4) AS s4 FROM deg GROUP BY ALL")
def degree_dynamics_pivot(spark, d):
    return net.degree_dynamics(Net(spark, d).degree, SEASONS)


@query(D + """, s AS (SELECT k::INTEGER AS k, season, list(node) AS own FROM ranked, (SELECT unnest([3,5,10]) AS k) WHERE layer='n' AND rank<=k GROUP BY ALL)
SELECT a.k, a.season, round(len(list_intersect(a.own,b.own))/len(list_distinct(list_concat(a.own,b.own))),6) AS jaccard FROM s a JOIN s b ON a.k=b.k AND b.season=a.season%4+1""")
def topk_jaccard(spark, d):
    return net.topk_jaccard(Net(spark, d).degree, "n", (3, 5, 10), SEASONS)


@query(D + " SELECT layer, node, degree, rank::INTEGER AS rank FROM ranked WHERE season=2 AND rank<=6")
def centrality_bars(spark, d):
    return net.top_k(Net(spark, d).degree.where("season = 2"), ["layer"], "degree", 6).select("layer", "node", "degree", "rank")


def _eigen_sql(k: int) -> str:
    sql = E + f", x0 AS (SELECT node, season, 1.0::DOUBLE/(SELECT n FROM n) AS x FROM nodes, seasons)"
    for i in range(k):
        sql += f", y{i} AS MATERIALIZED (SELECT e.season, dst AS node, sum(w*x) AS y FROM e JOIN x{i} ON e.season=x{i}.season AND e.src=x{i}.node GROUP BY ALL), x{i + 1} AS MATERIALIZED (SELECT node, season, y/(sum(y) OVER (PARTITION BY season)+1e-12) AS x FROM y{i})"
    return sql + f" SELECT season, node, round(coalesce(x,0),6) AS eigenvector FROM (SELECT season, node FROM nodes, seasons) LEFT JOIN x{k} USING (season, node)"


@query(_eigen_sql(20).replace("e AS (SELECT season, a AS src", "e AS MATERIALIZED (SELECT season, a AS src"))
def eigenvector(spark, d):
    x = Net(spark, d)
    return graph.eigenvector_centrality(step(x.edges), x.nodes, x.n, SEASONS)


PATHS_SQL = "WITH RECURSIVE " + EDGES_SQL.replace("e AS (SELECT season, a AS src", "e AS MATERIALIZED (SELECT season, a AS src") + ", d0 AS MATERIALIZED (SELECT season, src, dst, min(1/w) AS d FROM e GROUP BY ALL)" + "".join(
    f", d{i + 1} AS MATERIALIZED (SELECT season, src, dst, min(d) AS d FROM (SELECT * FROM d{i} UNION ALL SELECT x.season, x.src, y.dst, x.d+y.d FROM d{i} x JOIN d{i} y ON x.season=y.season AND x.dst=y.src WHERE x.src<>y.dst) GROUP BY ALL)" for i in range(6))


@query(PATHS_SQL + " SELECT season, src, dst, round(d,6) AS d FROM d6")
def shortest_paths(spark, d):
    x = Net(spark, d)
    return graph.shortest_paths(x.edges).withColumn("d", F.round("d", 6))


@query(PATHS_SQL + """, c AS (SELECT a.season, a.dst AS node, count(*) AS c FROM d6 a JOIN d6 b ON a.season=b.season AND a.dst=b.src JOIN d6 s ON s.season=a.season AND s.src=a.src AND s.dst=b.dst WHERE a.src<>b.dst AND abs(a.d+b.d-s.d)<1e-6 GROUP BY ALL)
SELECT season, node, round(coalesce(c,0)::DOUBLE/(((SELECT n FROM n)-1)*((SELECT n FROM n)-2)),6) AS betweenness FROM (SELECT season, node FROM nodes, seasons) LEFT JOIN c USING (season, node)""")
def betweenness(spark, d):
    x = Net(spark, d)
    return graph.path_betweenness(graph.shortest_paths(x.edges), x.nodes, x.n, SEASONS)


@query(E + """, g AS (SELECT node, split_part(node,':',1) AS c FROM nodes), f AS (SELECT season, g1.c AS c1, g2.c AS c2, w FROM e JOIN g g1 ON g1.node=src JOIN g g2 ON g2.node=dst),
t AS (SELECT season, c1, sum(w) AS tot, coalesce(sum(w) FILTER (c1=c2),0) AS inn FROM f GROUP BY ALL)
SELECT season, round(sum(inn)/sum(tot)-sum(tot*tot)/(sum(tot)*sum(tot)),6) AS modularity FROM t GROUP BY ALL""")
def modularity_given_partition(spark, d):
    x = Net(spark, d)
    groups = net.all_nodes(x.nodes, SEASONS).select("season", "node", F.col("layer").alias("community"))
    return net.modularity(x.edges, groups).withColumn("modularity", F.round("modularity", 6))


@query()
def communities(spark, d):
    x = Net(spark, d)
    return graph.communities(x.edges, x.nodes, SEASONS)


@query()
def community_summary(spark, d):
    x = Net(spark, d)
    edges = step(x.edges)
    groups = step(graph.communities(edges, x.nodes, SEASONS))
    return net.layer_mix(groups).join(net.modularity(edges, groups), "season").withColumn("modularity", F.round("modularity", 6))


@query(D + " SELECT season, layer, round(avg(degree),6) AS mean_degree, round(max(degree),6) AS max_degree, count(*) AS n_nodes FROM deg GROUP BY ALL")
def paper_stats(spark, d):
    return Net(spark, d).degree.groupBy("season", "layer").agg(F.round(F.avg("degree"), 6).alias("mean_degree"), F.round(F.max("degree"), 6).alias("max_degree"), F.count("*").alias("n_nodes"))
