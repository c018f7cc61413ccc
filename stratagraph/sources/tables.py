"""Canonical tables (nodes, layered edges, facts, series, trees, embeddings) derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.sources.steps import step

SEASONS = [1, 2, 3, 4]
FIRST_YEAR = 1995


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the names of their nation, brand and type; the dimensions join by key and are broadcast while small."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.quarter("o_orderdate").alias("season"), F.year("o_orderdate").alias("year"), "o_orderpriority")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n:"), "n_name").alias("nation"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("b:"), "p_brand").alias("brand"), F.concat(F.lit("t:"), "p_type").alias("type"))
    buyers = orders.join(cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select("season", "year", "nation", "brand", "type", F.col("o_orderpriority").alias("priority"), "rev")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``layer, node, idx``: ordinals by sorted name within each layer."""
    part = read(spark, sf_dir, "part")
    each = read(spark, sf_dir, "nation").select(F.lit("n").alias("layer"), F.concat(F.lit("n:"), "n_name").alias("node"))
    for layer, col in (("b", "p_brand"), ("t", "p_type")):
        each = each.unionByName(part.select(F.lit(layer).alias("layer"), F.concat(F.lit(f"{layer}:"), col).alias("node")).distinct())
    return each.withColumn("idx", F.row_number().over(W.partitionBy("layer").orderBy("node")) - 1)


def _all_seasons(df: DataFrame) -> DataFrame:
    return df.withColumn("season", F.explode(F.array(*map(F.lit, SEASONS))))


def edge_rules(spark: SparkSession, sf_dir: str, inter_weight: float = 0.5) -> DataFrame:
    """``season, a, b, w, prio``: all rules that write an edge; the highest prio is written last."""
    # one scan of the order lines; the cube has as many rows as the dimensions allow, whatever the number of lines
    cube = step(sales(spark, sf_dir).groupBy("season", "nation", "brand", "type").agg(F.sum("rev").alias("rev")))
    by_season = cube.groupBy("season", "nation").agg(F.sum("rev").alias("rev"))
    presence = by_season.select("season", "nation", (F.col("rev") / F.max("rev").over(W.partitionBy("season"))).alias("p"))
    danger = (
        read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .groupBy(F.concat(F.lit("n:"), "n_name").alias("nation"), F.col("n_regionkey").alias("region")).agg((F.coalesce(F.avg("c_acctbal"), F.lit(0.0)) / 10000).alias("d"))
    )
    here = presence.join(danger, "nation")
    score = F.when(F.col("x.region") == F.col("y.region"), 0.7).otherwise(0.2) * (1 - 0.3 * F.abs(F.col("x.d") - F.col("y.d")))
    nation_nation = here.alias("x").join(here.alias("y"), (F.col("x.season") == F.col("y.season")) & (F.col("x.nation") < F.col("y.nation"))).select(
        F.col("x.season").alias("season"), F.col("x.nation").alias("a"), F.col("y.nation").alias("b"), F.round(score * F.sqrt(F.col("x.p") * F.col("y.p")), 6).alias("w"), F.lit(1).alias("prio"))
    part = read(spark, sf_dir, "part")
    brand = part.groupBy(F.concat(F.lit("b:"), "p_brand").alias("a")).agg(F.avg("p_size").alias("s"))
    chain = W.partitionBy(F.substring("a", 1, 9)).orderBy("a")
    brand_brand = brand.select("a", F.lead("a").over(chain).alias("b"), F.round((F.col("s") + F.lead("s").over(chain)) / 2 / 50, 6).alias("w"), F.lit(2).alias("prio")).where("b IS NOT NULL")
    kinds = part.select(F.concat(F.lit("t:"), "p_type").alias("node"), F.split("p_type", " ").alias("s")).distinct()
    first = F.col("x.s")[0] == F.col("y.s")[0]
    last = F.element_at("x.s", -1) == F.element_at("y.s", -1)
    type_type = kinds.alias("x").join(kinds.alias("y"), (F.col("x.node") < F.col("y.node")) & (first | last)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.when(first, 0.6).otherwise(0.4).alias("w"), F.lit(3).alias("prio"))
    pair = cube.groupBy("season", "nation", "brand").agg(F.sum("rev").alias("rev"))
    nation_brand = pair.select("season", F.col("nation").alias("a"), F.col("brand").alias("b"), (F.round(F.col("rev") / F.max("rev").over(W.partitionBy("season")), 6) * inter_weight).alias("w"), F.lit(4).alias("prio"))
    by_type = cube.groupBy("nation", "type").agg(F.sum("rev").alias("rev"))
    one = W.partitionBy(F.lit(1))  # nations x types: a fixed few rows
    off = by_type.withColumn("off", F.col("rev") - F.avg("rev").over(one))
    nation_type = off.select(F.col("nation").alias("a"), F.col("type").alias("b"), (F.round(F.col("rev") / F.max("rev").over(one), 6) * inter_weight).alias("w"), F.lit(5).alias("prio"))
    signed = off.select(F.col("nation").alias("a"), F.col("type").alias("b"), (F.abs(F.round(F.col("off") / F.max(F.abs("off")).over(one), 6)) * inter_weight).alias("w"), F.lit(7).alias("prio"))
    brand_type = part.select(F.concat(F.lit("b:"), "p_brand").alias("a"), F.concat(F.lit("t:"), "p_type").alias("b")).distinct().select("a", "b", F.lit(0.4 * inter_weight).alias("w"), F.lit(6).alias("prio"))
    static = brand_brand.unionByName(type_type).unionByName(nation_type).unionByName(brand_type).unionByName(signed)
    return nation_nation.unionByName(nation_brand).unionByName(_all_seasons(static).select("season", "a", "b", "w", "prio")).where("w > 0")


#: The same rules as SQL: CTEs that end with ``rules(season, a, b, w, prio)``.
RULES_SQL = """
sales AS (SELECT quarter(o_orderdate)::INTEGER AS season, year(o_orderdate)::INTEGER AS year, 'n:'||n_name AS nation, 'b:'||p_brand AS brand, 't:'||p_type AS type, o_orderpriority AS priority, l_extendedprice*(1-l_discount) AS rev
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey),
seasons AS (SELECT unnest([1,2,3,4])::INTEGER AS season),
nodes AS (SELECT layer, node, (row_number() OVER (PARTITION BY layer ORDER BY node)-1)::INTEGER AS idx FROM (SELECT 'n' AS layer, 'n:'||n_name AS node FROM nation UNION SELECT 'b', 'b:'||p_brand FROM part UNION SELECT 't', 't:'||p_type FROM part)),
ns AS (SELECT season, nation, sum(rev) AS rev FROM sales GROUP BY ALL),
pres AS (SELECT season, nation, rev/max(rev) OVER (PARTITION BY season) AS p FROM ns),
danger AS (SELECT 'n:'||n_name AS nation, n_regionkey AS region, coalesce(avg(c_acctbal),0)/10000 AS d FROM nation LEFT JOIN customer ON n_nationkey=c_nationkey GROUP BY ALL),
here AS (SELECT * FROM pres JOIN danger USING (nation)),
sizes AS (SELECT 'b:'||p_brand AS a, avg(p_size) AS s FROM part GROUP BY ALL),
kinds AS (SELECT DISTINCT 't:'||p_type AS node, string_split(p_type,' ') AS s FROM part),
nb AS (SELECT season, nation, brand, sum(rev) AS rev FROM sales GROUP BY ALL),
nt AS (SELECT *, rev-avg(rev) OVER () AS off FROM (SELECT nation, type, sum(rev) AS rev FROM sales GROUP BY ALL)),
static AS (
  SELECT a, lead(a) OVER w AS b, round((s+lead(s) OVER w)/2/50,6) AS w, 2 AS prio FROM sizes WINDOW w AS (PARTITION BY substring(a,1,9) ORDER BY a)
  UNION ALL SELECT x.node, y.node, CASE WHEN x.s[1]=y.s[1] THEN 0.6 ELSE 0.4 END, 3 FROM kinds x JOIN kinds y ON x.node<y.node AND (x.s[1]=y.s[1] OR x.s[-1]=y.s[-1])
  UNION ALL SELECT nation, type, round(rev/max(rev) OVER (),6)*0.5, 5 FROM nt
  UNION ALL SELECT DISTINCT 'b:'||p_brand, 't:'||p_type, 0.2, 6 FROM part
  UNION ALL SELECT nation, type, abs(round(off/max(abs(off)) OVER (),6))*0.5, 7 FROM nt),
rules AS (SELECT season, a, b, w::DOUBLE AS w, prio FROM (
  SELECT x.season, x.nation AS a, y.nation AS b, round(CASE WHEN x.region=y.region THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END*(1-0.3*abs(x.d-y.d))*sqrt(x.p*y.p),6) AS w, 1 AS prio FROM here x JOIN here y ON x.season=y.season AND x.nation<y.nation
  UNION ALL SELECT season, nation, brand, round(rev/max(rev) OVER (PARTITION BY season),6)*0.5, 4 FROM nb
  UNION ALL SELECT season, a, b, w, prio FROM static, seasons WHERE b IS NOT NULL) WHERE w>0)
"""
#: ... and with the last-written symmetric edges ``e(season, src, dst, w)``.
EDGES_SQL = RULES_SQL + """,
lastw AS (SELECT season, a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY season,a,b ORDER BY prio DESC) AS k FROM rules) WHERE k=1),
e AS (SELECT season, a AS src, b AS dst, w FROM lastw UNION ALL SELECT season, b, a, w FROM lastw),
n AS (SELECT count(*) AS n FROM nodes)
"""
