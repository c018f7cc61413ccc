"""Queries over time series of orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.operators import causal
from stratagraph.plans.registry import query
from stratagraph.sources import tables

#: Orders of two market segments by quarter, zero where there are none.
SERIES_SQL = """
cnt AS (SELECT c_mktsegment AS series, ((year(o_orderdate)-1995)*4+quarter(o_orderdate)-1)::INTEGER AS t, count(*)::DOUBLE AS y FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_mktsegment IN ('BUILDING','MACHINERY') GROUP BY ALL),
ser AS (SELECT s.series, g.t::INTEGER AS t, coalesce(cnt.y,0) AS y FROM (SELECT unnest(['BUILDING','MACHINERY']) AS series) s CROSS JOIN range(0,27) g(t) LEFT JOIN cnt ON cnt.series=s.series AND cnt.t=g.t)
"""
Q = "WITH " + SERIES_SQL


def series(spark, d):
    orders = tables.read(spark, d, "orders").select("o_custkey", ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).cast("int").alias("t"))
    cust = tables.read(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", F.col("c_mktsegment").alias("series"))
    n = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy("series", "t").agg(F.count("*").cast("double").alias("y"))
    every = spark.range(27).select(F.col("id").cast("int").alias("t"), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("series"))
    return every.join(n, ["series", "t"], "left").select("series", "t", F.coalesce("y", F.lit(0.0)).alias("y"))


def _rounded(df, k=6):
    return df.select(*[F.round(c, k).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(Q + " SELECT series, t, y FROM ser")
def quarterly_series(spark, d):
    return series(spark, d)


def _its_sql(iterations: int) -> str:
    sql = "WITH " + SERIES_SQL + ", rw AS (SELECT series, t::DOUBLE AS t, (t>=12)::INTEGER::DOUBLE AS s, y+1e-6 AS y FROM ser WHERE t<24), b0 AS (SELECT series, ln(avg(y)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS se0, 0.0::DOUBLE AS se1, 0.0::DOUBLE AS se2 FROM rw GROUP BY series)"
    for i in range(iterations):
        sql += f""", f{i} AS (SELECT series, t, s, mu, eta+(y-mu)/greatest(mu,1e-6) AS z FROM (SELECT *, exp(greatest(least(eta,10.0::DOUBLE),-10.0::DOUBLE)) AS mu FROM (SELECT rw.*, b0+b1*t+b2*s AS eta FROM rw JOIN b{i} USING (series)))),
m{i} AS (SELECT series, sum(mu) AS p, sum(mu*t) AS q, sum(mu*s) AS r, sum(mu*t*t) AS ss, sum(mu*t*s) AS tt, sum(mu*s*s) AS u, sum(mu*z) AS v0, sum(mu*t*z) AS v1, sum(mu*s*z) AS v2 FROM f{i} GROUP BY series),
i{i} AS (SELECT *, p*(ss*u-tt*tt)-q*(q*u-tt*r)+r*(q*tt-ss*r) AS det FROM m{i}),
b{i + 1} AS MATERIALIZED (SELECT series, ((ss*u-tt*tt)*v0+(r*tt-q*u)*v1+(q*tt-r*ss)*v2)/det AS b0, ((r*tt-q*u)*v0+(p*u-r*r)*v1+(q*r-p*tt)*v2)/det AS b1, ((q*tt-r*ss)*v0+(q*r-p*tt)*v1+(p*ss-q*q)*v2)/det AS b2, sqrt(abs((ss*u-tt*tt)/det)) AS se0, sqrt(abs((p*u-r*r)/det)) AS se1, sqrt(abs((p*ss-q*q)/det)) AS se2 FROM i{i})"""
    return sql


ITS = _its_sql(12)


def _tail(i: int) -> str:
    z = f"(abs(b{i})/greatest(se{i},1e-10))"
    t = f"(1/(1+0.2316419::DOUBLE*{z}))"
    return f"exp(-{z}*{z}/2)/sqrt(2*pi())*({t}*(0.319381530::DOUBLE+{t}*(-0.356563782::DOUBLE+{t}*(1.781477937::DOUBLE+{t}*(-1.821255978::DOUBLE+{t}*1.330274429::DOUBLE)))))"


@query(ITS + " SELECT series, round(b0,4) AS b0, round(b1,4) AS b1, round(b2,4) AS b2, round(se0,4) AS se0, round(se1,4) AS se1, round(se2,4) AS se2, round(b0/greatest(se0,1e-10),4) AS z0, round(b1/greatest(se1,1e-10),4) AS z1, round(b2/greatest(se2,1e-10),4) AS z2, " + ", ".join(f"round(({_tail(i)})*2,4) AS p{i}, round(2*(1-sqrt(1-2*({_tail(i)}))),4) AS c{i}" for i in range(3)) + ", true AS settled FROM b12")
def its_poisson(spark, d):
    return _rounded(causal.its_poisson(series(spark, d), 12, 24), 4)


@query(ITS + ", c AS (SELECT series, t, y, exp(b0+b1*t) AS raw FROM ser JOIN b12 USING (series)) SELECT series, t, y, round(CASE WHEN t>=24 THEN 0 ELSE raw END,4) AS cf, round(CASE WHEN t>=12 THEN greatest(0.0::DOUBLE,CASE WHEN t>=24 THEN 0 ELSE raw END-y) ELSE 0 END,4) AS avoided, round(CASE WHEN t>=12 THEN greatest(0.0::DOUBLE,raw-y) ELSE 0 END,4) AS avoided_untruncated FROM c")
def its_counterfactual(spark, d):
    s = series(spark, d)
    return _rounded(causal.its_counterfactual(s, causal.its_poisson(s, 12, 24), 12, 24), 4)


@query(Q + ", m AS (SELECT series, avg(y) FILTER (t<12) AS pre, avg(y) FILTER (t>=12 AND t<24) AS mid, avg(y) FILTER (t>=24) AS post FROM ser GROUP BY series) SELECT series, round(pre,6) AS pre, round(mid,6) AS mid, round(post,6) AS post, round(100*(pre-mid)/greatest(pre,0.01),6) AS reduction_mid, round(100*(pre-post)/greatest(pre,0.01),6) AS reduction_post FROM m")
def period_means(spark, d):
    return _rounded(causal.period_means(series(spark, d), 12, 24))


@query(Q + ", m AS (SELECT avg(y) FILTER (series='BUILDING' AND t BETWEEN 16 AND 19) AS treated_pre, avg(y) FILTER (series='BUILDING' AND t BETWEEN 20 AND 23) AS treated_post, avg(y) FILTER (series='MACHINERY' AND t BETWEEN 16 AND 19) AS control_pre, avg(y) FILTER (series='MACHINERY' AND t BETWEEN 20 AND 23) AS control_post FROM ser) SELECT *, (treated_post-treated_pre)-(control_post-control_pre) AS did, CASE WHEN (treated_post-treated_pre)-(control_post-control_pre)<0 THEN 'decrease' ELSE 'no decrease' END AS reading FROM m")
def did(spark, d):
    return causal.did(series(spark, d), "BUILDING", "MACHINERY", (16, 19), (20, 23))


@query(Q + """, cell AS (SELECT CASE WHEN series='BUILDING' THEN CASE WHEN t<20 THEN 0 ELSE 1 END ELSE CASE WHEN t<20 THEN 2 ELSE 3 END END AS cell, t, y FROM ser WHERE t BETWEEN 16 AND 23),
rw AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY t)-1 AS k, y FROM cell), sz AS (SELECT cell, n, sum(n) OVER (ORDER BY cell)-n AS before, sum(n) OVER () AS points FROM (SELECT cell, count(*) AS n FROM rw GROUP BY cell)),
dr AS (SELECT rep, cell, floor((((((rep*points+before+i)*1103515245+12345)%2147483648)*1103515245+12345)%2147483648)/2147483648.0::DOUBLE*n)::INTEGER AS k FROM range(0,2000) a(rep), sz, range(0,4) b(i) WHERE i<n),
me AS (SELECT rep, cell, avg(y) AS m FROM dr JOIN rw USING (cell,k) GROUP BY rep, cell), di AS (SELECT rep, (max(m) FILTER (cell=1)-max(m) FILTER (cell=0))-(max(m) FILTER (cell=3)-max(m) FILTER (cell=2)) AS d FROM me GROUP BY rep)
SELECT round(quantile_cont(d,0.025),6) AS low, round(quantile_cont(d,0.975),6) AS high, round(avg(d),6) AS mean FROM di""")
def did_bootstrap(spark, d):
    return _rounded(causal.did_bootstrap(series(spark, d), "BUILDING", "MACHINERY", (16, 19), (20, 23)))


@query(Q + ", wide AS (SELECT t, max(y) FILTER (series='BUILDING') AS x, max(y) FILTER (series='MACHINERY') AS y FROM ser GROUP BY t), lg AS (SELECT k::INTEGER AS lag, b.y, a.x FROM wide b JOIN range(1,5) g(k) ON true JOIN wide a ON a.t=b.t-k) SELECT lag, round(corr(x,y),6) AS r, count(*) AS n FROM lg GROUP BY lag")
def lag_corr(spark, d):
    return _rounded(causal.lagged_correlation(series(spark, d), "BUILDING", "MACHINERY", with_p=False))


#: Two-sided p of r over n points: the finite sum of Student's law, its coefficients by gamma functions.
P_SQL = "greatest(0.0::DOUBLE, 1-CASE WHEN (n-2)%2=1 THEN 2/pi()*(asin(abs(r))+abs(r)*coalesce(list_sum(list_transform(range(0,(n-3)//2), lambda k: exp(lgamma(k+1)-lgamma(k+1.5))*sqrt(pi())/2*pow(1-r*r,k+0.5))),0)) ELSE abs(r)*list_sum(list_transform(range(0,(n-2)//2), lambda k: exp(lgamma(k+0.5)-lgamma(k+1))/sqrt(pi())*pow(1-r*r,k))) END)"
LAG_SQL = Q + ", lg AS (SELECT k::INTEGER AS lag, b.y, a.y AS x FROM ser b JOIN range(1,5) g(k) ON true JOIN ser a ON a.t=b.t-k WHERE a.series='BUILDING' AND b.series='MACHINERY'), c AS (SELECT lag, corr(x,y) AS r, count(*) AS n FROM lg GROUP BY lag)"


@query(LAG_SQL + f" SELECT lag, round(r,6) AS r, n, round({P_SQL},6) AS p FROM c")
def lag_corr_p(spark, d):
    return _rounded(causal.lagged_correlation(series(spark, d), "BUILDING", "MACHINERY"))


@query(Q + f""", src AS (SELECT 'measure' AS source, t, (t>=12)::INTEGER::DOUBLE AS x FROM ser WHERE series='BUILDING' UNION ALL SELECT 'breeding_season', t, (t%4 IN (0,1))::INTEGER::DOUBLE FROM ser WHERE series='BUILDING'),
c AS (SELECT source, k::INTEGER AS lag, corr(x,y) AS r, count(*) AS n FROM src JOIN range(1,5) g(k) ON true JOIN ser ON ser.t=src.t+k AND series='BUILDING' GROUP BY ALL)
SELECT source, lag, round(r,6) AS r, n, round({P_SQL},6) AS p, {P_SQL}<0.05 AS significant FROM c""")
def lag_discovery(spark, d):
    """Correlations of a segment's orders with an earlier step and with an earlier first half of the year, out of written periods."""
    s = series(spark, d)
    periods = s.select("t", F.concat(F.floor(F.col("t") / 4) + 1995, F.lit("-Q"), F.col("t") % 4 + 1).alias("period")).distinct()
    return _rounded(causal.discovery(s, "BUILDING", 12, periods))


@query(Q + " SELECT series, (t//4)::INTEGER AS year, sum(y) AS y FROM ser GROUP BY ALL HAVING count(*)=4")
def annual_rollup(spark, d):
    return causal.annual_rollup(series(spark, d))


@query(Q + ", an AS (SELECT series, (t//4)::INTEGER AS year, sum(y) AS n FROM ser GROUP BY ALL HAVING count(*)=4), w AS (SELECT * FROM (VALUES (0,1.2),(1,1.8),(2,0.8),(3,1.0)) v(q,w)), a AS (SELECT series, year, q::INTEGER AS q, n, greatest(0.0::DOUBLE, w/4.8::DOUBLE+((year*4+q)%5-2)*0.05) AS w FROM an, w) SELECT series, year, q, round(n*w/sum(w) OVER (PARTITION BY series, year),6) AS y FROM a")
def quarterly_apportion(spark, d):
    annual = causal.annual_rollup(series(spark, d)).withColumnRenamed("y", "n")
    w = spark.createDataFrame([(0, 1.2), (1, 1.8), (2, 0.8), (3, 1.0)], "q int, w double").withColumn("w", F.col("w") / 4.8)
    jitter = ((F.col("year") * 4 + F.col("q")) % 5 - 2) * 0.05
    rows = annual.crossJoin(w).withColumn("w", F.greatest(F.lit(0.0), F.col("w") + jitter))
    return rows.select("series", "year", "q", F.round(F.col("n") * F.col("w") / F.sum("w").over(W.partitionBy("series", "year")), 6).alias("y"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL")
def daily_events(spark, d):
    e = tables.read(spark, d, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
