"""Causal analyses of time series ``series, t, y``: interrupted series, difference in differences, lagged correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.functions.columns import uniform
from stratagraph.functions.special import correlation_p, normal_tail
from stratagraph.sources.steps import drop_written, step, written


SUMS = [f"m{i}{j}" for i in range(3) for j in range(i, 3)] + [f"v{i}" for i in range(3)]
FITTED = ["b0", "b1", "b2", "se0", "se1", "se2"]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coefficients and standard errors from the sums of many series at once; a singular matrix has its pseudo-inverse."""
    for batch in batches:
        col = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in SUMS}
        m = np.array([[col[f"m{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]).transpose(2, 0, 1)
        inverse = np.linalg.pinv(m, rcond=1e-13, hermitian=True)
        beta = np.einsum("nij,jn->in", inverse, np.array([col[f"v{i}"] for i in range(3)]))
        se = np.sqrt(np.maximum(np.einsum("nii->in", inverse), 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, [*beta, *se])], names=["series", *FITTED])


def its_poisson(series: DataFrame, at: int, end: int, tolerance: float = 1e-6, most: int = 50) -> DataFrame:
    """Poisson regression of y on 1, t and a step at ``at``, over t < end, by reweighted least squares.

    Each iteration is one aggregate of nine sums by series, whatever the length of a series; the sums of all series are solved
    together. A series whose coefficients move by less than ``tolerance`` leaves the loop, which ends without series;
    those that have not settled after ``most`` iterations have ``settled`` false. Returns coefficients, standard errors, z
    values, Wald's two-sided p values (``p``), those by the square root of the chi-squared law (``c``), and ``settled``. Where the
    columns depend on each other, say in a series that ends before the step, the smallest of the equally good fits is returned.
    """
    kind = dict(series.dtypes)["series"]
    # written: a checkpoint keeps the optimizer's estimate of its size, and a round that joins the last two would square it each time
    rows = written(series.where(F.col("t") < end).select("series", F.col("t").cast("double").alias("t"), (F.col("t") >= at).cast("double").alias("s"), (F.col("y") + 1e-6).alias("y")))
    # from the level of the series: from 0, large counts would take a step for each unit of their logarithm's overshoot
    now = written(rows.groupBy("series").agg(F.log(F.avg("y")).alias("b0")).select("series", "b0", *[F.lit(0.0).alias(c) for c in FITTED[1:]]))
    x = [F.lit(1.0), F.col("t"), F.col("s")]
    done, tables = None, [rows, now]
    for i in range(most):
        eta = F.col("b0") + F.col("b1") * F.col("t") + F.col("b2") * F.col("s")
        fit = rows.join(now, "series").withColumn("eta", eta).withColumn("mu", F.exp(F.greatest(F.least("eta", F.lit(10.0)), F.lit(-10.0))))
        fit = fit.withColumn("z", F.col("eta") + (F.col("y") - F.col("mu")) / F.greatest("mu", F.lit(1e-6)))
        sums = fit.groupBy("series").agg(*[F.sum(F.col("mu") * x[i] * x[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)], *[F.sum(F.col("mu") * x[i] * F.col("z")).alias(f"v{i}") for i in range(3)])
        new = sums.mapInArrow(_solved, f"series {kind}, " + ", ".join(f"{c} double" for c in FITTED))
        moved = F.greatest(*[F.abs(F.col(f"n.b{i}") - F.col(f"o.b{i}")) for i in range(3)])
        both = written(new.alias("n").join(now.alias("o"), "series").select("series", *[f"n.{c}" for c in FITTED], (moved < tolerance).alias("settled")))
        tables.append(both)
        settled, left = both.agg(F.count_if("settled"), F.count_if(~F.col("settled"))).first()
        if i == most - 1 or not left:
            done = both if done is None else done.unionByName(both)
            break
        if settled:
            done = both.where("settled") if done is None else done.unionByName(both.where("settled"))
        now = both.where("NOT settled").drop("settled")
    done = step(done)
    drop_written(*tables)
    z = [F.col(f"b{i}") / F.greatest(F.col(f"se{i}"), F.lit(1e-10)) for i in range(3)]
    p = [2 * normal_tail(F.abs(v)) for v in z]
    return done.select("series", *FITTED, *[v.alias(f"z{i}") for i, v in enumerate(z)], *[v.alias(f"p{i}") for i, v in enumerate(p)], *[(2 * (1 - F.sqrt(1 - v))).alias(f"c{i}") for i, v in enumerate(p)], "settled")


def its_counterfactual(series: DataFrame, coefficients: DataFrame, at: int, zero_from: int | None) -> DataFrame:
    """What the trend without the step gives, and events avoided from the step on; the former is 0 from ``zero_from`` on."""
    raw = F.exp(F.col("b0") + F.col("b1") * F.col("t"))
    rows = series.join(coefficients, "series").withColumn("raw", raw).withColumn("cf", F.when(F.col("t") >= zero_from, 0.0).otherwise(raw) if zero_from is not None else raw)
    return rows.select("series", "t", "y", "cf", F.when(F.col("t") >= at, F.greatest(F.lit(0.0), F.col("cf") - F.col("y"))).otherwise(0.0).alias("avoided"), F.when(F.col("t") >= at, F.greatest(F.lit(0.0), F.col("raw") - F.col("y"))).otherwise(0.0).alias("avoided_untruncated"))


def period_means(series: DataFrame, first: int, second: int) -> DataFrame:
    """Means before the first break, between the breaks and after; percent reductions against at least 0.01."""
    mean = lambda c: F.avg(F.when(c, F.col("y")))
    t = F.col("t")
    rows = series.groupBy("series").agg(mean(t < first).alias("pre"), mean((t >= first) & (t < second)).alias("mid"), mean(t >= second).alias("post"))
    fall = lambda a, b: 100 * (F.col(a) - F.col(b)) / F.greatest(F.col(a), F.lit(0.01))
    return rows.select("*", fall("pre", "mid").alias("reduction_mid"), fall("pre", "post").alias("reduction_post"))


def did(series: DataFrame, treated: str, control: str, pre: tuple[int, int], post: tuple[int, int]) -> DataFrame:
    """Difference in differences of the means over two closed ranges of t."""
    cell = lambda s, r: F.avg(F.when((F.col("series") == s) & F.col("t").between(*r), F.col("y")))
    means = series.where(F.col("series").isin(treated, control)).agg(cell(treated, pre).alias("treated_pre"), cell(treated, post).alias("treated_post"), cell(control, pre).alias("control_pre"), cell(control, post).alias("control_post"))
    estimate = (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre"))
    return means.withColumn("did", estimate).withColumn("reading", F.when(estimate < 0, "decrease").otherwise("no decrease"))


def did_bootstrap(series: DataFrame, treated: str, control: str, pre: tuple[int, int], post: tuple[int, int], replicates: int = 2000) -> DataFrame:
    """Percentile interval of the estimate over resamples of the four cells, drawn by hash-uniform numbers.

    Every draw of a replicate has a number of its own: the points of all cells before it, and its place in its cell.
    """
    cell = F.when((F.col("series") == treated) & F.col("t").between(*pre), 0).when((F.col("series") == treated) & F.col("t").between(*post), 1).when((F.col("series") == control) & F.col("t").between(*pre), 2).when((F.col("series") == control) & F.col("t").between(*post), 3)
    rows = series.withColumn("cell", cell).where("cell IS NOT NULL").withColumn("k", F.row_number().over(W.partitionBy("cell").orderBy("t")) - 1)
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    # four cells at most: their offsets need no key
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("points", F.sum("n").over(W.partitionBy(F.lit(0))))
    draws = series.sparkSession.range(replicates).withColumnRenamed("id", "rep").crossJoin(sizes).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    draws = draws.withColumn("k", F.floor(uniform(F.col("rep") * F.col("points") + F.col("before") + F.col("i")) * F.col("n")).cast("int"))
    means = draws.join(rows.select("cell", "k", "y"), ["cell", "k"]).groupBy("rep", "cell").agg(F.avg("y").alias("m"))
    m = lambda c: F.max(F.when(F.col("cell") == c, F.col("m")))
    reps = means.groupBy("rep").agg(((m(1) - m(0)) - (m(3) - m(2))).alias("d"))
    return reps.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg("d").alias("mean"))


def lagged_correlation(series: DataFrame, x: str | list[str], y: str, lags=(1, 2, 3, 4), with_p: bool = True) -> DataFrame:
    """Correlation of each x, some points earlier, with y: ``lag, r, n, p``, with ``series`` where x is a list.

    Points meet by their t, so gaps stay gaps. Lags at which x does not vary are left out; where y does not, r and p are null.
    """
    many = isinstance(x, list)
    own = series.where(F.col("series").isin(x if many else [x])).select("series", "t", F.col("y").alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    other = series.where(F.col("series") == y).select(F.col("t").alias("t2"), F.col("y").alias("y"))
    met = own.join(other, F.col("t") + F.col("lag") == F.col("t2")).where("x IS NOT NULL AND y IS NOT NULL")
    out = met.groupBy("series", "lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).where("sx > 0")
    out = out.withColumn("r", F.when(F.col("sy") > 0, F.col("r"))).select(*["series"] * many, "lag", "r", "n")
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n"))) if with_p else out


def period_quarter(period: Column) -> Column:
    """The quarter of a period written ``YYYY-Qn``; null if it is written otherwise."""
    found = F.regexp_extract(period, r"^\d{4}-Q([1-4])$", 1)
    return F.when(found != "", found.cast("int"))


def discovery(series: DataFrame, outcome: str, step_at: int, periods: DataFrame, breeding: tuple[int, ...] = (1, 2), level: float = 0.05, lags=(1, 2, 3, 4)) -> DataFrame:
    """``source, lag, r, n, p, significant``: correlations of the outcome with an earlier step and with an earlier breeding season.

    ``periods`` has ``t, period`` (``YYYY-Qn``). Up to eight rows: the step drops out at lags at which it does not vary.
    """
    t = series.where(F.col("series") == outcome).select("t").distinct()
    stepped = t.select(F.lit("measure").alias("series"), "t", (F.col("t") >= step_at).cast("double").alias("y"))
    season = t.join(periods, "t").select(F.lit("breeding_season").alias("series"), "t", period_quarter(F.col("period")).isin(*breeding).cast("double").alias("y"))
    every = series.where(F.col("series") == outcome).select("series", "t", "y").unionByName(stepped).unionByName(season)
    out = lagged_correlation(every, ["measure", "breeding_season"], outcome, lags)
    return out.withColumnRenamed("series", "source").withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))


def annual_rollup(series: DataFrame, per_year: int = 4) -> DataFrame:
    """Sums of full years."""
    years = series.groupBy("series", F.floor(F.col("t") / per_year).cast("int").alias("year")).agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    return years.where(F.col("n") == per_year).drop("n")


def apportion(annual: DataFrame, weights: DataFrame, jitter: str = "u") -> DataFrame:
    """Yearly counts over quarters by weight plus jitter, not under 0, normalised within the year: expected counts."""
    rows = annual.crossJoin(weights).withColumn("w", F.greatest(F.lit(0.0), F.col("w") + F.col(jitter)))
    return rows.withColumn("y", F.col("n") * F.col("w") / F.sum("w").over(W.partitionBy("series", "year")))
