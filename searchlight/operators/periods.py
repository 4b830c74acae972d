"""Decomposition of a change between two periods: rows of period, key, clicks, impressions, position."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

A, B = "baseline", "current"


def by_period(rows: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """One row a key (in lower case): clicks, impressions, position of both periods, and its cohort."""
    at = lambda p, c: F.sum(F.when(F.col("period") == p, F.col(c)))
    pos = lambda p: F.try_divide(F.sum(F.when(F.col("period") == p, F.col("position") * F.col("impressions"))), at(p, "impressions"))
    rolled = rows.groupBy(F.lower("key").alias("key")).agg(*[at(p, c).alias(f"{c}_{s}") for s, p in (("a", a), ("b", b)) for c in ("clicks", "impressions")], pos(a).alias("position_a"), pos(b).alias("position_b"))
    cohort = F.when(F.col("clicks_a").isNull(), "new").when(F.col("clicks_b").isNull(), "lost").otherwise("retained")
    return rolled.where(F.col("clicks_a").isNotNull() | F.col("clicks_b").isNotNull()).withColumn("cohort", cohort)


def headline_per_day(daily: DataFrame) -> DataFrame:
    """period, days (first to last date, at least one), clicks and impressions a day, CTR."""
    days = F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1))
    return daily.groupBy("period").agg(days.alias("days"), (F.sum("clicks") / days).alias("clicks_per_day"), (F.sum("impressions") / days).alias("impressions_per_day"), F.coalesce(F.try_divide(F.sum("clicks"), F.sum("impressions")), F.lit(0.0)).alias("ctr"))


def shift_share(keys: DataFrame, days_a: int, days_b: int) -> DataFrame:
    """One row: how much of the change in clicks a day comes from lost, new and retained keys."""
    part = lambda cohort, c, d: F.coalesce(F.sum(F.when(F.col("cohort") == cohort, F.col(c))), F.lit(0)) / d
    one = keys.agg(*[F.count_if(F.col("cohort") == c).alias(c) for c in ("retained", "lost", "new")], part("lost", "clicks_a", days_a).alias("lost_clicks"), part("new", "clicks_b", days_b).alias("new_clicks"), (part("retained", "clicks_b", days_b) - part("retained", "clicks_a", days_a)).alias("retained_change"))
    total = F.col("retained_change") + F.col("new_clicks") - F.col("lost_clicks")
    share = lambda c: F.try_divide(c, total)
    return one.withColumn("share_lost", share(-F.col("lost_clicks"))).withColumn("share_retained", share(F.col("retained_change"))).withColumn("share_new", share(F.col("new_clicks")))


def position_decomposition(keys: DataFrame) -> DataFrame:
    """One row: the change in mean position as a change of mix and a real one, and whether their signs disagree."""
    kept = F.col("cohort") == "retained"
    wp = lambda s, c: F.try_divide(F.sum(F.when(c, F.col(f"position_{s}") * F.col(f"impressions_{s}"))), F.sum(F.when(c, F.col(f"impressions_{s}"))))
    one = keys.agg(wp("a", F.lit(True)).alias("a_all"), wp("a", kept).alias("a_retained"), wp("b", kept).alias("b_retained"), wp("b", F.lit(True)).alias("b_all"))
    one = one.withColumn("compositional", (F.col("a_retained") - F.col("a_all")) + (F.col("b_all") - F.col("b_retained"))).withColumn("real", F.col("b_retained") - F.col("a_retained"))
    return one.withColumn("signs_disagree", ((F.col("compositional") > 0) != (F.col("real") > 0)) & (F.abs("compositional") > 0.05) & (F.abs("real") > 0.05))


def gamma_tail(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            return scale * h


def categorical_effect(rows: DataFrame, top: int = 15) -> DataFrame:
    """One row: chi-square of clicks by category (the top ones of the first period and OTHER) and period, dof, Cramer's V, reading.

    A table of two by two gets the continuity correction. p is added from chi2 and dof by ``with_p``.
    """
    keys = by_period(rows)
    head = keys.where("clicks_a is not null").orderBy(F.desc("clicks_a"), "key").limit(top).select("key")
    marked = keys.join(F.broadcast(head.withColumn("in_top", F.lit(True))), "key", "left")
    bucket = F.when(F.col("in_top"), F.col("key")).otherwise("OTHER")
    cells = marked.groupBy(bucket.alias("bucket")).agg(F.coalesce(F.sum("clicks_a"), F.lit(0)).alias("a"), F.coalesce(F.sum("clicks_b"), F.lit(0)).alias("b"))
    w = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("ta", F.sum("a").over(w)).withColumn("tb", F.sum("b").over(w)).withColumn("k", F.count("*").over(w))
    expected = lambda t: (F.col("a") + F.col("b")) * F.col(t) / (F.col("ta") + F.col("tb"))
    off = lambda c, t: F.abs(F.col(c) - expected(t))
    less = lambda c, t: F.greatest(off(c, t) - F.when(F.col("k") == 2, F.least(F.lit(0.5), off(c, t))).otherwise(0.0), F.lit(0.0))
    part = lambda c, t: F.try_divide(less(c, t) ** 2, expected(t))
    one = cells.agg(F.sum(part("a", "ta") + part("b", "tb")).alias("chi2"), (F.max("k") - 1).alias("dof"), (F.max("ta") + F.max("tb")).alias("n"))
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n")))
    return one.withColumn("cramers_v", v).withColumn("reading", F.when(v < 0.10, "negligible").when(v < 0.30, "weak").otherwise("meaningful"))


def with_p(effect: DataFrame) -> DataFrame:
    """The effect with its p-value; a few rows, one a comparison."""

    @F.pandas_udf("double")
    def tail(chi2: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([gamma_tail(d / 2, c / 2) if c == c and d else None for c, d in zip(chi2, dof)], dtype=float)

    return effect.withColumn("p", tail("chi2", "dof"))


def counterfactual(daily: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """One row: clicks on impressions fitted on the first period's days, held against the second's."""
    in_a, in_b = F.col("period") == a, F.col("period") == b
    x, y = F.when(in_a, F.col("impressions").cast("double")), F.when(in_a, F.col("clicks").cast("double"))
    lx, ly = F.when(in_a & (F.col("impressions") > 0) & (F.col("clicks") > 0), F.ln("impressions")), F.when(in_a & (F.col("impressions") > 0) & (F.col("clicks") > 0), F.ln("clicks"))
    one = daily.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.avg(F.when(in_b, F.col("impressions"))).alias("mean_impressions"), F.avg(F.when(in_b, F.col("clicks"))).alias("actual"), F.regr_slope(ly, lx).alias("elasticity"))
    return one.withColumn("predicted", F.col("intercept") + F.col("slope") * F.col("mean_impressions")).withColumn("deviation", F.try_divide(F.col("actual"), F.col("predicted")) - 1).drop("mean_impressions")


def ctr_at_rank(rows: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """term, coefficient, standard_error, p of log CTR on position, period and both, weighted by impressions, with robust errors.

    The normal equations are sums over the rows; only a four by four system is solved on the driver.
    """
    data = rows.where((F.col("clicks") > 0) & (F.col("position") > 0) & (F.col("impressions") >= 5)).select(F.ln(F.col("clicks") / F.col("impressions")).alias("y"), F.col("position").cast("double").alias("p"), F.when(F.col("period") == b, 1.0).otherwise(0.0).alias("t"), F.col("impressions").cast("double").alias("w"))
    x = [F.lit(1.0), F.col("p"), F.col("t"), F.col("p") * F.col("t")]
    sums = data.agg(F.count("*"), *[F.sum(F.col("w") * x[i] * x[j]) for i in range(4) for j in range(4)], *[F.sum(F.col("w") * x[i] * F.col("y")) for i in range(4)]).first()
    spark, n, terms = rows.sparkSession, sums[0], ["intercept", "position", "period", "position:period"]
    schema = "term string, coefficient double, standard_error double, p double"
    if n < 30:
        return spark.createDataFrame([], schema)
    xtx, xty = np.array(sums[1:17], float).reshape(4, 4), np.array(sums[17:], float)
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    error = F.col("y") - sum((float(beta[i]) * x[i] for i in range(1, 4)), F.lit(float(beta[0])))
    meat = np.array(data.agg(*[F.sum((F.col("w") * error) ** 2 * x[i] * x[j]) for i in range(4) for j in range(4)]).first(), float).reshape(4, 4)
    se = np.sqrt(np.diag(inverse @ meat @ inverse) * n / (n - 4))
    return spark.createDataFrame([(t, float(c), float(s), math.erfc(abs(c / s) / math.sqrt(2))) for t, c, s in zip(terms, beta, se)], schema)


def changepoint(daily: DataFrame, series: str, metric: str = "impressions", trim: float = 0.15, least_rows: int = 20) -> DataFrame:
    """Per series: the date at which a break in level and slope of the log metric fits best, its F, and the means around it.

    With a break in both, the two sides are lines of their own, so a split's residual is that of the rows before it and of
    those from it on. Running sums give both for every split; a series is sorted once and never gathered in memory. Of equal
    splits the first counts; fewer than ``least_rows`` rows give none. Nulls count as no day.
    """
    by_date = Window.partitionBy("series").orderBy("date")
    so_far, whole = by_date.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("series")
    rows = daily.where(F.col("date").isNotNull() & F.col(metric).isNotNull()).select(F.col(series).alias("series"), "date", F.col(metric).cast("double").alias("m"))
    rows = rows.withColumn("n", F.count("*").over(whole)).where(F.col("n") >= least_rows)
    # Around a series' mean, so that differences of the sums keep their digits.
    log = F.ln(F.greatest("m", F.lit(1.0)))
    rows = rows.withColumn("k", F.row_number().over(by_date) - 1).withColumn("y", log - F.avg(log).over(whole)).withColumn("t", F.col("k") - (F.col("n") - 1) / 2)
    sums = {"y": F.col("y"), "t": F.col("t"), "yy": F.col("y") * F.col("y"), "tt": F.col("t") * F.col("t"), "ty": F.col("t") * F.col("y"), "m": F.col("m")}
    for c, value in sums.items():
        rows = rows.withColumns({f"{c}_a": F.coalesce(F.sum(value).over(so_far), F.lit(0.0)), f"{c}_all": F.sum(value).over(whole)})
    rows = rows.withColumns({f"{c}_b": F.col(f"{c}_all") - F.col(f"{c}_a") for c in sums})

    def residual(n, s):
        y, t, yy, tt, ty = (F.col(f"{c}_{s}") for c in ("y", "t", "yy", "tt", "ty"))
        x = ty - F.try_divide(t * y, n)
        return yy - F.try_divide(y * y, n) - F.coalesce(F.try_divide(x * x, tt - F.try_divide(t * t, n)), F.lit(0.0))

    n, k = F.col("n"), F.col("k")
    edge = F.floor(n * trim)
    split = F.greatest(residual(k, "a") + residual(n - k, "b"), F.lit(0.0))
    sup_f = F.when(split > 0, (residual(n, "all") - split) / 2 / (split / (n - 4))).otherwise(F.lit(math.inf))
    found = rows.where((k >= edge) & (k < n - edge)).select("series", F.struct(sup_f.alias("f"), (-k).alias("k")).alias("best"), "date", (F.col("m_a") / k).alias("before"), (F.col("m_b") / (n - k)).alias("after"))
    top = found.groupBy("series").agg(F.max_by(F.struct("best.f", "date", "before", "after"), "best").alias("x"))
    return top.select("series", F.col("x.date").alias("break_date"), F.col("x.f").alias("sup_f"), "x.before", "x.after")


def around_break(daily: DataFrame, breaks: DataFrame, series: str, metric: str = "impressions", width: int = 5) -> DataFrame:
    """series, offset, date and metric of the ``width`` rows before each break and from it on (offset 0 is the break)."""
    rows = daily.select(F.col(series).alias("series"), "date", metric).join(breaks.select("series", "break_date"), "series")
    late = F.col("date") >= F.col("break_date")
    forth, back = Window.partitionBy("series", late).orderBy("date"), Window.partitionBy("series", late).orderBy(F.desc("date"))
    offset = F.when(late, F.row_number().over(forth) - 1).otherwise(-F.row_number().over(back))
    return rows.withColumn("offset", offset).where((F.col("offset") >= -width) & (F.col("offset") < width)).select("series", "offset", "date", metric)


def lost_retained_new(keys: DataFrame, cohort: str) -> DataFrame:
    """The keys of a cohort by clicks."""
    clicks = F.coalesce("clicks_a", "clicks_b")
    return keys.where(F.col("cohort") == cohort).select("key", clicks.alias("clicks")).orderBy(F.desc("clicks"), "key")


def daily_union(parts: list[DataFrame]) -> DataFrame:
    """The periods' daily rows together; of several rows of a date the first period's stays."""
    out = parts[0].withColumn("__part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("__part", F.lit(i)))
    rank = F.row_number().over(Window.partitionBy("date").orderBy("__part"))
    return out.withColumn("__r", rank).where("__r = 1").drop("__r", "__part")
