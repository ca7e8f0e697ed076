"""Ranks, running and rolling formulas, histograms and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running, value_counts


def rank(df: DataFrame, value: str, alias: str, ascending: bool = False, average: bool = False) -> DataFrame:
    """RANK.EQ, or RANK.AVG with ``average``: distinct values are ranked, and joined back by value."""
    side = value_counts(df, value)
    r = (F.col("__less") if ascending else F.col("__n") - F.col("__less") - F.col("__c")) + 1
    r = r + (F.col("__c") - 1) / 2 if average else r
    return df.join(side, F.col(value) == F.col("__v"), "left").withColumn(alias, r).drop("__v", "__c", "__less", "__n")


def percent_rank(df: DataFrame, value: str, alias: str, digits: int = 3, exclusive: bool = False) -> DataFrame:
    """PERCENTRANK.INC or .EXC of each member, cut to ``digits``."""
    side, n = value_counts(df, value), F.col("__n")
    p = (F.col("__less") + 1) / (n + 1) if exclusive else F.when(n > 1, F.col("__less") / (n - 1)).otherwise(1.0)
    scale = 10.0**digits
    return df.join(side, F.col(value) == F.col("__v"), "left").withColumn(alias, F.floor(p * scale + 1e-9) / scale).drop("__v", "__c", "__less", "__n")


def percent_rank_of(df: DataFrame, value: str, x: float, alias: str, digits: int = 3, exclusive: bool = False) -> DataFrame:
    """PERCENTRANK of one number, interpolated between its neighbours; null (#N/A) outside the values."""
    v = F.col(value).cast("double")
    got = df.agg(F.count(v).alias("n"), F.count(F.when(v < x, 1)).alias("less"), F.max(F.when(v <= x, v)).alias("lo"), F.min(F.when(v >= x, v)).alias("hi"), F.count(F.when(v <= x, 1)).alias("upto"))
    # a member stands at its smaller rows; what lies between two members is on the line that joins them
    last = df.agg(F.max(F.when(v < x, v)).alias("__lo")).select("__lo")
    ties = df.crossJoin(F.broadcast(last)).agg(F.count(F.when(v == F.col("__lo"), 1)).alias("ties"))
    got = got.crossJoin(F.broadcast(ties))
    place = F.when(F.col("lo") == F.col("hi"), F.col("less")).otherwise(F.col("less") - F.col("ties") + (F.lit(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("ties"))
    p = (place + 1) / (F.col("n") + 1) if exclusive else F.when(F.col("n") > 1, place / (F.col("n") - 1)).otherwise(1.0)
    scale = 10.0**digits
    return got.select(F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.floor(p * scale + 1e-9) / scale).alias(alias))


def running_total(df: DataFrame, value: str, by: list[str], order: list[str], alias: str) -> DataFrame:
    """=C1+B2 copied down each group."""
    return running(df, value, by, order, alias)


def rolling(df: DataFrame, name: str, value: str, size: int, by: list[str], order: list[str], alias: str) -> DataFrame:
    """=AVERAGE(B1:B3) copied down: the last ``size`` rows, fewer at the start."""
    from .aggregates import aggregate

    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)
    plain = {"SUM": F.sum, "AVERAGE": F.avg, "MAX": F.max, "MIN": F.min, "COUNT": F.count}.get(name.upper())
    return df.withColumn(alias, (plain(value) if plain else aggregate(name, F.col(value))).over(w))


def delta(df: DataFrame, value: str, by: list[str], order: list[str], alias: str) -> DataFrame:
    """=B3-B2 copied down."""
    return df.withColumn(alias, F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def frequency(df: DataFrame, value: str, bins: list[float], alias: str = "n") -> DataFrame:
    """FREQUENCY: counts up to each edge and over the last; empty bins are 0."""
    edges = sorted(bins)
    which = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        which = F.when(F.col(value) <= edges[i], F.lit(i)).otherwise(which)
    counts = df.where(F.col(value).isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias(alias))
    every = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce(alias, F.lit(0)).alias(alias))


def large(df: DataFrame, value: str, k: int, alias: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(k).agg(F.min(value).alias(alias))


def small(df: DataFrame, value: str, k: int, alias: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(value).limit(k).agg(F.max(value).alias(alias))


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """SLOPE, INTERCEPT, RSQ, CORREL, COVARIANCE.S, STEYX in one aggregate."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    n = F.regr_count(a, b)
    steyx = F.sqrt((F.regr_syy(a, b) - F.pow(F.regr_sxy(a, b), 2) / F.regr_sxx(a, b)) / (n - 2))
    return df.agg(
        F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("rsq"), F.corr(a, b).alias("correl"),
        F.covar_samp(a, b).alias("covariance_s"), F.when(n > 2, steyx).alias("steyx"),
    )


def trend(df: DataFrame, y: str, x: str, alias: str, growth: bool = False) -> DataFrame:
    """TREND or GROWTH at every row's x: the fitted line as one row beside the table."""
    target = F.log(F.col(y)) if growth else F.col(y)
    line = df.agg(F.regr_slope(target, F.col(x)).alias("__m"), F.regr_intercept(target, F.col(x)).alias("__b"))
    fit = F.col("__m") * F.col(x) + F.col("__b")
    return df.crossJoin(F.broadcast(line)).withColumn(alias, F.exp(fit) if growth else fit).drop("__m", "__b")
