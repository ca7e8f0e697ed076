"""Aggregation: global, conditional, database, grouped, pivoted, and over visible rows.

All are partial-then-final hash aggregates. A report of criteria copied down many rows is one
grouped aggregate and a join (``sumifs_report``), not a scan for each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..criteria import all_of, any_row
from . import ordered

AGGREGATES = {
    "SUM": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "AVERAGE": F.avg, "COUNT": F.count, "COUNTA": F.count, "MAX": lambda c: F.coalesce(F.max(c), F.lit(0.0)), "MIN": lambda c: F.coalesce(F.min(c), F.lit(0.0)),
    "PRODUCT": lambda c: F.coalesce(F.product(c), F.lit(0.0)), "STDEV.S": F.stddev_samp, "STDEV.P": F.stddev_pop, "VAR.S": F.var_samp, "VAR.P": F.var_pop, "MEDIAN": F.median,
    "SUMSQ": lambda c: F.sum(c * c), "GEOMEAN": lambda c: F.when(F.min(c) > 0, F.exp(F.avg(F.log(c)))), "HARMEAN": lambda c: F.when(F.min(c) > 0, F.count(c) / F.sum(1 / c)),
    "DEVSQ": lambda c: F.var_pop(c) * F.count(c), "SKEW.P": F.skewness, "COUNTBLANK": lambda c: F.sum(F.when(c.isNull() | (c.cast("string") == ""), 1).otherwise(0)),
    "SKEW": lambda c: F.when(F.count(c) >= 3, F.skewness(c) * F.sqrt(F.count(c) * (F.count(c) - 1.0)) / (F.count(c) - 2)),
    "KURT": lambda c: F.when(F.count(c) >= 4, (F.count(c) - 1.0) / ((F.count(c) - 2.0) * (F.count(c) - 3.0)) * ((F.count(c) + 1) * F.kurtosis(c) + 6)),
    "MODE": lambda c: F.mode(c, True),
}
#: The numbers that SUBTOTAL and AGGREGATE give to functions, and GROUPBY to its own.
SUBTOTAL_CODES = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV.S", 8: "STDEV.P", 9: "SUM", 10: "VAR.S", 11: "VAR.P"}
GROUP_CODES = SUBTOTAL_CODES | {12: "MEDIAN"}
SHORT = {"STDEV": "STDEV.S", "STDEVP": "STDEV.P", "VAR": "VAR.S", "VARP": "VAR.P", "STDEVA": "STDEV.S", "VARA": "VAR.S", "AVERAGEA": "AVERAGE", "MAXA": "MAX", "MINA": "MIN"}


def aggregate(name: str | int, c: Column) -> Column:
    name = GROUP_CODES.get(name, name)
    name = name.upper()
    return AGGREGATES[SHORT.get(name, name)](c)


def percentile(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """PERCENTILE.INC and QUARTILE.INC: interpolated on ranks 0..n-1, a column for each share."""
    return ordered.percentiles(df, value, shares)


def percentile_exc(df: DataFrame, value: str, p: float, alias: str) -> DataFrame:
    """PERCENTILE.EXC: interpolated on ranks 1..n of n+1, null (#NUM!) outside them."""
    return ordered.percentiles(df, value, {alias: p}, exclusive=True)


def conditional(df: DataFrame, name: str, column: str | None, criteria, alias: str) -> DataFrame:
    """SUMIFS and its kin: one aggregate over the rows that meet all criteria."""
    hit = df.where(all_of(df, criteria))
    value = F.lit(1) if column is None else F.col(column)
    return hit.agg(aggregate("COUNT" if name.upper().startswith("COUNT") else name.upper().replace("IFS", "").replace("IF", ""), value).alias(alias))


def report(facts: DataFrame, keys: dict[str, str], rows: DataFrame, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Criteria formulas copied down ``rows``: keys maps a fact column to the report's column.

    Texts are compared without case. Rows of the report without facts get 0, or null (an error)
    for averages.
    """
    texts = {k for k in keys if dict(facts.dtypes)[k] == "string"}
    low = lambda d, c, on: F.lower(d[c]) if on else d[c]
    grouped = facts.groupBy(*[low(facts, k, k in texts).alias(f"__{k}") for k in keys]).agg(*[aggregate(f, F.col(c)).alias(a) for a, (f, c) in measures.items()])
    on = [low(rows, r, k in texts).eqNullSafe(grouped[f"__{k}"]) for k, r in keys.items()]
    out = rows.join(grouped, on, "left").drop(*[f"__{k}" for k in keys])
    return out.withColumns({a: F.coalesce(a, F.lit(0)) for a, (f, _) in measures.items() if f.upper() in ("SUM", "COUNT", "COUNTA", "MAX", "MIN")})


def database(df: DataFrame, name: str, field: str, rows: list[dict], alias: str) -> DataFrame:
    """DSUM and its kin: alternatives of conjunctions as one predicate."""
    return df.where(any_row(df, rows)).agg(aggregate(name.upper().removeprefix("D").replace("STDEVP", "STDEV.P").replace("VARP", "VAR.P"), F.col(field)).alias(alias))


def dget(df: DataFrame, field: str, rows: list[dict], alias: str) -> DataFrame:
    """The only match; null with #VALUE! for none and #NUM! for several."""
    got = df.where(any_row(df, rows)).agg(F.count("*").alias("n"), F.min(field).alias("v"))
    return got.select(F.when(F.col("n") == 1, F.col("v")).alias(alias), F.when(F.col("n") == 0, "#VALUE!").when(F.col("n") > 1, "#NUM!").alias(f"{alias}__error"))


def groupby(df: DataFrame, keys: list[str], value: str, name: str | int, alias: str, total: bool = False) -> DataFrame:
    """GROUPBY with natural key types; ``total`` adds a row for all, with null keys."""
    f = aggregate(name, F.col(value)).alias(alias)
    if not total:
        return df.groupBy(*keys).agg(f)
    return df.groupingSets([[F.col(k) for k in keys], []], *keys).agg(f)


def pivotby(df: DataFrame, rows: list[str], column: str, value: str, name: str | int, categories: list, total: bool = False) -> DataFrame:
    """PIVOTBY over known categories in one pass; missing intersections are null. ``total`` adds a column."""
    cells = [aggregate(name, F.when(F.col(column) == k, F.col(value))).alias(str(k)) for k in categories]
    seen = [F.count(F.when(F.col(column) == k, 1)).alias(f"__{i}") for i, k in enumerate(categories)]
    out = df.groupBy(*rows).agg(*cells, *seen, *([aggregate(name, F.col(value)).alias("Total")] if total else []))
    out = out.withColumns({str(k): F.when(F.col(f"__{i}") > 0, F.col(f"`{k}`")) for i, k in enumerate(categories)})
    return out.drop(*[f"__{i}" for i in range(len(categories))])


def subtotal(df: DataFrame, code: int, value: str, alias: str, hidden: Column | None = None, filtered: Column | None = None) -> DataFrame:
    """SUBTOTAL: rows hidden by a filter never count; codes over 100 leave out those hidden by hand too."""
    keep = F.lit(True)
    if filtered is not None:
        keep = keep & ~F.coalesce(filtered, F.lit(False))
    if code > 100 and hidden is not None:
        keep = keep & ~F.coalesce(hidden, F.lit(False))
    return df.where(keep).agg(aggregate(SUBTOTAL_CODES[code % 100], F.col(value)).alias(alias))


def distinct_count(df: DataFrame, column: str, alias: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias(alias))


def trimmed_mean(df: DataFrame, value: str, share: float, alias: str) -> DataFrame:
    """TRIMMEAN: floor(n * share / 2) values go at either end.

    The values at the cuts are selected first; the rest is one aggregate.
    """
    cut = lambda n: math.floor(n * share / 2)
    n, at = ordered.at_ranks(df, value, lambda n: [cut(n), n - 1 - cut(n)])
    k, v = cut(n), F.col(value).cast("double")
    if not n or n <= 2 * k:
        return df.sparkSession.createDataFrame([(None,)], f"`{alias}` double")
    lo, hi = at[k], at[n - 1 - k]
    # of the values at the cuts as many stay as aren't cut off
    if lo == hi:
        return df.agg(F.lit(lo).alias(alias)).limit(1)
    inner = F.coalesce(F.sum(F.when((v > lo) & (v < hi), v)), F.lit(0.0))
    return df.agg(((inner + lo * (F.count(F.when(v <= lo, 1)) - k) + hi * (F.count(F.when(v >= hi, 1)) - k)) / (n - 2 * k)).alias(alias))
