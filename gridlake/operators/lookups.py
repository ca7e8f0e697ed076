"""Lookups as joins. A key's first (or last) row is found by aggregation, then joined.

The looked-up side is broadcast only by Spark's own size check, never by a hint, so both sides may
be large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..criteria import wildcard
from .ordered import latest, numbered


def _key(df: DataFrame, c: str):
    return F.lower(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c)


def xlookup(df: DataFrame, key: str, table: DataFrame, match: str, result: str, alias: str, order: str, last: bool = False, missing=None) -> DataFrame:
    """XLOOKUP and VLOOKUP exact: the result of the first matching row by ``order``, or of the last.

    A table's rows have no place of their own, so ``order`` says what stands for it.
    """
    pick = (F.max_by if last else F.min_by)(F.struct(F.lit(1).alias("hit"), F.col(result).alias("v")), F.col(order))
    side = table.where(F.col(match).isNotNull()).groupBy(_key(table, match).alias("__k")).agg(pick.alias("__r"))
    out = df.withColumn("__q", _key(df, key)).join(side, F.col("__q") == F.col("__k"), "left")
    value = F.col("__r.v")
    if missing is not None:
        value = F.when(F.col("__r.hit").isNull(), F.lit(missing)).otherwise(value)
    return out.withColumn(alias, value).drop("__q", "__k", "__r")


def match_position(df: DataFrame, key: str, table: DataFrame, match: str, order: str, alias: str) -> DataFrame:
    """MATCH(..., 0): the 1-based place of the first equal row by ``order``."""
    placed = numbered(table.select(_key(table, match).alias("__m"), order), order, alias="__at")
    side = placed.where("__m is not null").groupBy("__m").agg(F.min("__at").alias(alias))
    return df.withColumn("__q", _key(df, key)).join(side, F.col("__q") == F.col("__m"), "left").drop("__q", "__m")


def lookup_asof(df: DataFrame, key: str, bands: DataFrame, lower: str, result: str, alias: str) -> DataFrame:
    """LOOKUP and approximate VLOOKUP: the result of the largest bound that is at most the key."""
    return latest(df, key, bands, lower, result, alias)


def lookup_next(df: DataFrame, key: str, bands: DataFrame, upper: str, result: str, alias: str) -> DataFrame:
    """XLOOKUP with the next larger match: the result of the smallest bound that is at least the key."""
    return latest(df, key, bands, upper, result, alias, following=True)


def lookup_wildcard(df: DataFrame, patterns: list[tuple[str, object]], column: str, alias: str) -> DataFrame:
    """The value of the first pattern (* ? ~) that the column's text meets."""
    out = F.lit(None)
    for pattern, value in reversed(patterns):
        out = F.when(F.lower(F.col(column)).rlike(wildcard(pattern.lower())), F.lit(value)).otherwise(out)
    return df.withColumn(alias, out)


def hlookup(df: DataFrame, key: str, wide: DataFrame, alias: str) -> DataFrame:
    """HLOOKUP in a one-row table whose headers are the keys."""
    c = wide.columns
    tall = wide.select(F.explode(F.array(*[F.struct(F.lit(x.lower()).alias("__k"), F.col(x).cast("double").alias(alias)) for x in c])).alias("s")).select("s.*")
    return df.join(tall, F.lower(F.col(key).cast("string")) == F.col("__k"), "left").drop("__k")


def semi(df: DataFrame, key: str, other: DataFrame, match: str) -> DataFrame:
    """FILTER(df, COUNTIF(other, key) > 0)."""
    return df.join(other.select(F.col(match).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def anti(df: DataFrame, key: str, other: DataFrame, match: str) -> DataFrame:
    """FILTER(df, COUNTIF(other, key) = 0)."""
    return df.join(other.select(F.col(match).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
