"""Dynamic arrays: filtering, sorting, distinct rows, stacking and reshaping.

Rows have an order only where one is given; ``order`` columns stand for the rows' places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..compiler import compile_formula, scope, shown
from ..values import to_bool
from .ordered import numbered  # noqa: F401


def filter_rows(df: DataFrame, include: str) -> DataFrame:
    """FILTER: rows where the formula holds; errors and blanks don't."""
    got = to_bool(compile_formula(include, scope(df)))
    keep = got.v if got.err is None else got.v & got.err.isNull()
    return df.where(F.coalesce(keep, F.lit(False)))


def choose_columns(df: DataFrame, *at: int) -> DataFrame:
    """CHOOSECOLS: 1-based, negative from the end; a column may be taken again."""
    names = df.columns
    if any(k == 0 or abs(k) > len(names) for k in at):
        raise IndexError("#VALUE!")
    picked = [names[k - 1 if k > 0 else k] for k in at]
    return df.select(*[F.col(c).alias(c if picked.index(c) == i else f"{c}_{i + 1}") for i, c in enumerate(picked)])


def sort(df: DataFrame, keys: list[tuple[str, int]], tie: list[str] = ()) -> DataFrame:
    """SORT and SORTBY: (column, 1 or -1); ``tie`` makes the order total."""
    return df.orderBy(*[F.col(c).desc() if s < 0 else F.col(c).asc() for c, s in keys], *tie)


def take(df: DataFrame, n: int, order: list[tuple[str, int]], tie: list[str] = ()) -> DataFrame:
    """TAKE of a sorted table: a top-n that keeps n rows in each task, not a full sort. n < 0: the last."""
    keys = order if n >= 0 else [(c, -s) for c, s in order]
    return sort(df, keys, tie).limit(abs(n))


def drop(df: DataFrame, n: int, order: list[tuple[str, int]], tie: list[str] = ()) -> DataFrame:
    return sort(df, order, tie).offset(n)


def unique(df: DataFrame, *columns: str, once: bool = False) -> DataFrame:
    """UNIQUE: distinct rows, or those found exactly once."""
    out = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    return (out.where("__n = 1") if once else out).drop("__n")


def vstack(*tables: DataFrame) -> DataFrame:
    """VSTACK by position; the column counts must agree."""
    if len({len(t.columns) for t in tables}) > 1:
        raise ValueError("#VALUE!")
    return reduce(lambda a, b: a.union(b), tables)


def hstack(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """HSTACK of tables with a row number column ``key``; the shorter is padded with blanks."""
    return a.join(b, key, "full")


def tocol(df: DataFrame, columns: list[str], order: str, alias: str = "value", skip_blanks: bool = False) -> DataFrame:
    """TOCOL row by row: (order, place in the row, value)."""
    out = df.select(F.col(order), F.posexplode(F.array(*columns)).alias("place", alias))
    return out.where(F.col(alias).isNotNull()) if skip_blanks else out


def transpose(df: DataFrame, columns: list[str], row: str, rows: list) -> DataFrame:
    """TRANSPOSE of a table with known row keys: one row for each column."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    tall = df.select(F.col(row).alias("__row"), cells.alias("s"))
    return tall.groupBy(F.col("s.name").alias("name")).agg(*[F.max(F.when(F.col("__row") == k, F.col("s.v"))).alias(str(k)) for k in rows])


def sequence(spark, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    if rows < 1 or columns < 1:
        raise ValueError("#VALUE!")
    return spark.range(rows).select(F.col("id").alias("row"), *[(start + step * (F.col("id") * columns + k)).cast("double").alias(f"c{k + 1}") for k in range(columns)])


def textsplit(df: DataFrame, column: str, by: str, key: list[str], alias: str = "part") -> DataFrame:
    """TEXTSPLIT down: a row for each part, with its 1-based place."""
    parts = F.posexplode(F.split(F.col(column), F.concat(F.lit(r"\Q"), F.lit(by), F.lit(r"\E")), -1)).alias("place", alias)
    return df.select(*key, parts).withColumn("place", F.col("place") + 1)
