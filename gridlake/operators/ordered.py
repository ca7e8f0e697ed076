"""Places and order statistics of whole tables without a sort in one task.

A table is dealt into ranges of its order by a search tree of literal bounds. The bounds come from a
bounded random selection of rows and only balance the work: every branch of a plan computes the same
range from a row's values, so results don't depend on them. What is gathered over ranges is at most
MOST_RANGES rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RANGES = 256
#: Rows looked at for each bound, and values of a range that are sorted in one place.
PER_BOUND = 24
SMALL = 200_000


def bounds(df: DataFrame, order: list[str]) -> list[tuple]:
    n = max(8, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.select(*order).where(" and ".join(f"`{c}` is not null" for c in order)).withColumn("__r", F.rand(17)).orderBy("__r").limit(n * PER_BOUND).drop("__r")
    got = sorted(tuple(r) for r in rows.distinct().collect())
    return sorted({got[len(got) * i // n] for i in range(1, n)}) if got else []


def range_of(df: DataFrame, order: list[str], edges: list[tuple]) -> Column:
    """Number of the range that a row belongs to: the edges at or below it. Nulls are below all."""
    kinds = [df.schema[c].dataType for c in order]
    value = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(order)]) if len(order) > 1 else F.col(order[0])

    def at(e: tuple) -> Column:
        cells = [F.lit(x).cast(k) for x, k in zip(e, kinds)]
        return F.struct(*[c.alias(f"v{i}") for i, c in enumerate(cells)]) if len(cells) > 1 else cells[0]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value >= at(edges[mid - 1]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    return tree(0, len(edges))


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("__range", range_of(df, order, bounds(df, order)))


def _bases(ranged: DataFrame, weight: Column, by: list[str] = ()) -> DataFrame:
    """(by, __range, __base): the weights in the ranges before."""
    sizes = ranged.groupBy(*by, "__range").agg(F.sum(weight).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*by, "__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))


def numbered(df: DataFrame, *order: str, alias: str = "row_id") -> DataFrame:
    """1-based places by ``order``."""
    ranged = _ranged(df, list(order))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__local", local).join(_bases(ranged, F.lit(1)), "__range").withColumn(alias, F.col("__local") + F.col("__base")).drop("__local", "__base", "__range")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(__v, __c, __less, __n): distinct values, their rows, the smaller rows and all rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    ranged = _ranged(counts, ["__v"])
    before = F.sum("__c").over(Window.partitionBy("__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    total = counts.agg(F.sum("__c").alias("__n"))  # one row
    out = ranged.withColumn("__before", before).join(_bases(ranged, F.col("__c")), "__range")
    return out.crossJoin(F.broadcast(total)).select("__v", "__c", (F.col("__before") + F.col("__base")).alias("__less"), "__n")


def running(df: DataFrame, value: str, by: list[str], order: list[str], alias: str) -> DataFrame:
    """Running sums of each group by ``order``; a large group is dealt over its ranges."""
    ranged = _ranged(df, [*by, *order])
    local = F.sum(value).over(Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    base = _bases(ranged, F.col(value), by)
    out = ranged.withColumn("__at", local).alias("l").join(base.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__range"]])
    return out.select(*[F.col(f"l.`{c}`") for c in df.columns if c != alias], (F.coalesce("__at", F.lit(0)) + F.coalesce("__base", F.lit(0))).alias(alias))


def at_ranks(df: DataFrame, value: str, ranks) -> tuple[int, dict[int, float]]:
    """(n, the value at each 0-based rank of ``ranks(n)``) over the rows that aren't null.

    A selection in passes: each counts the ranges, and only those that hold a wanted rank are read
    on, until they are small or hold one value. No pass shuffles rows.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")

    def count(part: DataFrame) -> list:
        edges = bounds(part, ["v"])
        part = part.withColumn("r", range_of(part, ["v"], edges))
        got = part.groupBy("r").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect()
        return [(part.where(F.col("r") == g.r).select("v"), g) for g in got]

    found: dict[int, float] = {}

    def look(ranges: list, wanted: list[int], before: int) -> None:
        for part, g in ranges:
            inside = [k for k in wanted if before <= k < before + g.n]
            if inside and g.lo == g.hi:
                found.update({k: g.lo for k in inside})
            elif inside and g.n <= SMALL:
                held = part.agg(F.sort_array(F.collect_list("v")).alias("v"))
                cells = held.select(*[F.element_at("v", k - before + 1) for k in inside]).first()
                found.update(zip(inside, cells))
            elif inside:
                look(count(part), inside, before)
            before += g.n

    ranges = count(rows)
    n = sum(g.n for _, g in ranges)
    look(ranges, sorted({k for k in ranks(n) if 0 <= k < n}), 0)
    return n, found


def places(shares: list[float], exclusive: bool = False):
    """(place(n, p), ranks(n)): 0-based fractional places of shares; exclusive ones count from 1 to n of n + 1."""

    def place(n: int, p: float) -> float:
        return (n + 1) * p - 1 if exclusive else (n - 1) * p

    def ranks(n: int) -> list[int]:
        return [k for p in shares for k in (math.floor(place(n, p)), math.ceil(place(n, p)))]

    return place, ranks


def percentiles(df: DataFrame, value: str, shares: dict[str, float], exclusive: bool = False) -> DataFrame:
    """PERCENTILE.INC or .EXC of several shares as one row; null (#NUM!) where there is none."""
    place, ranks = places(list(shares.values()), exclusive)
    n, at = at_ranks(df, value, ranks)
    out = []
    for p in shares.values():
        x = place(n, p)
        lo, hi = math.floor(x), math.ceil(x)
        out.append(at[lo] + (at[hi] - at[lo]) * (x - lo) if lo in at and hi in at and 0 <= p <= 1 else None)
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"`{a}` double" for a in shares))


def latest(keys: DataFrame, key: str, table: DataFrame, bound: str, result: str, alias: str, following: bool = False) -> DataFrame:
    """``keys`` with the result of the largest bound at most the key (``following``: the smallest at least it).

    Distinct keys and bounds are laid in one order by ranges, and the last bound is carried on, over
    a range's edge by one row for each range. Of equal bounds the least result counts. Rows then take
    the result of their key by an equi-join, so a hot key is looked up once.
    """
    kind = table.schema[bound].dataType
    side = table.where(F.col(bound).isNotNull()).groupBy(F.col(bound).alias("__v")).agg(F.struct(F.min(result).alias("r")).alias("__r"))
    asked = keys.select(F.col(key).cast(kind).alias("__v")).where("__v is not null").distinct().withColumn("__r", F.lit(None).cast(side.schema["__r"].dataType))
    edges = bounds(side, ["__v"])
    both = asked.withColumn("__q", F.lit(True)).unionByName(side.withColumn("__q", F.lit(False)))
    both = both.withColumn("__range", range_of(both, ["__v"], edges))
    # the bound itself stands before an equal key in either direction
    order = [F.desc("__v") if following else F.asc("__v"), F.asc("__q")]
    carried = F.last("__r", ignorenulls=True).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = both.where("not __q").groupBy("__range").agg((F.min_by if following else F.max_by)("__r", "__v").alias("__e"))
    step = F.desc("__range") if following else F.asc("__range")
    every = keys.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("__range")).join(ends, "__range", "left")
    edge = every.select("__range", F.last("__e", ignorenulls=True).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)).alias("__e"))
    answer = both.withColumn("__a", carried).where("__q").join(F.broadcast(edge), "__range").select("__v", F.coalesce("__a", "__e")["r"].alias(alias))
    return keys.join(answer, F.col(key).cast(kind) == F.col("__v"), "left").drop("__v")
