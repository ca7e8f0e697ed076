"""Formulas over whole columns as queries, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relations import copied_down, spill

#: Names in formulas: table and the columns that give its rows' places.
PLACES = {"part": ["p_partkey"], "orders": ["o_orderkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


def tables(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, list[str]]]:
    return {n: (spark.read.parquet(f"{folder}/{n}.parquet"), o) for n, o in PLACES.items()}


def _all(table: str, *exprs: str) -> str:
    return f"(SELECT {exprs[0]} FROM {table})"


def _mean(c: str, t: str) -> str:
    return f"(SELECT avg({c}) FROM {t})"


def _between(c: str, t: str, place: str) -> str:
    """The value at a fractional 0-based place of the sorted column."""
    return f"(SELECT max(v) FILTER (WHERE i = floor(p)) + (p - floor(p)) * (max(v) FILTER (WHERE i = ceil(p)) - max(v) FILTER (WHERE i = floor(p))) FROM (SELECT v, i, {place} AS p FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER ()::DOUBLE AS n FROM {t})) GROUP BY p)"


_T1 = "(SELECT s_acctbal AS x, s_nationkey * 300.0::DOUBLE AS y FROM supplier)"
_REC = "lineitem WHERE (l_returnflag = 'A' AND l_quantity > 30) OR (l_returnflag = 'N' AND l_discount < 0.05)"
_BLOCK = '{"l_returnflag","l_quantity","l_discount";"A",">30","";"N","","<0.05"}'
_FLOW = "(SELECT s_suppkey AS i, CASE WHEN s_suppkey = 0 THEN -50000.0 ELSE s_acctbal END AS v FROM supplier)"
_KURT = "(n*(n+1)/((n-1)*(n-2)*(n-3))*m4/power(s, 4) - 3*(n-1)*(n-1)/((n-2)*(n-3)))"

#: Family: (formula, SQL) of each cell of one row.
CELLS: dict[str, list[tuple[str, str]]] = {
    "rel_aggregates": [
        ("=SUM(lineitem[l_quantity])", _all("lineitem", "sum(l_quantity)")), ("=COUNT(lineitem[l_quantity])", _all("lineitem", "count(*)")), ("=COUNTA(part[p_name])", _all("part", "count(p_name)")), ("=COUNTBLANK(part[p_name])", "0"), ("=AVERAGE(lineitem[l_discount])", _all("lineitem", "avg(l_discount)")),
        ("=MAX(orders[o_totalprice])", _all("orders", "max(o_totalprice)")), ("=MIN(orders[o_totalprice])", _all("orders", "min(o_totalprice)")), ("=PRODUCT(nation[n_nationkey])", "0"), ("=SUMSQ(part[p_size])", _all("part", "sum(p_size * p_size)")), ("=STDEV.S(part[p_size])", _all("part", "stddev_samp(p_size)")),
        ("=STDEV.P(part[p_size])", _all("part", "stddev_pop(p_size)")), ("=VAR.S(part[p_size])", _all("part", "var_samp(p_size)")), ("=VAR.P(part[p_size])", _all("part", "var_pop(p_size)")), ("=GEOMEAN(part[p_size])", _all("part", "exp(avg(ln(p_size)))")), ("=HARMEAN(part[p_size])", _all("part", "count(*) / sum(1.0::DOUBLE / p_size)")),
        ("=DEVSQ(part[p_size])", _all("part", "var_pop(p_size) * count(*)")), ("=AVEDEV(part[p_size])", f"(SELECT avg(abs(p_size - {_mean('p_size', 'part')})) FROM part)"), ("=SKEW(part[p_size])", _all("part", "skewness(p_size)")), ("=SKEW.P(part[p_size])", f"(SELECT avg(power(p_size - {_mean('p_size', 'part')}, 3)) / power(stddev_pop(p_size), 3) FROM part)"),
        ("=KURT(part[p_size])", f"(SELECT {_KURT} FROM (SELECT count(*)::DOUBLE AS n, sum(power(p_size - {_mean('p_size', 'part')}, 4)) AS m4, stddev_samp(p_size) AS s FROM part))"), ("=MODE.SNGL(part[p_size])", "(SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
        ("=AVERAGEA(part[p_size],nation[n_name])", "(SELECT sum(p_size) / (count(*) + 25) FROM part)"), ("=MAXA(part[p_size])", _all("part", "max(p_size)")), ("=MINA(part[p_name],part[p_size])", "0"), ("=STDEVA(part[p_size])", _all("part", "stddev_samp(p_size)")), ("=STDEVPA(part[p_size])", _all("part", "stddev_pop(p_size)")),
        ("=VARA(part[p_size])", _all("part", "var_samp(p_size)")), ("=VARPA(part[p_size])", _all("part", "var_pop(p_size)")), ("=SUBTOTAL(9,part[p_size])", _all("part", "sum(p_size)")), ("=SUBTOTAL(101,part[p_size])", _all("part", "avg(p_size)")), ("=AGGREGATE(14-10,2,part[p_size]/(part[p_size]-1))", "(SELECT max(p_size / (p_size - 1)) FROM part WHERE p_size <> 1)"),
        ("=SUM(part[p_size]*2+1)", _all("part", "sum(p_size * 2 + 1)")), ("=SUM(part[p_size],nation[n_nationkey])", "(SELECT sum(p_size) FROM part) + (SELECT sum(n_nationkey) FROM nation)"), ("=IFERROR(SUM(1/(part[p_size]-1)),-1)", "-1"), ("=ROWS(part[#Data])", _all("part", "count(*)")), ("=COLUMNS(part[#Data])", "6"), ("=COLUMNS(part[[p_name]:[p_type]])", "3"),
        ("=SUM(INDIRECT(\"part[p_size]\"))", _all("part", "sum(p_size)")), ("=SUM(OFFSET(part[p_name],2,3,5))", "(SELECT sum(p_size) FROM part WHERE p_partkey BETWEEN 2 AND 6)"), ("=ADDRESS(3,28,4)&ADDRESS(1,2)", "'AB3$B$1'"),
        ("=LET(s,part[p_size],SUM(s)/COUNT(s))", _all("part", "avg(p_size)")), ("=SUMPRODUCT(part[p_size],part[p_retailprice])", _all("part", "sum(p_size * p_retailprice)")), ("=SUMPRODUCT((part[p_size]>25)*part[p_retailprice])", "(SELECT sum(p_retailprice) FROM part WHERE p_size > 25)"),
    ],
    "rel_order_statistics": [
        ("=MEDIAN(part[p_retailprice])", _all("part", "median(p_retailprice)")), ("=PERCENTILE.INC(orders[o_totalprice],0.9)", _all("orders", "quantile_cont(o_totalprice, 0.9)")), ("=PERCENTILE.EXC(orders[o_totalprice],0.9)", _between("o_totalprice", "orders", "(n + 1) * 0.9::DOUBLE - 1")),
        ("=QUARTILE.INC(orders[o_totalprice],1)", _all("orders", "quantile_cont(o_totalprice, 0.25)")), ("=QUARTILE.EXC(orders[o_totalprice],3)", _between("o_totalprice", "orders", "(n + 1) * 0.75::DOUBLE - 1")), ("=LARGE(orders[o_totalprice],7)", "(SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 6)"), ("=SMALL(orders[o_totalprice],7)", "(SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 1 OFFSET 6)"),
        ("=TRIMMEAN(orders[o_totalprice],0.2)", "(SELECT avg(v) FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1))"), ("=RANK.EQ(25,part[p_size])", "(SELECT CASE WHEN count(*) FILTER (WHERE p_size = 25) > 0 THEN count(*) FILTER (WHERE p_size > 25) + 1 END FROM part)"),
        ("=RANK.AVG(25,part[p_size],1)", "(SELECT CASE WHEN count(*) FILTER (WHERE p_size = 25) > 0 THEN count(*) FILTER (WHERE p_size < 25) + (count(*) FILTER (WHERE p_size = 25) + 1) / 2 END FROM part)"), ("=PERCENTRANK.INC(orders[o_totalprice],250000,6)", "(SELECT floor((less + (250000 - lo) / (hi - lo)) / (n - 1) * 1000000 + 1e-9) / 1000000 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 250000) - 1 AS less, max(o_totalprice) FILTER (WHERE o_totalprice < 250000) AS lo, min(o_totalprice) FILTER (WHERE o_totalprice > 250000) AS hi, count(*) AS n FROM orders))"),
        ("=PERCENTRANK.EXC(orders[o_totalprice],250000,6)", "(SELECT floor((less + 1 + (250000 - lo) / (hi - lo)) / (n + 1) * 1000000 + 1e-9) / 1000000 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 250000) - 1 AS less, max(o_totalprice) FILTER (WHERE o_totalprice < 250000) AS lo, min(o_totalprice) FILTER (WHERE o_totalprice > 250000) AS hi, count(*) AS n FROM orders))"),
    ],
    "rel_conditional": [
        ("=SUMIF(lineitem[l_returnflag],\"a\",lineitem[l_quantity])", "(SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = 'A')"), ("=SUMIFS(lineitem[l_extendedprice],lineitem[l_quantity],\">=25\",lineitem[l_returnflag],\"<>R\")", "(SELECT sum(l_extendedprice) FROM lineitem WHERE l_quantity >= 25 AND l_returnflag <> 'R')"),
        ("=COUNTIF(part[p_type],\"*a*\")", "(SELECT count(*) FROM part WHERE lower(p_type) LIKE '%a%')"), ("=COUNTIFS(part[p_size],\">10\",part[p_size],\"<=\"&20+5)", "(SELECT count(*) FROM part WHERE p_size > 10 AND p_size <= 25)"), ("=AVERAGEIF(part[p_size],\">40\",part[p_retailprice])", "(SELECT avg(p_retailprice) FROM part WHERE p_size > 40)"),
        ("=AVERAGEIFS(part[p_retailprice],part[p_size],25)", "(SELECT avg(p_retailprice) FROM part WHERE p_size = 25)"), ("=MAXIFS(part[p_retailprice],part[p_size],\"<10\")", "(SELECT coalesce(max(p_retailprice), 0) FROM part WHERE p_size < 10)"), ("=MINIFS(part[p_retailprice],part[p_size],\">=10\")", "(SELECT coalesce(min(p_retailprice), 0) FROM part WHERE p_size >= 10)"),
        ("=COUNTIF(part[p_retailprice],\">\"&AVERAGE(part[p_retailprice]))", f"(SELECT count(*) FROM part WHERE p_retailprice > {_mean('p_retailprice', 'part')})"), ("=SUM(FILTER(part[p_size],part[p_retailprice]>AVERAGE(part[p_retailprice])))", f"(SELECT sum(p_size) FROM part WHERE p_retailprice > {_mean('p_retailprice', 'part')})"),
        ("=ROWS(UNIQUE(part[p_brand]))", _all("part", "count(DISTINCT p_brand)")), ("=IFERROR(AVERAGEIF(part[p_size],\">999\"),-1)", "-1"),
    ],
    "rel_database": [
        (f"={f}(lineitem[#All],\"{c}\",{_BLOCK})", f"(SELECT {sql} FROM {_REC})")
        for f, c, sql in (
            ("DSUM", "l_quantity", "sum(l_quantity)"), ("DAVERAGE", "l_quantity", "avg(l_quantity)"), ("DCOUNT", "l_quantity", "count(*)"), ("DCOUNTA", "l_returnflag", "count(*)"), ("DMAX", "l_extendedprice", "max(l_extendedprice)"), ("DMIN", "l_extendedprice", "min(l_extendedprice)"),
            ("DSTDEV", "l_quantity", "stddev_samp(l_quantity)"), ("DSTDEVP", "l_quantity", "stddev_pop(l_quantity)"), ("DVAR", "l_quantity", "var_samp(l_quantity)"), ("DVARP", "l_quantity", "var_pop(l_quantity)"),
        )
    ] + [("=DPRODUCT(nation[#All],\"n_nationkey\",{\"n_nationkey\";\">20\"})", "255024"), ("=DGET(nation[#All],\"n_regionkey\",{\"n_nationkey\";7})", "(SELECT n_regionkey FROM nation WHERE n_nationkey = 7)"), ("=IFERROR(DGET(nation[#All],\"n_regionkey\",{\"n_nationkey\";\">7\"}),-1)", "-1")],
    "rel_regression": [
        (f"={f}(supplier[s_acctbal],supplier[s_nationkey])", f"(SELECT {sql} FROM supplier)")
        for f, sql in (
            ("CORREL", "corr(s_acctbal, s_nationkey)"), ("PEARSON", "corr(s_acctbal, s_nationkey)"), ("RSQ", "regr_r2(s_acctbal, s_nationkey)"), ("SLOPE", "regr_slope(s_acctbal, s_nationkey)"), ("INTERCEPT", "regr_intercept(s_acctbal, s_nationkey)"), ("COVARIANCE.S", "covar_samp(s_acctbal, s_nationkey)"), ("COVARIANCE.P", "covar_pop(s_acctbal, s_nationkey)"),
            ("STEYX", "sqrt((regr_syy(s_acctbal, s_nationkey) - regr_sxy(s_acctbal, s_nationkey) * regr_sxy(s_acctbal, s_nationkey) / regr_sxx(s_acctbal, s_nationkey)) / (count(*) - 2))"),
            ("SUMXMY2", "sum((s_acctbal - s_nationkey) * (s_acctbal - s_nationkey))"), ("SUMX2MY2", "sum(s_acctbal * s_acctbal - s_nationkey * s_nationkey)"), ("SUMX2PY2", "sum(s_acctbal * s_acctbal + s_nationkey * s_nationkey)"),
        )
    ] + [
        ("=FORECAST.LINEAR(12.5,supplier[s_acctbal],supplier[s_nationkey])", "(SELECT regr_intercept(s_acctbal, s_nationkey) + 12.5 * regr_slope(s_acctbal, s_nationkey) FROM supplier)"), ("=TREND(supplier[s_acctbal],supplier[s_nationkey],3)", "(SELECT regr_intercept(s_acctbal, s_nationkey) + 3 * regr_slope(s_acctbal, s_nationkey) FROM supplier)"),
        ("=GROWTH(part[p_retailprice],part[p_size],3)", "(SELECT exp(regr_intercept(ln(p_retailprice), p_size) + 3 * regr_slope(ln(p_retailprice), p_size)) FROM part)"), ("=INDEX(LINEST(supplier[s_acctbal],supplier[s_nationkey]),1,1)", "(SELECT regr_slope(s_acctbal, s_nationkey) FROM supplier)"),
        ("=INDEX(LINEST(supplier[s_acctbal],supplier[s_nationkey],TRUE,TRUE),3,1)", "(SELECT regr_r2(s_acctbal, s_nationkey) FROM supplier)"), ("=INDEX(LOGEST(part[p_retailprice],part[p_size]),1,2)", "(SELECT exp(regr_intercept(ln(p_retailprice), p_size)) FROM part)"),
    ],
    "rel_cash_flows": [
        ("=NPV(0.07,IF(supplier[s_suppkey]=0,-50000,supplier[s_acctbal]))", f"(SELECT sum(v / power(1.07, i + 1)) FROM {_FLOW})"), ("=XNPV(0.07,IF(supplier[s_suppkey]=0,-50000,supplier[s_acctbal]),44000+supplier[s_suppkey]*20)", f"(SELECT sum(v / power(1.07, i * 20 / 365)) FROM {_FLOW})"),
        ("=IRR({-1000,600,600})", "(-1000 + sqrt(0.0)) * 0 + (0.6 + sqrt(0.36 + 4 * 0.6)) / 2 - 1"), ("=XIRR({-1000,1210},{44000,44730})", "0.1"), ("=MIRR({-1000,300,400,500},0.1,0.12)", "power((300 * 1.12 * 1.12 + 400 * 1.12 + 500) / 1000, 1 / 3::DOUBLE) - 1"), ("=NPV(0.1,{110,121})", "200"),
        ("=MIRR(IF(supplier[s_suppkey]=0,-50000,ABS(supplier[s_acctbal])),0.1,0.05)", f"(SELECT power(sum(abs(v) * power(1.05, n - i)) FILTER (WHERE i > 0) / 50000, 1 / max(n)::DOUBLE) - 1 FROM (SELECT *, max(i) OVER () AS n FROM {_FLOW}))"),
    ],
    "rel_arrays_in_cells": [
        ("=VLOOKUP(2,{1,\"a\";2,\"b\"},2,FALSE)", "'b'"), ("=HLOOKUP(\"y\",{\"x\",\"y\";1,2},2,FALSE)", "2"), ("=XLOOKUP(\"k\",{\"j\",\"k\"},{5,6})", "6"), ("=XLOOKUP(9,{1,2},{5,6},-1)", "-1"), ("=XLOOKUP(2.5,{1,2,3},{10,20,30},,-1)", "20"), ("=XLOOKUP(2.5,{1,2,3},{10,20,30},,1)", "30"), ("=XLOOKUP(1,{1,2,1},{10,20,30},,0,-1)", "30"),
        ("=MATCH(2.5,{1,2,3},1)", "2"), ("=MATCH(3,{1,2,3},0)", "3"), ("=XMATCH(1,{1,2,1},0,-1)", "3"), ("=LOOKUP(2.5,{1,2,3},{\"a\",\"b\",\"c\"})", "'b'"), ("=INDEX({1,2;3,4},2,1)", "3"), ("=SUM({1,2,3}*{4,5,6})", "32"), ("=SUM(ABS({-1,2;-3,4}))", "10"), ("=SUMPRODUCT({1,2,3},{4,5,6})", "32"),
        ("=MEDIAN({5,1,9,3})", "4"), ("=STDEV.S({1,2,3,4})", "sqrt(5 / 3::DOUBLE)"), ("=LARGE({5,1,9,3},2)", "5"), ("=COUNTIF({1,5,9},\">4\")", "2"), ("=ARRAYTOTEXT({1,\"a\";TRUE,2})", "'1, a, TRUE, 2'"), ("=ARRAYTOTEXT({1,\"a\"},1)", "'{1,\"a\"}'"), ("=INDEX(CHOOSECOLS({1,2,3},-1,1),1,1)", "3"), ("=INDEX(CHOOSEROWS({1;2;3},2),1)", "2"),
        ("=INDEX(TOROW({1,2;3,4},0,TRUE),2)", "3"), ("=INDEX(TRANSPOSE({1,2;3,4}),1,2)", "3"), ("=SUM(SEQUENCE(4,2,10,5))", "220"), ("=SUM(RANDARRAY(5,2,3,3))", "30"), ("=ROWS(VSTACK({1,2},{3,4}))", "2"), ("=COLUMNS(HSTACK({1;2},{3;4}))", "2"), ("=INDEX(TAKE({1;2;3},-1),1)", "3"), ("=ROWS(DROP({1;2;3},1))", "2"), ("=SUM(TOCOL({1,2;3,4}))", "10"),
        ("=IFERROR(ROWS(TAKE({1;2},5)),-1)", "-1"), ("=CHISQ.TEST({58,35;11,25;10,23},{45.35,47.65;17.56,18.44;16.09,16.91})", "exp(-16.169575885868426 / 2)"),
        ("=T.TEST({3,4,5,8,9,1,2,4,5},{6,19,3,2,14,4,5,17,1},2,1)", "0.196015785"), ("=F.TEST({6,7,9,15,21},{20,28,31,38,40})", "0.64831785"), ("=Z.TEST({3,6,7,8,6,5,4,2,1,9},4)", "0.090574197"), ("=SUM(FREQUENCY({1,2,3,4,5},{2,4}))", "5"), ("=SUM(MODE.MULT({1,2,2,3,3}))", "5"),
    ],
}

#: Formulas copied down a table: table, key, (name, formula, SQL over the table).
DOWN: dict[str, tuple[str, str, list[tuple[str, str, str]]]] = {
    "rel_lookups_down": ("customer", "c_custkey", [
        ("nation", "=XLOOKUP([c_nationkey],nation[n_nationkey],nation[n_name],\"?\")", "(SELECT n_name FROM nation WHERE n_nationkey = c_nationkey)"), ("region", "=VLOOKUP([c_nationkey],nation[[n_nationkey]:[n_regionkey]],3,FALSE)", "(SELECT n_regionkey FROM nation WHERE n_nationkey = c_nationkey)::DOUBLE"),
        ("first", "=XLOOKUP([c_custkey],orders[o_custkey],orders[o_totalprice])", "(SELECT arg_min(o_totalprice, o_orderkey) FROM orders WHERE o_custkey = c_custkey)"), ("last", "=XLOOKUP([c_custkey],orders[o_custkey],orders[o_totalprice],,0,-1)", "(SELECT arg_max(o_totalprice, o_orderkey) FROM orders WHERE o_custkey = c_custkey)"),
        ("at", "=MATCH([c_nationkey],nation[n_nationkey],0)", "(c_nationkey + 1)::DOUBLE"), ("cell", "=INDEX(nation[n_name],MATCH([c_nationkey],nation[n_nationkey],0))", "(SELECT n_name FROM nation WHERE n_nationkey = c_nationkey)"),
        ("below", "=LOOKUP([c_acctbal]/10+900,part[p_retailprice],part[p_partkey])", "(SELECT max(p_partkey) FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part WHERE p_retailprice <= c_acctbal / 10 + 900))"), ("above", "=XLOOKUP([c_acctbal]/10+900,part[p_retailprice],part[p_partkey],,1)", "(SELECT arg_min(p_partkey, p_retailprice) FROM part WHERE p_retailprice >= c_acctbal / 10 + 900)"),
        ("place", "=XMATCH([c_acctbal]/10+900,part[p_retailprice],-1)", "(SELECT max(p_partkey) + 1 FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part WHERE p_retailprice <= c_acctbal / 10 + 900))::DOUBLE"),
    ]),
    "rel_conditional_down": ("customer", "c_custkey", [
        ("total", "=SUMIFS(orders[o_totalprice],orders[o_custkey],[c_custkey],orders[o_orderstatus],\"F\")", "coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0)"), ("n", "=COUNTIF(orders[o_custkey],[c_custkey])", "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey)"),
        ("mean", "=AVERAGEIFS(orders[o_totalprice],orders[o_custkey],[c_custkey])", "(SELECT avg(o_totalprice) FROM orders WHERE o_custkey = c_custkey)"), ("most", "=MAXIFS(orders[o_totalprice],orders[o_custkey],[c_custkey])", "coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0)"),
        ("share", "=[c_acctbal]/SUM(customer[c_acctbal])", "c_acctbal / (SELECT sum(c_acctbal) FROM customer)"), ("place", "=RANK.EQ([c_acctbal],customer[c_acctbal])", "(SELECT count(*) + 1 FROM customer x WHERE x.c_acctbal > customer.c_acctbal)"),
        ("dearer", "=COUNTIFS(part[p_retailprice],\">=\"&([c_acctbal]/10+900))", "(SELECT count(*) FROM part WHERE p_retailprice >= c_acctbal / 10 + 900)"), ("cheaper", "=SUMIFS(part[p_size],part[p_retailprice],\"<\"&([c_acctbal]/10+900))", "coalesce((SELECT sum(p_size) FROM part WHERE p_retailprice < c_acctbal / 10 + 900), 0)"),
        ("fit", "=TREND(part[p_retailprice],part[p_size],[c_nationkey])", "(SELECT regr_intercept(p_retailprice, p_size) + regr_slope(p_retailprice, p_size) * c_nationkey FROM part)"),
    ]),
    "rel_references_down": ("supplier", "s_suppkey", [
        ("row", "=ROW()", "s_suppkey + 1"), ("col", "=COLUMN([s_acctbal])", "4"), ("before", "=IFERROR(OFFSET([s_acctbal],-1,0),0)", "coalesce(lag(s_acctbal) OVER (ORDER BY s_suppkey), 0)"), ("text", "=FORMULATEXT([row])", "'=ROW()'"), ("formula", "=ISFORMULA([row])", "true"), ("ref", "=ISREF([s_acctbal])", "true"), ("address", "=ADDRESS(ROW(),4)", "'$D$' || (s_suppkey + 1)"),
        ("tail", "=TAKE(supplier[s_acctbal],-1)", "(SELECT arg_max(s_acctbal, s_suppkey) FROM supplier)"),
    ]),
}

#: Formulas that are arrays, with their rows.
SPILLS: dict[str, tuple[str, str]] = {
    "spill_filter": ("=FILTER(part[[p_partkey]:[p_name]],(part[p_size]>40)*(part[p_brand]=\"brand#2\"))", "SELECT p_partkey AS c1, p_name AS c2 FROM part WHERE p_size > 40 AND p_brand = 'Brand#2'"),
    "spill_filter_empty": ("=FILTER(part[p_partkey],part[p_size]>999,\"none\")", "SELECT 'none' AS c1"),
    "spill_sort_take": ("=TAKE(SORT(CHOOSECOLS(orders[#Data],4,1),1,-1),7)", "SELECT o_totalprice AS c1, o_orderkey AS c2 FROM orders ORDER BY 1 DESC, 2 LIMIT 7"),
    "spill_sortby_drop": ("=DROP(SORTBY(supplier[s_name],supplier[s_acctbal],-1),5)", "SELECT s_name AS c1 FROM supplier ORDER BY s_acctbal DESC, s_suppkey OFFSET 5"),
    "spill_unique": ("=UNIQUE(part[[p_brand]:[p_type]])", "SELECT DISTINCT p_brand AS c1, p_type AS c2 FROM part"),
    "spill_unique_once": ("=UNIQUE(customer[c_acctbal],FALSE,TRUE)", "SELECT c_acctbal AS c1 FROM customer GROUP BY 1 HAVING count(*) = 1"),
    "spill_vstack": ("=UNIQUE(VSTACK(nation[n_name],region[r_name]))", "SELECT n_name AS c1 FROM nation UNION SELECT r_name FROM region"),
    "spill_hstack": ("=HSTACK(nation[n_name],region[r_name])", "SELECT n_name AS c1, r_name AS c2 FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)"),
    "spill_chooserows": ("=CHOOSEROWS(nation[[n_nationkey]:[n_name]],3,-1,3)", "SELECT n_nationkey AS c1, n_name AS c2 FROM nation WHERE n_nationkey IN (2, 24) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 2"),
    "spill_tocol": ("=TOCOL(nation[[n_nationkey]:[n_name]])", "SELECT n_nationkey::VARCHAR AS c1 FROM nation UNION ALL SELECT n_name FROM nation"),
    "spill_transpose": ("=TRANSPOSE(CHOOSECOLS(region[#Data],2))", "SELECT max(r_name) FILTER (WHERE r_regionkey = 0) AS c1, max(r_name) FILTER (WHERE r_regionkey = 1) AS c2, max(r_name) FILTER (WHERE r_regionkey = 2) AS c3, max(r_name) FILTER (WHERE r_regionkey = 3) AS c4, max(r_name) FILTER (WHERE r_regionkey = 4) AS c5 FROM region"),
    "spill_sequence": ("=SEQUENCE(50,2,3,0.5)", "SELECT 3 + i * 1.0::DOUBLE AS c1, 3.5 + i * 1.0::DOUBLE AS c2 FROM range(50) t(i)"),
    "spill_groupby": ("=GROUPBY(part[[p_brand]:[p_type]],part[p_size],SUM)", "SELECT p_brand AS c1, p_type AS c2, sum(p_size)::DOUBLE AS c3 FROM part GROUP BY 1, 2"),
    "spill_groupby_total": ("=GROUPBY(orders[o_orderstatus],orders[o_custkey],MEDIAN,,1)", "SELECT coalesce(o_orderstatus, 'Grand Total') AS c1, median(o_custkey) AS c2 FROM orders GROUP BY ROLLUP (o_orderstatus)"),
    "spill_pivotby": ("=PIVOTBY(part[p_brand],part[p_type],part[p_size],MAX)", "SELECT p_brand AS c1, " + ", ".join(f"max(p_size) FILTER (WHERE p_type = t[{i}])::DOUBLE AS c{i + 1}" for i in range(1, 7)) + " FROM part, (SELECT list(DISTINCT p_type ORDER BY p_type) AS t FROM part) GROUP BY p_brand, t"),
    "spill_frequency": ("=FREQUENCY(orders[o_totalprice],{50000,100000,200000})", "SELECT count(o_orderkey)::DOUBLE AS c1 FROM range(4) b(bin) LEFT JOIN orders ON bin = CASE WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice <= 100000 THEN 1 WHEN o_totalprice <= 200000 THEN 2 ELSE 3 END GROUP BY bin"),
    "spill_textsplit": ("=TEXTSPLIT(\"a,b;c,d\",\",\",\";\")", "SELECT * FROM (VALUES ('a', 'b'), ('c', 'd')) t(c1, c2)"),
    "spill_mode_mult": ("=MODE.MULT(part[p_size])", "SELECT p_size::DOUBLE AS c1 FROM (SELECT p_size, rank() OVER (ORDER BY count(*) DESC) AS k, count(*) AS n FROM part GROUP BY 1) WHERE k = 1 AND n > 1"),
    "spill_trend": ("=ROUND(TREND(supplier[s_acctbal],supplier[s_nationkey]),4)", "SELECT round(regr_intercept(s_acctbal, s_nationkey) OVER () + regr_slope(s_acctbal, s_nationkey) OVER () * s_nationkey, 4) AS c1 FROM supplier"),
    "spill_array_formula": ("=ROUND(part[p_size]*part[p_retailprice],3)", "SELECT round(p_size * p_retailprice, 3) AS c1 FROM part"),
}


def _row(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = copied_down(spark.range(1), {f"c{i:02d}": f for i, (f, _) in enumerate(CELLS[name])}, tables(spark, folder)).drop("id")
        return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in ((c, out.schema[c].dataType.simpleString()) for c in out.columns)])

    return run


def _down(name: str):
    table, key, formulas = DOWN[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        known = tables(spark, folder)
        out = copied_down(known[table][0], {n: f for n, f, _ in formulas}, known, known[table][1])
        return out.select(key, *[F.round(n, 6).alias(n) if out.schema[n].dataType.simpleString() == "double" else F.col(n) for n, _, _ in formulas])

    return run


def _spill(name: str):
    return lambda spark, folder: spill(spark, SPILLS[name][0], tables(spark, folder))


def _cell(sql: str) -> bool:
    return sql.startswith("'")


QUERIES = {n: _row(n) for n in CELLS} | {n: _down(n) for n in DOWN} | {n: _spill(n) for n in SPILLS}
SQL = {n: "SELECT " + ", ".join(f"{q} AS c{i:02d}" if _cell(q) else f"round(({q})::DOUBLE, 5) AS c{i:02d}" for i, (_, q) in enumerate(cells)) for n, cells in CELLS.items()}
SQL |= {n: f"SELECT {k}, " + ", ".join(f"{q} AS {c}" if c in ("nation", "cell", "text", "formula", "ref", "address", "below", "above") else f"round(({q})::DOUBLE, 6) AS {c}" for c, _, q in cells) + f" FROM {t}" for n, (t, k, cells) in DOWN.items()}
SQL |= {n: q for n, (_, q) in SPILLS.items()}
