"""Spreadsheet operators as queries over the star-schema tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import function_queries, relation_queries
from .compiler import add_columns
from .operators import aggregates as ag
from .operators import arrays as ar
from .operators import lookups as lk
from .operators import windows as wi
from .streaming import events as ev

QUERIES: dict = function_queries.QUERIES | relation_queries.QUERIES
SQL: dict[str, str] = function_queries.SQL | relation_queries.SQL


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(c: str, digits: int = 4):
    return F.round(F.col(c), digits).alias(c)


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def groupby_sum(s, d):
    return ag.groupby(t(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "SUM", "total").select("l_returnflag", r("total", 2))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())")
def groupby_total(s, d):
    return ag.groupby(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", 1, "mean", total=True).select("l_returnflag", "l_linestatus", r("mean"))


@query("SELECT o_orderstatus, " + ", ".join(f"""nullif(count(*) FILTER (WHERE o_orderpriority = '{p}'), 0) AS "{p}" """ for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + ', count(*) AS "Total" FROM orders GROUP BY 1')
def pivotby_count(s, d):
    return ag.pivotby(t(s, d, "orders"), ["o_orderstatus"], "o_orderpriority", "o_totalprice", "COUNT", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], total=True)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND lower(o_orderstatus) = 'f'")
def filter_rows(s, d):
    return ar.filter_rows(t(s, d, "orders"), '=([o_totalprice]>1E5)*([o_orderstatus]="f")').select("o_orderkey", "o_totalprice")


@query("SELECT p_brand FROM part GROUP BY 1")
def unique(s, d):
    return ar.unique(t(s, d, "part"), "p_brand")


@query("SELECT c_acctbal FROM customer GROUP BY 1 HAVING count(*) = 1")
def unique_once(s, d):
    return ar.unique(t(s, d, "customer"), "c_acctbal", once=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sort_take(s, d):
    return ar.take(t(s, d, "orders"), 10, [("o_totalprice", -1)], ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey OFFSET 5")
def sort_drop(s, d):
    return ar.drop(t(s, d, "supplier"), 5, [("s_acctbal", 1)], ["s_suppkey"]).select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey, coalesce(n_name, '?') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def xlookup_nation(s, d):
    return lk.xlookup(t(s, d, "customer"), "c_nationkey", t(s, d, "nation"), "n_nationkey", "n_name", "nation", "n_nationkey", missing="?").select("c_custkey", "nation")


@query("SELECT c_custkey, k AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def xlookup_last(s, d):
    return lk.xlookup(t(s, d, "customer"), "c_custkey", t(s, d, "orders"), "o_custkey", "o_orderkey", "last_order", "o_orderkey", last=True).select("c_custkey", "last_order")


_BANDS = [(0.0, "low"), (1000.0, "mid"), (1500.0, "high")]


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1000 THEN 'mid' WHEN p_retailprice >= 0 THEN 'low' END AS band FROM part")
def lookup_asof(s, d):
    bands = s.createDataFrame(_BANDS, "lo double, name string")
    return lk.lookup_asof(t(s, d, "part"), "p_retailprice", bands, "lo", "name", "band").select("p_partkey", "band")


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 0 THEN 'low' WHEN p_retailprice <= 1000 THEN 'mid' WHEN p_retailprice <= 1500 THEN 'high' END AS band FROM part")
def lookup_next(s, d):
    bands = s.createDataFrame(_BANDS, "hi double, name string")
    return lk.lookup_next(t(s, d, "part"), "p_retailprice", bands, "hi", "name", "band").select("p_partkey", "band")


@query("SELECT n_nationkey, (SELECT count(*) FROM region WHERE r_regionkey <= n_regionkey) AS place FROM nation")
def match_position(s, d):
    return lk.match_position(t(s, d, "nation"), "n_regionkey", t(s, d, "region"), "r_regionkey", "r_regionkey", "place").select("n_nationkey", "place")


@query("SELECT n_name, o_orderstatus AS k, round(coalesce(x, 0), 2) AS total, coalesce(c, 0) AS n FROM (SELECT n_nationkey, n_name, o_orderstatus FROM nation, (SELECT DISTINCT o_orderstatus FROM orders)) a LEFT JOIN (SELECT c_nationkey, o_orderstatus AS st, sum(o_totalprice) AS x, count(o_totalprice) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) b ON n_nationkey = c_nationkey AND o_orderstatus = st")
def sumifs_report(s, d):
    facts = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderstatus", "o_totalprice")
    rows = t(s, d, "nation").crossJoin(t(s, d, "orders").select(F.col("o_orderstatus").alias("k")).distinct())  # 25 by 3 report rows
    out = ag.report(facts, {"c_nationkey": "n_nationkey", "o_orderstatus": "k"}, rows, {"total": ("SUM", "o_totalprice"), "n": ("COUNT", "o_totalprice")})
    return out.select("n_name", "k", r("total", 2), "n")


@query("SELECT count(*) AS n FROM part WHERE lower(p_type) LIKE '%steel%'")
def countif_wildcard(s, d):
    return ag.conditional(t(s, d, "part"), "COUNTIF", None, [("p_type", "*steel*")], "n")


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity >= 25 AND l_returnflag <> 'R'")
def sumifs(s, d):
    return ag.conditional(t(s, d, "lineitem"), "SUMIFS", "l_extendedprice", [("l_returnflag", "<>r"), ("l_quantity", ">=25")], "total").select(r("total", 2))


@query("SELECT round(avg(l_discount), 6) AS mean FROM lineitem WHERE l_linestatus = 'O'")
def averageifs(s, d):
    return ag.conditional(t(s, d, "lineitem"), "AVERAGEIFS", "l_discount", [("l_linestatus", "o")], "mean").select(r("mean", 6))


@query("SELECT coalesce(max(l_quantity), 0) AS most FROM lineitem WHERE l_returnflag = 'A'")
def maxifs(s, d):
    return ag.conditional(t(s, d, "lineitem"), "MAXIFS", "l_quantity", [("l_returnflag", "A")], "most")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(s, d):
    return lk.semi(t(s, d, "customer"), "c_custkey", t(s, d, "orders"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(s, d):
    return lk.anti(t(s, d, "customer"), "c_custkey", t(s, d, "orders"), "o_custkey").select("c_custkey")


@query("SELECT round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1 FROM lineitem")
def percentiles(s, d):
    return ag.percentile(t(s, d, "lineitem"), "l_extendedprice", {"med": 0.5, "p90": 0.9, "q1": 0.25}).select(r("med"), r("p90"), r("q1"))


@query("SELECT round(q, 3) AS p FROM (SELECT lo + (hi - lo) * (place - floor(place)) AS q FROM (SELECT max(v) FILTER (WHERE i = floor(place)) AS lo, max(v) FILTER (WHERE i = floor(place) + 1) AS hi, max(place) AS place FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, (count(*) OVER () + 1) * 0.9::DOUBLE AS place FROM orders)))")
def percentile_exc(s, d):
    return ag.percentile_exc(t(s, d, "orders"), "o_totalprice", 0.9, "p").select(r("p", 3))


@query("SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal DESC) AS place FROM supplier")
def rank_eq(s, d):
    return wi.rank(t(s, d, "supplier"), "s_acctbal", "place").select("s_suppkey", "place")


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS place FROM part")
def rank_avg(s, d):
    return wi.rank(t(s, d, "part"), "p_size", "place", average=True).select("p_partkey", "place")


@query("SELECT s_suppkey, floor(percent_rank() OVER (ORDER BY s_acctbal) * 1000 + 1e-9) / 1000 AS p FROM supplier")
def percentrank(s, d):
    return wi.percent_rank(t(s, d, "supplier"), "s_acctbal", "p").select("s_suppkey", "p")


@query("SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(regr_r2(y, x), 8) AS rsq, round(corr(y, x), 8) AS correl, round(covar_samp(y, x), 3) AS covariance_s, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2)), 3) AS steyx FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem)")
def regression(s, d):
    return wi.regression(t(s, d, "lineitem"), "l_extendedprice", "l_quantity").select(r("slope", 6), r("intercept", 3), r("rsq", 8), r("correl", 8), r("covariance_s", 3), r("steyx", 3))


@query("SELECT b.bin::INT AS bin, count(o_orderkey) AS n FROM range(5) b(bin) LEFT JOIN orders ON bin = CASE WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice <= 100000 THEN 1 WHEN o_totalprice <= 200000 THEN 2 WHEN o_totalprice <= 900000 THEN 3 ELSE 4 END GROUP BY 1")
def frequency(s, d):
    return wi.frequency(t(s, d, "orders"), "o_totalprice", [50_000, 100_000, 200_000, 900_000])


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def running_total(s, d):
    return wi.running_total(t(s, d, "events"), "value", ["user_id"], ["ts", "event_id"], "total").select("event_id", r("total"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 4) AS mean, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS step FROM events")
def rolling_and_delta(s, d):
    e = wi.rolling(t(s, d, "events"), "AVERAGE", "value", 3, ["user_id"], ["ts", "event_id"], "mean")
    return wi.delta(e, "value", ["user_id"], ["ts", "event_id"], "step").select("event_id", r("mean"), r("step"))


@query("SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0")
def subtotal_visible(s, d):
    return ag.subtotal(t(s, d, "orders"), 109, "o_totalprice", "total", hidden=F.col("o_orderkey") % 7 == 0, filtered=F.col("o_orderstatus") == "P").select(r("total", 2))


@query("SELECT round(sum(l_quantity), 2) AS q FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity > 30) OR (l_returnflag = 'N' AND l_discount < 0.05)")
def dsum_criteria(s, d):
    return ag.database(t(s, d, "lineitem"), "DSUM", "l_quantity", [{"l_returnflag": "A", "l_quantity": ">30"}, {"l_returnflag": "N", "l_discount": "<0.05"}], "q").select(r("q", 2))


@query("SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, datediff('day', DATE '1899-12-30', last_day(o_orderdate::DATE))::DOUBLE AS eom, isodow(o_orderdate)::DOUBLE AS wd, week(o_orderdate)::DOUBLE AS wk, datediff('day', DATE '1899-12-30', (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE)::DOUBLE AS later FROM orders")
def date_parts(s, d):
    out = add_columns(t(s, d, "orders"), {"y": "=YEAR([o_orderdate])", "m": "=MONTH([o_orderdate])", "eom": "=EOMONTH([o_orderdate],0)", "wd": "=WEEKDAY([o_orderdate],2)", "wk": "=ISOWEEKNUM([o_orderdate])", "later": "=EDATE([o_orderdate],2)"})
    return out.select("o_orderkey", "y", "m", "eom", "wd", "wk", "later")


@query("SELECT o_orderkey, (SELECT count(*) FROM range(0, 31) g(i) WHERE isodow(o_orderdate::DATE + i::INT) < 6)::DOUBLE AS days FROM orders")
def networkdays(s, d):
    return add_columns(t(s, d, "orders"), {"days": "=NETWORKDAYS([o_orderdate],INT([o_orderdate])+30)"}).select("o_orderkey", "days")


@query("SELECT c_custkey, left(c_name, 4) AS a, right(c_name, 3) AS b, replace(c_name, '#', '-') AS c, length(c_name)::DOUBLE AS n, upper(c_mktsegment) || '/' || c_nationkey AS e, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'small' ELSE 'large' END AS size, substr(c_name, instr(c_name, '#') + 1) AS tail FROM customer")
def text_ops(s, d):
    return add_columns(
        t(s, d, "customer"),
        {"a": "=LEFT([c_name],4)", "b": "=RIGHT([c_name],3)", "c": '=SUBSTITUTE([c_name],"#","-")', "n": "=LEN([c_name])", "e": '=UPPER([c_mktsegment])&"/"&[c_nationkey]', "size": '=IFS([c_acctbal]<0,"debt",[c_acctbal]<1000,"small",TRUE,"large")', "tail": '=IFERROR(TEXTAFTER([c_name],"#"),[c_name])'},
    ).select("c_custkey", "a", "b", "c", "n", "e", "size", "tail")


@query("SELECT page_id, unnest(string_split(url, '/')) AS part, unnest(range(1, len(string_split(url, '/')) + 1))::INT AS place FROM pages")
def textsplit(s, d):
    return ar.textsplit(t(s, d, "pages"), "url", "/", ["page_id"]).select("page_id", "part", "place")


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set_ops(s, d):
    return ar.unique(ar.vstack(t(s, d, "nation").select(F.col("n_name").alias("name")), t(s, d, "region").select("r_name")), "name")


@query("SELECT o_orderkey, round(-o_totalprice * 0.005 / (1 - power(1.005, -60)), 4) AS pmt, round(o_totalprice * -0.005, 6) AS first_interest, round(l * power(1.05, 3), 4) AS later FROM (SELECT *, o_totalprice AS l FROM orders)")
def loan_table(s, d):
    out = add_columns(t(s, d, "orders"), {"pmt": "=PMT(0.06/12,60,[o_totalprice])", "first_interest": "=IPMT(0.06/12,1,60,[o_totalprice])", "later": "=FV(0.05,3,0,-[o_totalprice])"})
    return out.select("o_orderkey", r("pmt"), r("first_interest", 6), r("later"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 4) END AS ratio FROM lineitem")
def row_formulas(s, d):
    out = add_columns(t(s, d, "lineitem"), {"charge": "=[@l_extendedprice]*(1-[@l_discount])*(1+[@l_tax])", "ratio": "=[@l_tax]/[@l_discount]"})
    return out.select("l_orderkey", "l_linenumber", r("charge", 6), r("ratio"))


@query("SELECT l_orderkey, o_orderdate FROM lineitem LEFT JOIN (SELECT o_orderkey, min_by(o_orderdate, o_orderkey) AS o_orderdate FROM orders GROUP BY 1) ON l_orderkey = o_orderkey")
def vlookup_large(s, d):
    return lk.xlookup(t(s, d, "lineitem"), "l_orderkey", t(s, d, "orders"), "o_orderkey", "o_orderdate", "o_orderdate", "o_orderkey").select("l_orderkey", "o_orderdate")


@query("SELECT c_custkey, first.p AS first_price, last.p AS last_price FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) first ON first.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) last ON last.o_custkey = c_custkey")
def xlookup_by_place(s, d):
    first = lk.xlookup(t(s, d, "customer"), "c_custkey", t(s, d, "orders"), "o_custkey", "o_totalprice", "first_price", "o_orderkey")
    return lk.xlookup(first, "c_custkey", t(s, d, "orders"), "o_custkey", "o_totalprice", "last_price", "o_orderkey", last=True).select("c_custkey", "first_price", "last_price")


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def distinct_count(s, d):
    return ag.distinct_count(t(s, d, "lineitem"), "l_partkey", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s, d):
    return ev.tumbling(t(s, d, "events"), "ts", "1 hour", ["event_type"], "value").select("start", "event_type", "n", r("total"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS row_id FROM customer")
def numbered(s, d):
    return ar.numbered(t(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "row_id")


@query("SELECT round(avg(v), 4) AS mean FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)")
def trimmed_mean(s, d):
    return ag.trimmed_mean(t(s, d, "orders"), "o_totalprice", 0.2, "mean").select(r("mean"))


@query("SELECT floor((less + (250000 - lo) / (hi - lo)) / (n - 1) * 1000000 + 1e-9) / 1000000 AS p FROM (SELECT count(*) FILTER (WHERE o_totalprice < 250000) - 1 AS less, max(o_totalprice) FILTER (WHERE o_totalprice < 250000) AS lo, min(o_totalprice) FILTER (WHERE o_totalprice > 250000) AS hi, count(*) AS n FROM orders)")
def percentrank_between(s, d):
    return wi.percent_rank_of(t(s, d, "orders"), "o_totalprice", 250_000.0, "p", digits=6)


@query("SELECT p_partkey, (SELECT arg_max(o_orderkey, o_totalprice) FROM orders WHERE o_totalprice <= p_retailprice * 100) AS below, (SELECT arg_min(o_orderkey, o_totalprice) FROM orders WHERE o_totalprice >= p_retailprice * 100) AS above FROM part")
def lookup_many_bounds(s, d):
    keys = t(s, d, "part").withColumn("k", F.col("p_retailprice") * 100)
    # arg_max and arg_min pass over null results
    orders = t(s, d, "orders").where("o_orderkey is not null")
    below = lk.lookup_asof(keys, "k", orders, "o_totalprice", "o_orderkey", "below")
    return lk.lookup_next(below, "k", orders, "o_totalprice", "o_orderkey", "above").select("p_partkey", "below", "above")
