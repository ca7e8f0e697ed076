"""Dates and times: serial numbers of the 1900 system on the outside, Spark dates inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import Val, date_serial, merge, serial_date, to_num, when_bad
from .registry import fn, raw

NUM, VALUE = "#NUM!", "#VALUE!"

fn("YEAR", "d")(lambda d: F.year(d))
fn("MONTH", "d")(lambda d: F.month(d))
fn("DAY", "d")(lambda d: F.dayofmonth(d))
fn("ISOWEEKNUM", "d")(lambda d: F.weekofyear(d))
fn("HOUR", "n")(lambda n: F.floor((F.round((n - F.floor(n)) * 86400) % 86400) / 3600))
fn("MINUTE", "n")(lambda n: F.floor(F.round((n - F.floor(n)) * 86400) % 3600 / 60))
fn("SECOND", "n")(lambda n: F.round((n - F.floor(n)) * 86400) % 60)
fn("DAYS", "nn")(lambda end, start: F.floor(end) - F.floor(start))
fn("TIME", "nnn")(lambda h, m, s: F.pmod(F.floor(h) * 3600 + F.floor(m) * 60 + F.floor(s), F.lit(86400)) / 86400.0)
fn("EDATE", "dn")(lambda d, n: date_serial(F.add_months(d, F.floor(n).cast("int"))))
fn("EOMONTH", "dn")(lambda d, n: date_serial(F.last_day(F.add_months(d, F.floor(n).cast("int")))))
raw("TODAY", 0, 0)(lambda: Val(date_serial(F.current_date()), "n"))
raw("NOW", 0, 0)(lambda: Val(date_serial(F.localtimestamp()), "n"))


@fn("DATE", "nnn")
def _(y, m, d):
    y, m, d = (F.floor(c).cast("int") for c in (y, m, d))
    year = F.when(y < 1900, y + 1900).otherwise(y)
    first = F.add_months(F.make_date(F.least(F.greatest(year, F.lit(1)), F.lit(9999)), F.lit(1), F.lit(1)), m - 1)
    return date_serial(F.date_add(first, d - 1)), when_bad((y < 0) | (y > 9999), NUM)


#: Accepted date spellings.
DATE_SPELLINGS = ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy")
TIME_SPELLINGS = ("H:mm:ss", "H:mm", "h:mm a", "h:mm:ss a")


@fn("DATEVALUE", "t")
def _(s):
    got = F.coalesce(*[F.try_to_timestamp(F.trim(s), F.lit(p)) for p in DATE_SPELLINGS])
    return F.coalesce(date_serial(got.cast("date")), F.lit(0.0)), when_bad(got.isNull(), VALUE)


@fn("TIMEVALUE", "t")
def _(s):
    got = F.coalesce(*[F.try_to_timestamp(F.trim(s), F.lit(p)) for p in TIME_SPELLINGS])
    return F.coalesce((F.hour(got) * 3600 + F.minute(got) * 60 + F.second(got)) / 86400.0, F.lit(0.0)), when_bad(got.isNull(), VALUE)


#: The first day of the week (1 = Monday) of each numbering type.
WEEK_START = {1: 7, 2: 1, 11: 1, 12: 2, 13: 3, 14: 4, 15: 5, 16: 6, 17: 7}


def _monday(d: Column) -> Column:
    """1 for Monday to 7."""
    return F.weekday(d) + 1


def _start_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in WEEK_START.items() for x in (float(k), v)])[kind]


@fn("WEEKDAY", "dn", defaults=(1.0,))
def _(d, kind):
    one = F.pmod(_monday(d) - _start_of(kind), F.lit(7)) + 1
    return F.when(kind == 3, F.weekday(d)).otherwise(one).cast("double"), when_bad(_start_of(kind).isNull() & (kind != 3), NUM)


@fn("WEEKNUM", "dn", defaults=(1.0,))
def _(d, kind):
    first = F.trunc(d, "year")
    skip = F.pmod(_monday(first) - _start_of(kind), F.lit(7))
    return F.when(kind == 21, F.weekofyear(d)).otherwise(F.floor((F.dayofyear(d) - 1 + skip) / 7) + 1), when_bad(_start_of(kind).isNull() & (kind != 21), NUM)


def _days360(a: Column, b: Column, european: Column) -> Column:
    da, db = F.dayofmonth(a), F.dayofmonth(b)
    a_last = (da == 31) | ((F.month(a) == 2) & (a == F.last_day(a)))
    b_feb = (F.month(b) == 2) & (b == F.last_day(b)) & (F.month(a) == 2) & (a == F.last_day(a))
    us_a = F.when(a_last, 30).otherwise(da)
    us_b = F.when(b_feb | ((db == 31) & (us_a >= 30)), 30).otherwise(db)
    start = F.when(european, F.least(da, F.lit(30))).otherwise(us_a)
    end = F.when(european, F.least(db, F.lit(30))).otherwise(us_b)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + end - start


fn("DAYS360", "ddb", defaults=(False,))(lambda a, b, e: _days360(a, b, e))


def year_fraction(a: Column, b: Column, basis: Column) -> Column:
    """Positive for a <= b."""
    days = F.datediff(b, a)
    leap = lambda y: F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 366).otherwise(365)
    ya, yb = F.year(a), F.year(b)
    years = F.sequence(F.least(ya, yb), F.greatest(ya, yb))
    mean = F.aggregate(F.transform(years, lambda y: leap(y).cast("double")), F.lit(0.0), lambda p, q: p + q) / F.size(years)
    short = b <= F.add_months(a, 12)
    feb29 = lambda y: F.make_date(y, F.lit(3), F.lit(1))
    has = ((leap(ya) == 366) & (a < feb29(ya)) & (b >= F.date_sub(feb29(ya), 1))) | ((leap(yb) == 366) & (b >= F.date_sub(feb29(yb), 1)) & (a < feb29(yb)))
    actual = days / F.when(short, F.when(ya == yb, leap(ya)).when(has, 366).otherwise(365)).otherwise(mean)
    return F.when(basis == 1, actual).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, _days360(a, b, F.lit(True)) / 360).otherwise(_days360(a, b, F.lit(False)) / 360)


@fn("YEARFRAC", "ddn", defaults=(0.0,))
def _(a, b, basis):
    k = F.floor(basis)
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when(a > b, -1).otherwise(1) * year_fraction(lo, hi, k), when_bad((k < 0) | (k > 4), NUM)


@fn("DATEDIF", "ddt")
def _(a, b, unit):
    u = F.upper(unit)
    months = F.floor(F.months_between(F.date_trunc("month", b), F.date_trunc("month", a))) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    anniversary = F.add_months(a, months.cast("int"))
    by_year = F.add_months(a, (F.floor(months / 12) * 12).cast("int"))
    out = F.when(u == "Y", F.floor(months / 12)).when(u == "M", months).when(u == "D", F.datediff(b, a)).when(u == "YM", months % 12).when(u == "MD", F.datediff(b, anniversary)).when(u == "YD", F.datediff(b, by_year))
    return F.coalesce(out, F.lit(0)), when_bad((a > b) | out.isNull(), NUM)


def _weekend(x: Val | None) -> Column:
    """Seven characters from Monday, 1 for a day off."""
    plain = F.lit("0000011")
    if x is None or x.kind == "z":
        return plain
    if x.kind == "t":
        return x.v
    n = to_num(x).v
    pairs = {k: "".join("1" if (d - 5 - (k - 1)) % 7 in (0, 1) else "0" for d in range(7)) for k in range(1, 8)}
    single = {k: "".join("1" if d == (k - 12) % 7 else "0" for d in range(7)) for k in range(11, 18)}
    return F.create_map(*[F.lit(c) for k, m in (pairs | single).items() for c in (float(k), m)])[n]


def _holidays(args) -> Column:
    days = [F.floor(to_num(h).v) for h in args if h.kind != "z"]
    return F.array(*days) if days else F.array().cast("array<bigint>")


def _works(day: Column, off: Column, holidays: Column) -> Column:
    # serial 2 is a Monday
    return (F.substring(off, (F.pmod(day - 2, F.lit(7)) + 1).cast("int"), F.lit(1)) == "0") & ~F.array_contains(holidays, day)


def _network(a: Val, b: Val, off: Column, holidays: Column) -> Val:
    x, y = to_num(a), to_num(b)
    lo, hi = F.floor(F.least(x.v, y.v)), F.floor(F.greatest(x.v, y.v))
    weeks = F.floor((hi - lo + 1) / 7)
    per_week = F.length(F.replace(off, F.lit("1"), F.lit("")))
    # whole weeks in closed form, the days after them one by one
    rest = F.filter(F.sequence(lo + weeks * 7, lo + weeks * 7 + 6), lambda d: (d <= hi) & (F.substring(off, (F.pmod(d - 2, F.lit(7)) + 1).cast("int"), F.lit(1)) == "0"))
    free = F.filter(F.array_distinct(holidays), lambda h: (h >= lo) & (h <= hi) & (F.substring(off, (F.pmod(h - 2, F.lit(7)) + 1).cast("int"), F.lit(1)) == "0"))
    n = weeks * per_week + F.size(rest) - F.size(free)
    return Val(F.when(x.v > y.v, -n).otherwise(n).cast("double"), "n", merge(x.err, y.err, when_bad(off.isNull() | ~off.rlike("^[01]{7}$"), NUM)))


raw("NETWORKDAYS", 2)(lambda a, b, *h: _network(a, b, _weekend(None), _holidays(h)))
raw("NETWORKDAYS.INTL", 2)(lambda a, b, w=None, *h: _network(a, b, _weekend(w), _holidays(h)))


def _workday(a: Val, n: Val, off: Column, holidays: Column) -> Val:
    x, k = to_num(a), to_num(n)
    start, steps = F.floor(x.v), F.when(k.v < 0, F.ceil(k.v)).otherwise(F.floor(k.v))
    per_week = F.greatest(F.length(F.replace(off, F.lit("1"), F.lit(""))), F.lit(1))
    # far enough that the day is among them: whole weeks for the steps, and one day more per holiday
    span = (F.abs(steps) / per_week + 2).cast("long") * 7 + 7 * F.size(holidays)
    days = F.when(steps > 0, F.sequence(start + 1, start + span)).otherwise(F.sequence(start - 1, start - span, F.lit(-1).cast("long")))
    got = F.get(F.filter(days, lambda d: _works(d, off, holidays)), (F.greatest(F.abs(steps), F.lit(1)) - 1).cast("int"))
    bad = when_bad(off.isNull() | ~off.rlike("^[01]{7}$") | (off == "1111111"), VALUE)
    return Val(F.when(steps == 0, start).otherwise(got).cast("double"), "n", merge(x.err, k.err, bad))


raw("WORKDAY", 2)(lambda a, n, *h: _workday(a, n, _weekend(None), _holidays(h)))
raw("WORKDAY.INTL", 2)(lambda a, n, w=None, *h: _workday(a, n, _weekend(w), _holidays(h)))
assert serial_date
