"""Time value of money, depreciation, rates and simple securities. Outflows are negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import when_bad
from .dates import year_fraction
from .registry import fn, python

NUM = "#NUM!"


def _growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def _pmt(rate, n, pv, fv, due):
    g = _growth(rate, n)
    return F.when(rate == 0, -(pv + fv) / n).otherwise(-(pv * g + fv) * rate / ((1 + rate * due) * (g - 1)))


def _fv(rate, n, pmt, pv, due):
    g = _growth(rate, n)
    return F.when(rate == 0, -(pv + pmt * n)).otherwise(-(pv * g + pmt * (1 + rate * due) * (g - 1) / rate))


def _due(t):
    return F.when(t != 0, 1).otherwise(0)


fn("PMT", "nnnnn", defaults=(0.0, 0.0))(lambda r, n, pv, fv, t: _pmt(r, n, pv, fv, _due(t)))
fn("FV", "nnnnn", defaults=(0.0, 0.0))(lambda r, n, pmt, pv, t: _fv(r, n, pmt, pv, _due(t)))


@fn("PV", "nnnnn", defaults=(0.0, 0.0))
def _(r, n, pmt, fv, t):
    g = _growth(r, n)
    return F.when(r == 0, -(fv + pmt * n)).otherwise(-(fv + pmt * (1 + r * _due(t)) * (g - 1) / r) / g)


@fn("NPER", "nnnnn", defaults=(0.0, 0.0))
def _(r, pmt, pv, fv, t):
    a = pmt * (1 + r * _due(t)) / r
    return F.when(r == 0, -(pv + fv) / pmt).otherwise(F.log((a - fv) / (a + pv)) / F.log(1 + r))


def _ipmt(r, per, n, pv, fv, due):
    pay = _pmt(r, n, pv, fv, due)
    interest = _fv(r, per - 1, pay, pv, due) * r
    return F.when((due == 1) & (per == 1), 0.0).when(due == 1, interest / (1 + r)).otherwise(interest)


@fn("IPMT", "nnnnnn", defaults=(0.0, 0.0))
def _(r, per, n, pv, fv, t):
    return _ipmt(r, per, n, pv, fv, _due(t)), when_bad((per < 1) | (per > n), NUM)


@fn("PPMT", "nnnnnn", defaults=(0.0, 0.0))
def _(r, per, n, pv, fv, t):
    return _pmt(r, n, pv, fv, _due(t)) - _ipmt(r, per, n, pv, fv, _due(t)), when_bad((per < 1) | (per > n), NUM)


def _cumulative(part):
    def body(r, n, pv, first, last, t):
        due = _due(t)
        steps = F.sequence(F.greatest(F.ceil(first), F.lit(1)), F.greatest(F.floor(last), F.ceil(first), F.lit(1)))
        total = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + part(r, k.cast("double"), n, pv, due))
        return total, when_bad((r <= 0) | (n <= 0) | (pv <= 0) | (first < 1) | (last < first) | (last > n), NUM)

    return body


fn("CUMIPMT", "nnnnnn")(_cumulative(lambda r, k, n, pv, due: _ipmt(r, k, n, pv, F.lit(0.0), due)))
fn("CUMPRINC", "nnnnnn")(_cumulative(lambda r, k, n, pv, due: _pmt(r, n, pv, F.lit(0.0), due) - _ipmt(r, k, n, pv, F.lit(0.0), due)))
fn("ISPMT", "nnnn")(lambda r, per, n, pv: pv * r * (per / n - 1))
fn("EFFECT", "nn")(lambda r, n: (F.pow(1 + r / F.floor(n), F.floor(n)) - 1, when_bad((r <= 0) | (n < 1), NUM)))
fn("NOMINAL", "nn")(lambda r, n: ((F.pow(1 + r, 1 / F.floor(n)) - 1) * F.floor(n), when_bad((r <= 0) | (n < 1), NUM)))
fn("RRI", "nnn")(lambda n, pv, fv: (F.pow(fv / pv, 1 / n) - 1, when_bad((n <= 0) | (pv == 0), NUM)))
fn("PDURATION", "nnn")(lambda r, pv, fv: ((F.log(fv) - F.log(pv)) / F.log(1 + r), when_bad((r <= 0) | (pv <= 0) | (fv <= 0), NUM)))
fn("SLN", "nnn")(lambda cost, salvage, life: (F.when(life != 0, (cost - salvage) / life).otherwise(0.0), when_bad(life == 0, "#DIV/0!")))
fn("SYD", "nnnn")(lambda cost, salvage, life, per: ((cost - salvage) * (life - per + 1) * 2 / (life * (life + 1)), when_bad((per <= 0) | (per > life), NUM)))


@fn("NPV", "nn*")
def _(r, *flows):
    return sum((x / F.pow(1 + r, i + 1) for i, x in enumerate(flows)), F.lit(0.0))


def _fraction(to_decimal: bool):
    def body(x, f):
        f = F.floor(f)
        whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
        scale = F.pow(F.lit(10.0), F.ceil(F.log10(f)))
        part = x - whole
        return whole + (part * scale / f if to_decimal else part * f / scale), when_bad(f < 0, NUM)

    return body


fn("DOLLARDE", "nn")(_fraction(True))
fn("DOLLARFR", "nn")(_fraction(False))


@python("DB", "nnnnn", defaults=(12.0,))
def _(cost, salvage, life, per, month):
    if cost < 0 or salvage < 0 or life <= 0 or per < 1 or per > life + (month < 12):
        raise ValueError
    rate, done, out = round(1 - (salvage / cost) ** (1 / life), 3), 0.0, 0.0
    for k in range(1, int(per) + 1):
        out = cost * rate * month / 12 if k == 1 else (cost - done) * rate * ((12 - month) / 12 if k > life else 1)
        done += out
    return out


@python("DDB", "nnnnn", defaults=(2.0,))
def _(cost, salvage, life, per, factor):
    if cost < 0 or salvage < 0 or life <= 0 or per < 1 or per > life or factor <= 0:
        raise ValueError
    left, out = cost, 0.0
    for _ in range(int(per)):
        out = max(0.0, min(left * factor / life, left - salvage))
        left -= out
    return out


def newton(f, x: float, lo: float = -0.999999) -> float:
    """A root of f near x, by secant steps."""
    for _ in range(200):
        y = f(x)
        h = 1e-6 * max(1.0, abs(x))
        slope = (f(x + h) - f(x - h)) / (2 * h)
        if slope == 0:
            raise ValueError
        step = y / slope
        x = max(lo, x - step)
        if abs(step) < 1e-12:
            return x
    if abs(f(x)) < 1e-6:
        return x
    raise ValueError


@python("RATE", "nnnnnn", defaults=(0.0, 0.0, 0.1))
def _(n, pmt, pv, fv, t, guess):
    due = 1 if t else 0

    def f(r):
        if abs(r) < 1e-12:
            return pv + pmt * n + fv
        g = (1 + r) ** n
        return pv * g + pmt * (1 + r * due) * (g - 1) / r + fv

    return newton(f, guess)


def irr(flows, guess: float = 0.1) -> float:
    if not (min(flows) < 0 < max(flows)):
        raise ValueError
    return newton(lambda r: sum(x / (1 + r) ** i for i, x in enumerate(flows)), guess)


def xirr(flows, days, guess: float = 0.1) -> float:
    if not (min(flows) < 0 < max(flows)):
        raise ValueError
    return newton(lambda r: sum(x / (1 + r) ** ((d - days[0]) / 365) for x, d in zip(flows, days)), guess)


def mirr(flows, finance: float, reinvest: float) -> float:
    n = len(flows) - 1
    out = sum(x / (1 + finance) ** i for i, x in enumerate(flows) if x < 0)
    back = sum(x * (1 + reinvest) ** (n - i) for i, x in enumerate(flows) if x > 0)
    return (back / -out) ** (1 / n) - 1


python("IRR", "n*")(lambda *flows: irr(flows))


@fn("TBILLPRICE", "nnn")
def _(a, b, discount):
    return 100 * (1 - discount * (b - a) / 360), when_bad((discount <= 0) | (a >= b) | (b - a > 366), NUM)


@fn("TBILLYIELD", "nnn")
def _(a, b, price):
    return (100 - price) / price * 360 / (b - a), when_bad((price <= 0) | (a >= b) | (b - a > 366), NUM)


@fn("TBILLEQ", "nnn")
def _(a, b, discount):
    return 365 * discount / (360 - discount * (b - a)), when_bad((discount <= 0) | (a >= b) | (b - a > 366), NUM)


@fn("ACCRINTM", "ddnnn", defaults=(1000.0, 0.0))
def _(issue, settlement, rate, par, basis):
    return par * rate * year_fraction(issue, settlement, F.floor(basis)), when_bad((rate <= 0) | (par <= 0) | (issue >= settlement), NUM)


@fn("ACCRINT", "dddnnnn", defaults=(0.0,))
def _(issue, first, settlement, rate, par, frequency, basis):
    return par * rate * year_fraction(issue, settlement, F.floor(basis)), when_bad((rate <= 0) | (par <= 0) | (issue >= settlement) | ~frequency.isin(1.0, 2.0, 4.0), NUM)


def _price(years: float, rate: float, y: float, redemption: float, f: float) -> float:
    import math

    periods = years * f
    n = math.ceil(periods - 1e-9)
    part = periods - (n - 1)
    coupon = 100 * rate / f
    if n == 1:
        return (redemption + coupon) / (1 + part * y / f) - coupon * (1 - part)
    return redemption / (1 + y / f) ** (n - 1 + part) + sum(coupon / (1 + y / f) ** (k + part) for k in range(n)) - coupon * (1 - part)


def _years360(a: float, b: float) -> float:
    import datetime as dt

    x, z = (dt.date(1899, 12, 30) + dt.timedelta(days=int(d)) for d in (a, b))
    return ((z.year - x.year) * 360 + (z.month - x.month) * 30 + min(z.day, 30) - min(x.day, 30)) / 360


@python("PRICE", "nnnnnnn", defaults=(0.0,))
def _(a, b, rate, y, redemption, f, basis):
    if a >= b or rate < 0 or y < 0 or redemption <= 0 or f not in (1, 2, 4):
        raise ValueError
    return _price(_years360(a, b), rate, y, redemption, f)


@python("YIELD", "nnnnnnn", defaults=(0.0,))
def _(a, b, rate, price, redemption, f, basis):
    if a >= b or rate < 0 or price <= 0 or redemption <= 0 or f not in (1, 2, 4):
        raise ValueError
    return newton(lambda y: _price(_years360(a, b), rate, y, redemption, f) - price, max(rate, 0.01))
