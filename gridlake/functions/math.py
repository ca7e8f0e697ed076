"""Arithmetic, rounding and trigonometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import Val, merge, to_num, when_bad
from .registry import fn, python, raw

NUM, DIV, VALUE = "#NUM!", "#DIV/0!", "#VALUE!"


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def half_away(x: Column) -> Column:
    return F.signum(x) * floor(F.abs(x) + 0.5)


for _name, _f in {
    "ABS": F.abs, "SIGN": F.signum, "EXP": F.exp, "SQRT": F.sqrt, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan,
    "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "ACOSH": F.acosh, "ATANH": F.atanh, "RADIANS": F.radians, "DEGREES": F.degrees, "INT": floor,
}.items():
    fn(_name, "n")(lambda x, f=_f: f(x))

fn("PI", "")(lambda: F.lit(math.pi))
fn("LN", "n")(lambda x: F.when(x > 0, F.log(x)))
fn("LOG10", "n")(lambda x: F.when(x > 0, F.log10(x)))


@fn("LOG", "nn", defaults=(10.0,))
def _(x, base):
    return F.when((x > 0) & (base > 0), F.log(x) / F.log(base)), when_bad(base == 1, DIV)


@fn("POWER", "nn")
def _(x, y):
    return F.pow(x, y)


for _name, _f in {"SEC": F.cos, "CSC": F.sin, "SECH": F.cosh, "CSCH": F.sinh}.items():

    @fn(_name, "n")
    def _(x, f=_f):
        return F.when(F.abs(f(x)) >= 1e-12, 1 / f(x)).otherwise(0.0), when_bad(F.abs(f(x)) < 1e-12, DIV)


for _name, _f in {"COT": F.tan, "COTH": F.tanh}.items():

    @fn(_name, "n")
    def _(x, f=_f):
        return F.when(F.abs(f(x)) >= 1e-12, 1 / f(x)).otherwise(0.0), when_bad(F.abs(f(x)) < 1e-12, DIV)


fn("ACOT", "n")(lambda x: math.pi / 2 - F.atan(x))
fn("ACOTH", "n")(lambda x: F.when(F.abs(x) > 1, F.log((x + 1) / (x - 1)) / 2))


@fn("ATAN2", "nn")
def _(x, y):
    return F.atan2(y, x), when_bad((x == 0) & (y == 0), DIV)


@fn("MOD", "nn")
def _(x, y):
    return F.when(y != 0, x - y * floor(x / y)).otherwise(0.0), when_bad(y == 0, DIV)


@fn("QUOTIENT", "nn")
def _(x, y):
    return F.when(y != 0, trunc(x / y)).otherwise(0.0), when_bad(y == 0, DIV)


def _digits(f):
    def body(x, d):
        scale = F.pow(F.lit(10.0), trunc(d))
        return f(x * scale) / scale

    return body


fn("ROUND", "nn")(_digits(half_away))
fn("ROUNDDOWN", "nn")(_digits(trunc))
fn("TRUNC", "nn", defaults=(0.0,))(_digits(trunc))
fn("ROUNDUP", "nn")(_digits(lambda x: F.signum(x) * ceil(F.abs(x))))


def _multiple(f, zero_ok: bool):
    def body(x, s):
        step = F.abs(s)
        v = F.when(step != 0, f(x / step) * step).otherwise(0.0)
        return v if zero_ok else (v, when_bad(step == 0, DIV))

    return body


fn("CEILING", "nn", defaults=(1.0,))(_multiple(ceil, False))
fn("FLOOR", "nn", defaults=(1.0,))(_multiple(floor, False))
fn("CEILING.PRECISE ISO.CEILING", "nn", defaults=(1.0,))(_multiple(ceil, True))
fn("FLOOR.PRECISE", "nn", defaults=(1.0,))(_multiple(floor, True))


@fn("CEILING.MATH", "nnn", defaults=(1.0, 0.0))
def _(x, s, mode):
    step = F.when(s == 0, 1.0).otherwise(F.abs(s))
    return F.when((x < 0) & (mode != 0), floor(x / step)).otherwise(ceil(x / step)) * step


@fn("FLOOR.MATH", "nnn", defaults=(1.0, 0.0))
def _(x, s, mode):
    step = F.when(s == 0, 1.0).otherwise(F.abs(s))
    return F.when((x < 0) & (mode != 0), ceil(x / step)).otherwise(floor(x / step)) * step


@fn("MROUND", "nn")
def _(x, m):
    return F.when((m == 0) | (x == 0), 0.0).otherwise(half_away(x / m) * m), when_bad(x * m < 0, NUM)


fn("EVEN", "n")(lambda x: F.signum(x) * ceil(F.abs(x) / 2) * 2)


@fn("ODD", "n")
def _(x):
    up = ceil((F.abs(x) + 1) / 2) * 2 - 1
    return F.when(x == 0, 1.0).otherwise(F.signum(x) * up)


fn("SQRTPI", "n")(lambda x: F.sqrt(x * math.pi))
fn("FACT", "n")(lambda x: F.when((x >= 0) & (x < 21), F.factorial(F.floor(x).cast("int")).cast("double")).when((x >= 21) & (x < 171), F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.greatest(F.floor(x).cast("int"), F.lit(1)), F.lit(170))), lambda k: k.cast("double")), F.lit(1.0), lambda a, b: a * b)))


def _choose(n: Column, k: Column) -> Column:
    m = F.least(k, n - k)
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.least(m, F.lit(2000.0)), F.lit(1.0)).cast("long"))
    value = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - m + i) / i)
    return F.when((k < 0) | (n < k), None).when(m == 0, 1.0).otherwise(F.round(value))


fn("COMBIN", "nn")(lambda n, k: _choose(floor(n), floor(k)))
fn("COMBINA", "nn")(lambda n, k: F.when((n == 0) & (k == 0), 1.0).otherwise(_choose(floor(n) + floor(k) - 1, floor(k))))


@fn("PERMUT", "nn")
def _(n, k):
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.least(floor(k), F.lit(400.0)) - 1, F.lit(0.0)).cast("long"))
    return F.when((k < 0) | (n < k), None).when(floor(k) == 0, 1.0).otherwise(F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (floor(n) - i)))


python("FACTDOUBLE", "n")(lambda x: float(math.prod(range(int(x), 0, -2))) if x >= -1 else math.sqrt(-1))
python("GCD", "n*")(lambda *x: float(math.gcd(*map(int, x))) if min(x) >= 0 else math.sqrt(-1))
python("LCM", "n*")(lambda *x: float(math.lcm(*map(int, x))) if min(x) >= 0 else math.sqrt(-1))
python("MULTINOMIAL", "n*")(lambda *x: float(math.factorial(int(sum(map(int, x)))) // math.prod(math.factorial(int(k)) for k in x)))


@fn("SUMSQ", "n*")
def _(*x):
    return sum((c * c for c in x[1:]), x[0] * x[0])


@fn("SERIESSUM", "nnnn*")
def _(x, n, m, *coefficients):
    return sum((c * F.pow(x, n + m * i) for i, c in enumerate(coefficients)), F.lit(0.0))


#: The numerals of ROMAN and ARABIC.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


@python("ROMAN", "nn", "t", defaults=(0.0,))
def _(x, form):
    n, out = int(x), ""
    if not 0 <= n <= 3999:
        raise ValueError
    for value, text in ROMAN:
        out += text * (n // value)
        n %= value
    return out


@python("ARABIC", "t")
def _(s):
    s = s.strip().upper()
    sign, s = (-1, s[1:]) if s.startswith("-") else (1, s)
    value = {t: v for v, t in ROMAN}
    digits = [value[c] for c in s] if set(s) <= set(value) else (_ for _ in ()).throw(ValueError)
    digits = list(digits)
    return float(sign * sum(-d if i + 1 < len(digits) and digits[i + 1] > d else d for i, d in enumerate(digits)))


@fn("BASE", "nnn", "t", defaults=(0.0,))
def _(x, base, width):
    out = None
    for b in range(2, 37):
        c = F.conv(F.floor(x).cast("string"), 10, b)
        out = F.when(base == b, c) if out is None else out.when(base == b, c)
    padded = F.when(F.length(out) < width, F.lpad(out, width.cast("int"), F.lit("0"))).otherwise(out)
    return padded, when_bad((base < 2) | (base > 36) | (x < 0), NUM)


@python("DECIMAL", "tn")
def _(s, base):
    return float(int(s.strip(), int(base)))


def _total(args, start, f):
    got = [to_num(a) for a in args]
    v = F.lit(start)
    for g in got:
        v = f(v, g.v)
    return Val(v, "n", merge(*[g.err for g in got]))


@raw("SUM", 0)
def _(*args):
    return _total(args, 0.0, lambda a, b: a + b)


@raw("PRODUCT", 1)
def _(*args):
    return _total(args, 1.0, lambda a, b: a * b)


@raw("AVERAGE", 1)
def _(*args):
    s = _total(args, 0.0, lambda a, b: a + b)
    return Val(s.v / len(args), "n", s.err)


@raw("MAX", 1)
def _(*args):
    got = [to_num(a) for a in args]
    return Val(F.greatest(*[g.v for g in got]) if len(got) > 1 else got[0].v, "n", merge(*[g.err for g in got]))


@raw("MIN", 1)
def _(*args):
    got = [to_num(a) for a in args]
    return Val(F.least(*[g.v for g in got]) if len(got) > 1 else got[0].v, "n", merge(*[g.err for g in got]))


@raw("COUNT", 0)
def _(*args):
    hits = [(a.v.isNotNull() & (a.err.isNull() if a.err is not None else F.lit(True))).cast("double") for a in args if a.kind in "nd"]
    return Val(sum(hits, F.lit(0.0)), "n")


@raw("COUNTA", 1)
def _(*args):
    hits = [(a.v.isNotNull() | (a.err.isNotNull() if a.err is not None else F.lit(False))).cast("double") for a in args if a.kind != "z"]
    return Val(sum(hits, F.lit(0.0)), "n")


@raw("RAND", 0, 0)
def _():
    return Val(F.rand(42), "n")


@fn("RANDBETWEEN", "nn")
def _(lo, hi):
    return floor(F.rand(43) * (floor(hi) - ceil(lo) + 1)) + ceil(lo), when_bad(lo > hi, NUM)
