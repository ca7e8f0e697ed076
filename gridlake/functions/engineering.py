"""Bits, number bases, error functions, Bessel functions, complex numbers and units."""

from __future__ import annotations

import cmath
import math
import re

from pyspark.sql import functions as F

from ..values import when_bad
from .registry import fn, python

NUM = "#NUM!"
LIMIT = float(1 << 48)


def _bits(op):
    def body(a, b):
        ok = (a >= 0) & (b >= 0) & (a < LIMIT) & (b < LIMIT) & (a == F.floor(a)) & (b == F.floor(b))
        x, y = (F.when(ok, c).otherwise(0).cast("long") for c in (a, b))
        return op(x, y).cast("double"), when_bad(~ok, NUM)

    return body


fn("BITAND", "nn")(_bits(lambda a, b: a.bitwiseAND(b)))
fn("BITOR", "nn")(_bits(lambda a, b: a.bitwiseOR(b)))
fn("BITXOR", "nn")(_bits(lambda a, b: a.bitwiseXOR(b)))


def _shift(sign: int):
    def body(a, n):
        k = F.floor(n) * sign
        out = F.floor(a * F.pow(F.lit(2.0), k.cast("double")))
        return out, when_bad((a < 0) | (a >= LIMIT) | (a != F.floor(a)) | (F.abs(k) > 53) | (out >= LIMIT), NUM)

    return body


fn("BITLSHIFT", "nn")(_shift(1))
fn("BITRSHIFT", "nn")(_shift(-1))
fn("DELTA", "nn", defaults=(0.0,))(lambda a, b: F.when(F.abs(a - b) < 1e-12, 1).otherwise(0))
fn("GESTEP", "nn", defaults=(0.0,))(lambda a, b: F.when(a >= b, 1).otherwise(0))

#: base, bits of the two's complement, name
BASES = {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}


def _from(text: str, base: int, bits: int) -> int:
    text = text.strip()
    if len(text) > 10 or "_" in text or text[:1] in "+-":
        raise ValueError
    n = int(text or "0", base)
    return n - (1 << bits) if n >= 1 << (bits - 1) else n


def _into(n: int, base: int, bits: int, places: float) -> str:
    if not -(1 << (bits - 1)) <= n < 1 << (bits - 1):
        raise ValueError
    m, out = n % (1 << bits), ""
    while m:
        out = "0123456789ABCDEF"[m % base] + out
        m //= base
    out = out or "0"
    if n < 0 or places < 0:
        return out
    if places > 10 or len(out) > int(places):
        raise ValueError
    return out.zfill(int(places))


for _a, (_base, _bits_) in BASES.items():
    python(f"{_a}2DEC", "t")(lambda s, b=_base, w=_bits_: float(_from(s, b, w)))
    python(f"DEC2{_a}", "nn", "t", defaults=(-1.0,))(lambda n, p, b=_base, w=_bits_: _into(int(n), b, w, p))
    for _b, (_to, _wide) in BASES.items():
        if _a != _b:
            python(f"{_a}2{_b}", "tn", "t", defaults=(-1.0,))(lambda s, p, b=_base, w=_bits_, t=_to, x=_wide: _into(_from(s, b, w), t, x, p))

python("ERF", "nn", defaults=(float("nan"),))(lambda a, b: math.erf(a) if math.isnan(b) else math.erf(b) - math.erf(a))
python("ERF.PRECISE", "n")(math.erf)
python("ERFC ERFC.PRECISE", "n")(math.erfc)


def _simpson(f, a: float, b: float, n: int = 2000) -> float:
    h = (b - a) / n
    return h / 3 * (f(a) + f(b) + 4 * sum(f(a + h * k) for k in range(1, n, 2)) + 2 * sum(f(a + h * k) for k in range(2, n, 2)))


def _order(n: float) -> int:
    if n < 0:
        raise ValueError
    return int(n)


@python("BESSELJ", "nn")
def _(x, n):
    n = _order(n)
    return _simpson(lambda t: math.cos(n * t - x * math.sin(t)), 0, math.pi) / math.pi


@python("BESSELI", "nn")
def _(x, n):
    n = _order(n)
    return _simpson(lambda t: math.exp(x * math.cos(t)) * math.cos(n * t), 0, math.pi) / math.pi


@python("BESSELK", "nn")
def _(x, n):
    n = _order(n)
    if x <= 0:
        raise ValueError
    top = math.acosh(1 + 750 / x) if x < 700 else 2.0
    return _simpson(lambda t: math.exp(-x * math.cosh(t)) * math.cosh(n * t) if x * math.cosh(t) < 740 else 0.0, 0, top, 6000)


@python("BESSELY", "nn")
def _(x, n):
    n = _order(n)
    if x <= 0:
        raise ValueError
    top = math.asinh(750 / x) + 1
    tail = _simpson(lambda t: (math.exp(n * t) + (-1) ** n * math.exp(-n * t)) * math.exp(-x * math.sinh(t)) if x * math.sinh(t) < 700 else 0.0, 0, top, 20000)
    return (_simpson(lambda t: math.sin(x * math.sin(t) - n * t), 0, math.pi) - tail) / math.pi


COMPLEX = re.compile(r"^(?P<re>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\d.]*[ij]))?(?:(?P<im>[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)?)(?P<unit>[ij]))?$")


def parse_complex(s: str) -> tuple[complex, str]:
    m = COMPLEX.match(s.strip())
    if not m or not s.strip():
        raise ValueError(s)
    im = m["im"] or ""
    im = {"": 1.0, "+": 1.0, "-": -1.0}.get(im) if m["unit"] and im in ("", "+", "-") else float(im) if m["unit"] else 0.0
    return complex(float(m["re"] or 0), im), m["unit"] or "i"


def _digits(x: float) -> str:
    s = repr(round(x, 15) + 0.0)
    return s[:-2] if s.endswith(".0") else s


def show_complex(z: complex, unit: str = "i") -> str:
    re_, im = _digits(z.real), _digits(z.imag)
    if im == "0":
        return re_
    im = {"1": "", "-1": "-"}.get(im, im) + unit
    return im if re_ == "0" else re_ + ("" if im.startswith("-") else "+") + im


@python("COMPLEX", "nnt", "t", defaults=("i",))
def _(a, b, unit):
    if unit not in ("i", "j"):
        raise ValueError
    return show_complex(complex(a, b), unit)


python("IMREAL", "t")(lambda s: parse_complex(s)[0].real)
python("IMAGINARY", "t")(lambda s: parse_complex(s)[0].imag)
python("IMABS", "t")(lambda s: abs(parse_complex(s)[0]))
python("IMARGUMENT", "t")(lambda s: cmath.phase(parse_complex(s)[0]) if parse_complex(s)[0] else math.sqrt(-1))

for _name, _f in {
    "IMCONJUGATE": lambda z: z.conjugate(), "IMEXP": cmath.exp, "IMLN": cmath.log, "IMLOG10": cmath.log10, "IMLOG2": lambda z: cmath.log(z) / math.log(2),
    "IMSQRT": cmath.sqrt, "IMSIN": cmath.sin, "IMCOS": cmath.cos, "IMTAN": cmath.tan, "IMSINH": cmath.sinh, "IMCOSH": cmath.cosh,
    "IMSEC": lambda z: 1 / cmath.cos(z), "IMCSC": lambda z: 1 / cmath.sin(z), "IMCOT": lambda z: 1 / cmath.tan(z),
    "IMSECH": lambda z: 1 / cmath.cosh(z), "IMCSCH": lambda z: 1 / cmath.sinh(z),
}.items():

    @python(_name, "t", "t")
    def _(s, f=_f):
        z, unit = parse_complex(s)
        return show_complex(f(z), unit)


def _many(f):
    def body(*texts):
        got = [parse_complex(t) for t in texts]
        z = got[0][0]
        for x, _ in got[1:]:
            z = f(z, x)
        return show_complex(z, got[0][1])

    return body


python("IMSUM", "t*", "t")(_many(lambda a, b: a + b))
python("IMPRODUCT", "t*", "t")(_many(lambda a, b: a * b))
python("IMSUB", "tt", "t")(_many(lambda a, b: a - b))
python("IMDIV", "tt", "t")(_many(lambda a, b: a / b))
python("IMPOWER", "tn", "t")(lambda s, n: show_complex(parse_complex(s)[0] ** n, parse_complex(s)[1]))

#: Units of CONVERT by category, in the category's first unit.
UNITS = {
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lbm": 453.59237, "ozm": 28.349523125, "stone": 6350.29318, "ton": 907184.74},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144},
    "time": {"sec": 1.0, "s": 1.0, "mn": 60.0, "min": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "kPa": 1000.0, "atm": 101325.0, "mmHg": 133.322, "psi": 6894.757293168361},
    "energy": {"J": 1.0, "kJ": 1000.0, "cal": 4.1868, "kcal": 4186.8, "Wh": 3600.0, "kWh": 3600000.0, "BTU": 1055.05585262},
    "power": {"W": 1.0, "kW": 1000.0, "HP": 745.6998715822702},
    "volume": {"l": 1.0, "L": 1.0, "ml": 0.001, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473, "cup": 0.2365882365, "tsp": 0.00492892159375, "tbs": 0.01478676478125},
    "area": {"m2": 1.0, "km2": 1000000.0, "ha": 10000.0, "ft2": 0.09290304, "in2": 0.00064516},
    "speed": {"m/s": 1.0, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600},
    "information": {"bit": 1.0, "byte": 8.0, "kbyte": 8000.0},
}
TO_KELVIN = {"K": (1.0, 0.0), "C": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "Rank": (5 / 9, 0.0)}


@fn("CONVERT", "ntt")
def _(x, a, b):
    table = {u: (c, f) for c, units in UNITS.items() for u, f in units.items()}
    kind = F.create_map(*[F.lit(v) for u, (c, _) in table.items() for v in (u, c)])
    size = F.create_map(*[F.lit(v) for u, (_, f) in table.items() for v in (u, f)])
    scale = F.create_map(*[F.lit(v) for u, (s, _) in TO_KELVIN.items() for v in (u, s)])
    shift = F.create_map(*[F.lit(v) for u, (_, s) in TO_KELVIN.items() for v in (u, s)])
    heat = scale[a].isNotNull() & scale[b].isNotNull()
    plain = kind[a] == kind[b]
    out = F.when(heat, (x * scale[a] + shift[a] - shift[b]) / scale[b]).when(plain, x * size[a] / size[b]).otherwise(0.0)
    return out, when_bad(~F.coalesce(heat, F.lit(False)) & ~F.coalesce(plain, F.lit(False)), "#N/A")
