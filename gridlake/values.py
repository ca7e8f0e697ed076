"""Cell values as Columns: a value lane and, where an error can occur, an error lane beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The error texts a cell can hold, with their numbers for ERROR.TYPE.
ERRORS = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#SPILL!": 9, "#CALC!": 14, "#CIRC!": 15}


@dataclass
class Val:
    """kind: n number, t text, b boolean, d date or timestamp, z blank. err None: no error can occur."""

    v: Column
    kind: str
    err: Column | None = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "b"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "d"
    return "t" if isinstance(t, (T.StringType, T.CharType, T.VarcharType)) else "n"


def error(kind: str) -> Val:
    return Val(F.lit(None).cast("double"), "n", F.lit(kind))


def merge(*errs: Column | None) -> Column | None:
    """The first error, in argument order."""
    got = [e for e in errs if e is not None]
    return None if not got else got[0] if len(got) == 1 else F.coalesce(*got)


def when_bad(bad: Column, kind: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(kind))


def date_serial(d: Column) -> Column:
    """Days of the 1900 system with the fraction of the day; 1900-03-01 is 61."""
    days = F.datediff(d.cast("date"), F.lit("1899-12-30").cast("date"))
    days = F.when(days < 61, days - 1).otherwise(days)
    ts = d.cast("timestamp_ntz")
    return (days + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400.0).cast("double")


def serial_date(n: Column) -> Column:
    whole = F.floor(n).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(whole < 60, whole + 1).otherwise(whole))


def number_text(n: Column) -> Column:
    """Plain decimal digits: no exponent, no trailing zeros."""
    plain = n.cast("string")
    wide = F.regexp_replace(F.regexp_replace(plain.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    whole = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, F.when(plain.contains("E"), wide), plain)


def parse_number(t: Column) -> Column:
    """Number in a text, with a percent sign or thousands commas; null if there is none."""
    s = F.trim(t)
    plain = F.regexp_replace(s, ",", "")
    is_number = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?$")
    value = F.regexp_replace(plain, "%", "").try_cast("double")
    return F.when(is_number, F.when(plain.endswith("%"), value / 100).otherwise(value))


def to_num(x: Val) -> Val:
    if x.kind == "n":
        return Val(F.coalesce(x.v.cast("double"), F.lit(0.0)) if x.err is None else x.v.cast("double"), "n", x.err)
    if x.kind == "b":
        return Val(F.coalesce(x.v.cast("double"), F.lit(0.0)), "n", x.err)
    if x.kind == "d":
        return Val(F.coalesce(date_serial(x.v), F.lit(0.0)), "n", x.err)
    if x.kind == "z":
        return Val(F.lit(0.0), "n", x.err)
    n = parse_number(x.v)
    return Val(F.when(x.v.isNull(), F.lit(0.0)).otherwise(n), "n", merge(x.err, when_bad(x.v.isNotNull() & n.isNull(), "#VALUE!")))


def to_text(x: Val) -> Val:
    if x.kind == "t":
        return Val(F.coalesce(x.v, F.lit("")), "t", x.err)
    if x.kind == "z":
        return Val(F.lit(""), "t", x.err)
    if x.kind == "b":
        return Val(F.when(x.v.isNull(), "").when(x.v, "TRUE").otherwise("FALSE"), "t", x.err)
    return Val(F.coalesce(number_text(to_num(x).v if x.kind == "d" else x.v.cast("double")), F.lit("")), "t", x.err)


def to_bool(x: Val) -> Val:
    if x.kind == "b":
        return Val(F.coalesce(x.v, F.lit(False)), "b", x.err)
    if x.kind == "t":
        up = F.upper(x.v)
        return Val(F.coalesce(up == "TRUE", F.lit(False)), "b", merge(x.err, when_bad(~up.isin("TRUE", "FALSE", ""), "#VALUE!")))
    n = to_num(x)
    return Val(n.v != 0, "b", n.err)


def to_date(x: Val) -> Val:
    if x.kind == "d":
        return x
    n = to_num(x)
    return Val(serial_date(n.v), "d", merge(n.err, when_bad((n.v < 0) | (n.v > 2958465), "#NUM!")))


def finite(v: Column) -> tuple[Column, Column]:
    """The value and #NUM! where it is missing, NaN or infinite; readers drop values under an error."""
    return v, F.when(F.coalesce(F.abs(v) < float("inf"), F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit("#NUM!"))


#: Expressions whose text is longer are computed once and referred to.
LONG = 160


def bound(vals: list[Val], body) -> Val:
    """body(*vals) with long argument expressions computed once, as a lambda's variable.

    Without this a function that uses its argument several times would multiply the expression at
    every level of nesting.
    """
    long = [i for i, x in enumerate(vals) if len(str(x.v)) > LONG]
    if not long:
        return body(*vals)
    kept: dict = {}

    def inner(s: Column) -> Column:
        new = [Val(s[f"v{i}"], x.kind, None if x.err is None else s[f"e{i}"]) if i in long else x for i, x in enumerate(vals)]
        out = kept["out"] = body(*new)
        return F.struct(out.v.alias("v"), (F.lit(None).cast("string") if out.err is None else out.err).alias("e"))

    parts = [c for i in long for c in ((vals[i].v.alias(f"v{i}"),) if vals[i].err is None else (vals[i].v.alias(f"v{i}"), vals[i].err.alias(f"e{i}")))]
    r = F.element_at(F.transform(F.array(F.struct(*parts)), inner), 1)
    return Val(r["v"], kept["out"].kind, None if kept["out"].err is None else r["e"])


def shown(x: Val) -> Column:
    """One column for a result: the value, or null where an error stands."""
    return x.v if x.err is None else F.when(x.err.isNull(), x.v)
