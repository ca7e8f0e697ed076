"""Logic, information and choosing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..values import ERRORS, Val, error, merge, to_bool, to_num, to_text, when_bad
from .registry import fn, raw


def _same(vals: list[Val]) -> list[Val]:
    """One kind for all: blanks take the others' kind; a mixture becomes text."""
    kinds = {v.kind for v in vals if v.kind != "z"}
    if kinds <= {"n", "d"} or not kinds:
        return vals if kinds == {"d"} and all(v.kind == "d" for v in vals) else [to_num(v) for v in vals]
    if kinds == {"b"}:
        return [to_bool(v) for v in vals]
    return [to_text(v) for v in vals]


def _choose(conds: list[tuple], default: Val) -> Val:
    """conds: (Val condition, Val result); only the chosen branch's error counts."""
    vals = _same([r for _, r in conds] + [default])
    *results, last = vals
    v, e = last.v, last.err if last.err is not None else F.lit(None).cast("string")
    risky = any(r.err is not None for r in vals) or any(c.err is not None for c, _ in conds)
    for (c, _), r in reversed(list(zip(conds, results))):
        v = F.when(c.v, r.v).otherwise(v)
        own = r.err if r.err is not None else F.lit(None).cast("string")
        e = F.when(c.v, own).otherwise(e)
        if c.err is not None:
            e = F.coalesce(c.err, e)
    return Val(v, vals[0].kind, e if risky else None)


@raw("IF", 2, 3)
def _(cond, yes, no=None):
    return _choose([(to_bool(cond), yes)], no or Val(F.lit(False), "b"))


@raw("IFS", 2)
def _(*args):
    return _choose([(to_bool(c), r) for c, r in zip(args[::2], args[1::2])], error("#N/A"))


@raw("SWITCH", 3)
def _(x, *args):
    from ..compiler import compare

    default = args[-1] if len(args) % 2 else error("#N/A")
    return _choose([(to_bool(compare("=", x, k)), r) for k, r in zip(args[: len(args) // 2 * 2 : 2], args[1::2])], default)


@raw("CHOOSE", 2)
def _(i, *values):
    n = to_num(i)
    return _choose([(Val(F.floor(n.v) == k + 1, "b", n.err if not k else None), v) for k, v in enumerate(values)], error("#VALUE!"))


@raw("IFERROR", 2, 2)
def _(x, other):
    return x if x.err is None else _choose([(Val(x.err.isNotNull(), "b"), other)], Val(x.v, x.kind))


@raw("IFNA", 2, 2)
def _(x, other):
    if x.err is None:
        return x
    out = _choose([(Val(F.coalesce(x.err == "#N/A", F.lit(False)), "b"), other)], Val(x.v, x.kind, F.when(x.err != "#N/A", x.err)))
    return out


@raw("AND", 1)
def _(*args):
    got = [to_bool(a) for a in args]
    v = reduce(lambda a, b: a & b, [g.v for g in got])
    err = merge(*[g.err for g in got])
    return Val(v, "b", None if err is None else F.when(v, err))


@raw("OR", 1)
def _(*args):
    got = [to_bool(a) for a in args]
    v = reduce(lambda a, b: a | b, [g.v for g in got])
    err = merge(*[g.err for g in got])
    return Val(v, "b", None if err is None else F.when(~v, err))


@raw("XOR", 1)
def _(*args):
    got = [to_bool(a) for a in args]
    return Val(reduce(lambda a, b: a + b, [g.v.cast("int") for g in got]) % 2 == 1, "b", merge(*[g.err for g in got]))


fn("NOT", "b", "b")(lambda x: ~x)
fn("TRUE", "", "b")(lambda: F.lit(True))
fn("FALSE", "", "b")(lambda: F.lit(False))


def _no_err(x: Val):
    return F.lit(True) if x.err is None else x.err.isNull()


def _is(name: str, test):
    raw(name, 1, 1)(lambda x: Val(F.coalesce(test(x), F.lit(False)), "b"))


_is("ISNUMBER", lambda x: x.v.isNotNull() & _no_err(x) & F.lit(x.kind in "nd"))
_is("ISTEXT", lambda x: x.v.isNotNull() & _no_err(x) & F.lit(x.kind == "t"))
_is("ISNONTEXT", lambda x: ~(x.v.isNotNull() & _no_err(x) & F.lit(x.kind == "t")))
_is("ISLOGICAL", lambda x: x.v.isNotNull() & _no_err(x) & F.lit(x.kind == "b"))
_is("ISBLANK", lambda x: x.v.isNull() & _no_err(x))
_is("ISERROR", lambda x: ~_no_err(x))
_is("ISNA", lambda x: F.lit(False) if x.err is None else x.err == "#N/A")
_is("ISERR", lambda x: F.lit(False) if x.err is None else x.err.isNotNull() & (x.err != "#N/A"))
fn("ISEVEN", "n", "b")(lambda x: F.abs(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))) % 2 == 0)
fn("ISODD", "n", "b")(lambda x: F.abs(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))) % 2 == 1)
raw("NA", 0, 0)(lambda: error("#N/A"))


@raw("N", 1, 1)
def _(x):
    return Val(F.lit(0.0), "n", x.err) if x.kind == "t" else to_num(x)


@raw("T", 1, 1)
def _(x):
    return x if x.kind == "t" else Val(F.lit(""), "t", x.err)


@raw("TYPE", 1, 1)
def _(x):
    return Val(F.lit({"n": 1.0, "d": 1.0, "z": 1.0, "t": 2.0, "b": 4.0}[x.kind]), "n", x.err)


@raw("ERROR.TYPE", 1, 1)
def _(x):
    if x.err is None:
        return error("#N/A")
    code = F.create_map(*[c for k, n in ERRORS.items() for c in (F.lit(k), F.lit(float(n)))])[x.err]
    return Val(code, "n", when_bad(x.err.isNull(), "#N/A"))


raw("SHEET SHEETS", 0, 1)(lambda *_: Val(F.lit(1.0), "n"))
raw("ISREF", 1, 1)(lambda x: Val(F.lit(False), "b"))
raw("ISFORMULA", 1, 1)(lambda x: Val(F.lit(False), "b"))
