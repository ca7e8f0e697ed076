"""Formula trees to Columns, for a formula copied down the rows of a table.

``add_column(df, name, formula)`` is one projection however many rows there are: references to the
table's columns are Columns, functions are built-in expressions, and errors travel in a lane of
their own that is left out where no error can occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import REGISTRY
from .parser import Node, parse
from .values import Val, bound, error, finite, kind_of, merge, shown, to_num, to_text, when_bad

Scope = dict[str, object]


class Compiler:
    """names: lower-case name to Val, or to a (params, body) pair for a LAMBDA."""

    def __init__(self, names: Scope):
        self.names = names

    def run(self, n: Node) -> Val:
        return getattr(self, "do_" + n.op)(n)

    def do_num(self, n):
        return Val(F.lit(n.value), "n")

    def do_text(self, n):
        return Val(F.lit(n.value), "t")

    def do_bool(self, n):
        return Val(F.lit(n.value), "b")

    def do_error(self, n):
        return error(n.value)

    def do_blank(self, n):
        return Val(F.lit(None).cast("double"), "z")

    def do_name(self, n):
        got = self.names.get(str(n.value).lower())
        return got if isinstance(got, Val) else error("#NAME?")

    def do_column(self, n):
        got = self.names.get(n.value[1].lower())
        return got if isinstance(got, Val) else error("#REF!")

    def do_cell(self, n):
        return self.names.get(n.value[1].replace("$", "").lower()) or error("#REF!")

    def do_unary(self, n):
        x = self.run(n.args[0])
        if n.value == "+":
            return x
        x = to_num(x)
        return Val(-x.v, "n", x.err)

    def do_percent(self, n):
        x = to_num(self.run(n.args[0]))
        return Val(x.v / 100, "n", x.err)

    def do_binary(self, n):
        a, b = self.run(n.args[0]), self.run(n.args[1])
        return bound([a, b], lambda x, y: binary(n.value, x, y))

    def do_call(self, n):
        if n.value == "LET":
            inner = Compiler(dict(self.names))
            for k in range(0, len(n.args) - 1, 2):
                value = n.args[k + 1]
                inner.names[str(n.args[k].value).lower()] = (inner.closure(value)) if value.op == "call" and value.value == "LAMBDA" else inner.run(value)
            return inner.run(n.args[-1])
        got = self.names.get(str(n.value).lower())
        if isinstance(got, tuple):
            params, body, outer = got
            inner = Compiler(outer | {p: self.run(a) for p, a in zip(params, n.args)})
            return inner.run(body)
        if callable(got):
            return got(*[self.run(a) for a in n.args])
        f = REGISTRY.get(n.value)
        if f is None:
            return error("#NAME?")
        if not f.least <= len(n.args) <= f.most:
            return error("#VALUE!")
        return f.build([self.run(a) for a in n.args])

    def closure(self, n: Node):
        return [str(a.value).lower() for a in n.args[:-1]], n.args[-1], dict(self.names)


def binary(op: str, a: Val, b: Val) -> Val:
    if op == "&":
        x, y = to_text(a), to_text(b)
        return Val(F.concat(x.v, y.v), "t", merge(x.err, y.err))
    if op in ("=", "<>", "<", ">", "<=", ">="):
        return compare(op, a, b)
    x, y = to_num(a), to_num(b)
    err = merge(x.err, y.err)
    if op == "/":
        return Val(F.when(y.v != 0, x.v / y.v), "n", merge(err, when_bad(y.v == 0, "#DIV/0!")))
    if op == "^":
        v, bad = finite(F.pow(x.v, y.v))
        return Val(v, "n", merge(err, bad))
    return Val({"+": x.v + y.v, "-": x.v - y.v, "*": x.v * y.v}[op], "n", err)


def compare(op: str, a: Val, b: Val) -> Val:
    """Texts compare without case; a number and a text compare as numbers if the text is one, else as texts."""
    f: Callable[[Column, Column], Column] = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    err = merge(a.err, b.err)
    if "t" not in (a.kind, b.kind):
        return Val(f(to_num(a).v, to_num(b).v), "b", err)
    as_text = f(F.lower(to_text(a).v), F.lower(to_text(b).v))
    if a.kind == b.kind or "z" in (a.kind, b.kind):
        return Val(as_text, "b", err)
    x, y = to_num(a), to_num(b)
    bad = merge(x.err, y.err)
    return Val(as_text if bad is None else F.when(bad.isNull(), f(x.v, y.v)).otherwise(as_text), "b", err)


def scope(df: DataFrame) -> Scope:
    return {f.name.lower(): Val(F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in df.schema.fields}


def compile_formula(formula: str, names: Scope) -> Val:
    return Compiler(names).run(parse(formula))


def add_column(df: DataFrame, name: str, formula: str, names: Scope | None = None, errors: bool = False) -> DataFrame:
    """``df`` with the formula copied down. Cells with an error are null; ``errors`` adds <name>__error."""
    got = compile_formula(formula, scope(df) | (names or {}))
    out = df.withColumn(name, shown(got))
    return out.withColumn(f"{name}__error", F.lit(None).cast("string") if got.err is None else got.err) if errors else out


def add_columns(df: DataFrame, formulas: dict[str, str], names: Scope | None = None) -> DataFrame:
    """One projection for several independent formulas over ``df``."""
    base = scope(df) | (names or {})
    return df.withColumns({k: shown(compile_formula(f, base)) for k, f in formulas.items()})
