"""How a function is declared: parameter kinds, defaults, and a body over Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import Val, bound, finite, merge, to_bool, to_date, to_num, to_text

REGISTRY: dict[str, Function] = {}
COERCE = {"n": to_num, "t": to_text, "b": to_bool, "d": to_date}
INFINITE = 255


@dataclass
class Function:
    name: str
    least: int
    most: int
    build: Callable[[list[Val]], Val]


def fn(names: str, kinds: str, result: str = "n", defaults: tuple = (), once: bool = True):
    """kinds: a letter for each parameter (n t b d); a last * repeats. The body gets
    Columns and returns a Column, or (Column, error Column). Numbers that aren't finite are #NUM!."""
    many = kinds.endswith("*")
    letters = kinds.rstrip("*")
    least = len(letters) - len(defaults)

    def wrap(body):
        def build(args: list[Val]) -> Val:
            full = list(args) + [Val(F.lit(x), "t" if isinstance(x, str) else "b" if isinstance(x, bool) else "n") for x in defaults[len(args) - least :]] if len(args) < len(letters) else list(args)
            spec = letters + letters[-1:] * (len(full) - len(letters))

            def whole(*got: Val) -> Val:
                out = body(*[g.v for g in got])
                v, own = out if isinstance(out, tuple) else (out, None)
                err = merge(*[g.err for g in got])
                if result == "n":
                    v, bad = finite(v.cast("double"))
                    own = merge(own, bad)
                return Val(v, result, merge(err, own))

            got = [COERCE[k](x) for k, x in zip(spec, full)]
            return bound(got, whole) if once else whole(*got)

        for name in names.split():
            REGISTRY[name] = Function(name, least, INFINITE if many else len(letters), build)
        return body

    return wrap


def raw(names: str, least: int, most: int = INFINITE):
    """A function over the Vals themselves, which sees errors and kinds."""

    def wrap(body):
        for name in names.split():
            REGISTRY[name] = Function(name, least, most, lambda args: bound(args, body))
        return body

    return wrap


def python(names: str, kinds: str, result: str = "n", defaults: tuple = ()):
    """A numeric routine that Spark lacks, over Arrow batches. Domain errors are #NUM!."""

    def wrap(body):
        def one(*args):
            try:
                out = body(*args)
                return None if isinstance(out, complex) else out
            except (ValueError, ZeroDivisionError, OverflowError, ArithmeticError, IndexError):
                return None

        kind = "double" if result == "n" else "string"

        def run(cols: list[Column]) -> Column:
            def batch(frame: pd.DataFrame) -> pd.Series:
                return pd.Series([one(*row) for row in zip(*(frame[c] for c in frame.columns))], dtype=object if kind == "string" else float)

            return F.pandas_udf(batch, kind)(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))

        def columns(*cols: Column):
            v = run(list(cols))
            return v if result == "n" else (v, F.when(v.isNull(), F.lit("#NUM!")))

        fn(names, kinds, result, defaults, once=False)(columns)
        for name in names.split():
            PYTHON[name] = body
        return body

    return wrap


PYTHON: dict[str, Callable] = {}
