"""The criteria language of the *IF and D* functions, compiled to predicates that push down to scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import kind_of

ORDER = re.compile(r"^(>=|<=|<>|>|<|=)(.*)$", re.S)


def wildcard(pattern: str) -> str:
    """Regular expression of a text with * ? and ~ escapes, for the whole of a lower-case text."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "~" and at + 1 < len(pattern):
            at += 1
            out += re.escape(pattern[at])
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        at += 1
    return f"(?s)^{out}$"


def _number(s: str) -> float | None:
    try:
        return float(s[:-1]) / 100 if s.endswith("%") else float(s)
    except ValueError:
        return None


def criterion(c: Column, kind: str, want) -> Column:
    """Never null: rows for which the test can't be made don't match."""
    if want is None:
        return c.isNull()
    op, rhs = "", want
    if isinstance(want, str):
        m = ORDER.match(want)
        op, rhs = (m[1], m[2]) if m else ("", want)
    n = rhs if isinstance(rhs, (int, float)) and not isinstance(rhs, bool) else _number(rhs.strip()) if isinstance(rhs, str) else None
    if op in (">", "<", ">=", "<="):
        if n is not None and kind == "n":
            out = {">": c > n, "<": c < n, ">=": c >= n, "<=": c <= n}[op]
        elif n is None and kind == "t":
            out = F.lower(c) == rhs.lower()
        elif kind == "d":
            d = F.lit(rhs).cast("timestamp_ntz")
            out = {">": c > d, "<": c < d, ">=": c >= d, "<=": c <= d}[op]
        else:
            out = F.lit(False)
        return F.coalesce(out, F.lit(False))
    if isinstance(rhs, str) and rhs == "":
        same = c.isNull() | (c.cast("string") == "")
    elif isinstance(rhs, bool) or (isinstance(rhs, str) and rhs.upper() in ("TRUE", "FALSE") and kind == "b"):
        same = c == F.lit(rhs if isinstance(rhs, bool) else rhs.upper() == "TRUE")
    elif n is not None and kind == "n":
        same = F.abs(c - n) < 1e-12
    elif n is not None and kind == "t":
        same = (F.lower(c) == str(rhs).lower()) | (F.abs(c.try_cast("double") - n) < 1e-12)
    elif kind == "t":
        wild = op == "" and re.search(r"[*?~]", rhs)
        same = F.lower(c).rlike(wildcard(rhs.lower())) if wild else F.lower(c) == rhs.lower()
    elif kind == "d" and isinstance(rhs, str):
        same = c == F.lit(rhs).cast("timestamp_ntz")
    else:
        same = F.lit(False)
    same = F.coalesce(same, F.lit(False))
    return ~same if op == "<>" else same


def matches(df: DataFrame, column: str, want) -> Column:
    return criterion(F.col(column), kind_of(df.schema[column].dataType), want)


def all_of(df: DataFrame, pairs) -> Column:
    out = F.lit(True)
    for column, want in pairs:
        out = out & matches(df, column, want)
    return out


def any_row(df: DataFrame, rows: list[dict]) -> Column:
    """A criteria block: rows are alternatives, the cells of a row hold together; no rows match all."""
    if not rows:
        return F.lit(True)
    out = F.lit(False)
    for r in rows:
        out = out | all_of(df, [(k, v) for k, v in r.items() if v not in (None, "")])
    return out
