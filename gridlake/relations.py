"""Formulas over whole columns of tables: aggregates, lookups, criteria and dynamic arrays as plans.

A structured reference ``Sales[amount]`` is a relation, not cells in memory. What a formula makes of
it becomes a DataFrame beside the table that the formula is copied down: an aggregate is one row,
a lookup or a conditional aggregate with criteria from the row is one row for each key, and both are
joined. Formulas that are arrays (FILTER, SORT, GROUPBY, ...) are DataFrames themselves (``spill``).
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .compiler import Compiler, compare, scope
from .criteria import ORDER, any_row, criterion, wildcard
from .functions import REGISTRY
from .operators import aggregates as ag
from .operators import ordered
from .operators import windows as wi
from .parser import Node, parse
from .values import Val, error, kind_of, merge, parse_number, shown, to_bool, to_num, to_text, when_bad

SIDE = re.compile(r"__j(\d+)_")
#: Criteria blocks and index lists are read on the driver up to this many rows.
MOST_CRITERIA = 1000


@dataclass
class Rel:
    """Rows of ``df`` in ``order`` (Columns, and whether they ascend); ``cols`` are Vals over it. ``names``: the order's columns if they are plain and all ascend."""

    df: DataFrame
    cols: list[Val]
    order: list[tuple[Column, bool]]
    names: tuple = ()
    heads: tuple = ()


def sorting(r: Rel, back: bool = False) -> list[Column]:
    return [c.asc() if up != back else c.desc() for c, up in r.order]


@dataclass
class Arr:
    rows: list[list[Val]]


class Unsupported(Exception):
    pass


@dataclass
class Aggregate:
    """A custom aggregate: from a column of numbers to an aggregate Column, such as a grouped-aggregate pandas UDF."""

    build: Callable[[Column], Column]
    kind: str = "n"


def literal(n: Node):
    """(True, value) of a constant node."""
    if n.op in ("num", "text", "bool"):
        return True, n.value
    if n.op == "blank":
        return True, None
    if n.op == "unary" and n.value == "-" and n.args[0].op == "num":
        return True, -n.args[0].value
    return False, None


RELATIONAL: dict = {}


def rel(names: str):
    def wrap(f):
        for n in names.split():
            RELATIONAL[n] = f
        return f

    return wrap


class Sheet(Compiler):
    """tables: name to (DataFrame, columns that give its rows' places)."""

    def __init__(self, spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], df: DataFrame | None = None, order: list[str] = (), names=None, formulas=None):
        super().__init__((scope(df) if df is not None else {}) | (names or {}))
        self.spark, self.tables, self.df, self.order = spark, {k.lower(): v for k, v in tables.items()}, df, list(order)
        self.sides: dict[int, tuple[DataFrame, Column | None]] = {}
        self.formulas = {k.lower(): v for k, v in (formulas or {}).items()}
        self.locals: dict = {}

    # references

    def relation(self, table: str, columns: str | None) -> Rel:
        df, order = self.tables[table.lower()]
        have = {c.lower(): c for c in df.columns}
        if columns is None:
            names = df.columns
        elif "]:[" in columns:
            lo, hi = (df.columns.index(have[c.lower()]) for c in columns.split("]:["))
            names = df.columns[lo : hi + 1]
        else:
            names = [have[columns.lower()]]
        return Rel(df, [Val(F.col(f"`{c}`"), kind_of(df.schema[c].dataType)) for c in names], [(F.col(f"`{o}`"), True) for o in order], tuple(order), tuple(names))

    def do_column(self, n):
        table, column, row = n.value
        if table and not row and table.lower() in self.tables:
            if column.lower() in ("", "#data"):
                return self.relation(table, None)
            if column.lower() in ("#headers", "#all", "#totals"):
                heads = Arr([[Val(F.lit(c), "t") for c in self.tables[table.lower()][0].columns]])
                return heads if column.lower() == "#headers" else self.relation(table, None) if column.lower() == "#all" else error("#REF!")
            try:
                return self.relation(table, column)
            except KeyError:
                return error("#REF!")
        return super().do_column(n)

    def do_name(self, n):
        name = str(n.value).lower()
        if name in self.locals:
            return self.locals[name]
        return self.relation(name, None) if name in self.tables else super().do_name(n)

    def do_array(self, n):
        return Arr([[self.run(c) for c in r] for r in n.args])

    # sides

    def side(self, df: DataFrame, cond=None) -> int:
        no = next(COUNTER)
        self.sides[no] = (df.select(*[F.col(f"`{c}`").alias(f"__j{no}_{c}") for c in df.columns]), cond)
        return no

    def attach(self, df: DataFrame, *exprs) -> DataFrame:
        """``df`` with the sides that the expressions refer to."""
        need, todo = set(), [str(e) for e in exprs if e is not None]
        while todo:
            for no in map(int, SIDE.findall(todo.pop())):
                if no in self.sides and no not in need:
                    need.add(no)
                    cond = self.sides[no][1]
                    if cond is not None:
                        todo.append(str(cond(no)))
        for no in sorted(need):
            side, cond = self.sides[no]
            if f"{side.columns[0]}" in df.columns:
                continue
            df = df.crossJoin(F.broadcast(side)) if cond is None else df.join(side, cond(no), "left")
        return df

    def one(self, df: DataFrame, kind: str = "n", err: bool = False) -> Val:
        """The cell ``v`` (and its error ``e``) of a DataFrame of one row."""
        no = self.side(df)
        return Val(F.col(f"__j{no}_v"), kind, F.col(f"__j{no}_e") if err else None)

    def keyed(self, df: DataFrame, key: Column, kind: str, missing: str | None = "#N/A", hit: bool = False) -> Val:
        """The cell ``v`` of the row whose ``k`` equals the key."""
        no = self.side(df, lambda no, key=key: key == F.col(f"__j{no}_k"))
        v = F.col(f"__j{no}_v")
        return Val(v, kind, when_bad(F.col(f"__j{no}_k").isNull(), missing) if missing else None)

    # values

    def depends(self, n: Node) -> bool:
        """Does the node read the row that the formula stands in?"""
        if n.op == "column":
            return not (n.value[0] and not n.value[2] and n.value[0].lower() in self.tables)
        if n.op in ("cell", "name"):
            name = str(n.value[1] if n.op == "cell" else n.value).lower()
            return isinstance(self.names.get(name), Val)
        flat = [x for r in n.args for x in r] if n.op == "array" else n.args
        return any(self.depends(a) for a in flat if isinstance(a, Node))

    def rel_of(self, x) -> Rel:
        if isinstance(x, Rel):
            return x
        rows = x.rows if isinstance(x, Arr) else [[x]]
        width = max(map(len, rows))
        cols = []
        for j in range(width):
            vals = [r[j] if j < len(r) else Val(F.lit(None).cast("double"), "z") for r in rows]
            kinds = {v.kind for v in vals if v.kind != "z"}
            cols.append(kinds.pop() if len(kinds) == 1 else "n" if not kinds or kinds <= {"n", "b", "d"} else "t")
        cast = {"n": lambda v: to_num(v).v if v.kind != "z" else F.lit(None).cast("double"), "t": lambda v: to_text(v).v if v.kind != "z" else F.lit(None).cast("string"), "b": lambda v: v.v, "d": lambda v: v.v}
        cells = F.array(*[F.struct(F.lit(i).alias("row_id"), *[cast[k](r[j] if j < len(r) else Val(F.lit(None), "z")).alias(f"c{j}") for j, k in enumerate(cols)]) for i, r in enumerate(rows)])
        df = self.spark.range(1).select(F.explode(cells).alias("r")).select("r.*")
        return Rel(df, [Val(F.col(f"c{j}"), k) for j, k in enumerate(cols)], [(F.col("row_id"), True)], ("row_id",), tuple(f"c{j}" for j in range(width)))

    def scalar(self, x) -> Val:
        if isinstance(x, Arr):
            return x.rows[0][0]
        if isinstance(x, Rel):
            c = x.cols[0]
            top = self.attach(x.df, c.v, c.err).orderBy(*sorting(x)).limit(1).select(shown(c).alias("v")) if x.order else x.df.select(shown(c).alias("v")).limit(1)
            return self.one(top.agg(F.first("v").alias("v")), c.kind)
        return x

    def arg(self, n: Node):
        return self.run(n)

    def const(self, n: Node | None, default=None):
        """The value of an argument that shapes the plan: a constant, or a scalar that is computed for it."""
        if n is None:
            return default
        ok, v = literal(n)
        if ok:
            return default if v is None else v
        if self.depends(n):
            raise Unsupported
        x = self.scalar(self.run(n))
        return self.attach(self.spark.range(1), x.v).select(shown(x)).first()[0]

    def do_unary(self, n):
        return self.lift([n.args[0]], lambda x: x if n.value == "+" else (lambda y: Val(-y.v, "n", y.err))(to_num(x)))

    def do_percent(self, n):
        return self.lift([n.args[0]], lambda x: (lambda y: Val(y.v / 100, "n", y.err))(to_num(x)))

    def do_binary(self, n):
        from .compiler import binary, bound

        return self.lift(n.args, lambda a, b: bound([a, b], lambda x, y: binary(n.value, x, y)))

    def lift(self, nodes: list[Node], f):
        return spread(self, [self.run(a) for a in nodes], f)

    def do_call(self, n):
        if n.value == "LET":
            inner = Sheet.__new__(Sheet)
            inner.__dict__ = self.__dict__ | {"names": dict(self.names), "locals": dict(self.locals)}
            for k in range(0, len(n.args) - 1, 2):
                value, name = n.args[k + 1], str(n.args[k].value).lower()
                if value.op == "call" and value.value == "LAMBDA":
                    inner.names[name] = inner.closure(value)
                else:
                    got = inner.run(value)
                    (inner.names if isinstance(got, Val) else inner.locals)[name] = got
            return inner.run(n.args[-1])
        if n.value in RELATIONAL:
            try:
                return RELATIONAL[n.value](self, n.args)
            except Unsupported:
                return error("#VALUE!")
        own = self.names.get(str(n.value).lower())
        if isinstance(own, Aggregate):
            return self.one(numbers(self, n.args).agg(own.build(F.col("v")).alias("v")), own.kind)
        f = REGISTRY.get(n.value)
        if f is None or str(n.value).lower() in self.names:
            return super().do_call(n)
        args = [self.run(a) for a in n.args]
        if f.most == 255 and any(isinstance(a, (Arr, Rel)) for a in args):
            flat = []  # an array's cells are arguments
            for a in args:
                flat += [c for r in a.rows for c in r] if isinstance(a, Arr) else [self.scalar(a)] if isinstance(a, Rel) else [a]
            args = flat
        if not f.least <= len(args) <= f.most:
            return error("#VALUE!")
        return spread(self, args, lambda *x: f.build(list(x)))


COUNTER = itertools.count(1)


def spread(sheet: Sheet, args: list, f):
    """f over each cell of its array arguments; scalars are repeated."""
    rels = [a for a in args if isinstance(a, Rel)]
    if rels:
        if any(r.df is not rels[0].df for r in rels):
            rels_all = zipped(sheet, rels)
            it = iter(rels_all)
            args = [next(it) if isinstance(a, Rel) else a for a in args]
            rels = rels_all
        args = [a.rows[0][0] if isinstance(a, Arr) else a for a in args]
        width = max(len(r.cols) for r in rels)
        cols = [f(*[(a.cols[j if len(a.cols) > 1 else 0] if isinstance(a, Rel) else a) for a in args]) for j in range(width)]
        return Rel(rels[0].df, cols, rels[0].order, rels[0].names, rels[0].heads)
    arrs = [a for a in args if isinstance(a, Arr)]
    if not arrs:
        return f(*args)
    h, w = max(len(a.rows) for a in arrs), max(len(a.rows[0]) for a in arrs)

    def cell(a, i, j):
        if not isinstance(a, Arr):
            return a
        i, j = i if len(a.rows) > 1 else 0, j if len(a.rows[0]) > 1 else 0
        return a.rows[i][j] if i < len(a.rows) and j < len(a.rows[i]) else error("#N/A")

    return Arr([[f(*[cell(a, i, j) for a in args]) for j in range(w)] for i in range(h)])


def zipped(sheet: Sheet, rels: list[Rel]) -> list[Rel]:
    """Relations of different tables side by side, row by row."""
    out, base = [], None
    for k, r in enumerate(rels):
        if not r.names:
            raise Unsupported
        cells = [shown(c).alias(f"z{k}_{j}") for j, c in enumerate(r.cols)]
        places = [f"o{i}" for i in range(len(r.names))]
        part = sheet.attach(r.df, *[c.v for c in r.cols]).select(*[F.col(f"`{o}`").alias(p) for o, p in zip(r.names, places)], *cells)
        part = ordered.numbered(part, *places, alias="row_id").drop(*places)
        base = part if base is None else base.join(part, "row_id", "full")
    for k, r in enumerate(rels):
        out.append(Rel(base, [Val(F.col(f"z{k}_{j}"), c.kind) for j, c in enumerate(r.cols)], [(F.col("row_id"), True)], ("row_id",), tuple(f"z{k}_{j}" for j in range(len(r.cols)))))
    return out


# aggregates


def numbers(sheet: Sheet, args: list[Node], texts: bool = False) -> DataFrame:
    """One column ``v`` of the arguments' numbers, and ``e`` of their errors. In ranges texts and truth
    values don't count, or with ``texts`` count as 0 and 0 or 1."""
    parts = []
    for a in args:
        if sheet.depends(a):
            raise Unsupported
        x = sheet.arg(a)
        if isinstance(x, Arr):  # cell by cell, as their kinds may differ
            cells = [c for r in x.rows for c in r]
            number = lambda c: to_num(c).v if c.kind in ("n", "d") else (c.v.cast("double") if c.kind == "b" else F.lit(0.0)) if texts and c.kind != "z" else F.lit(None).cast("double")
            err = lambda c: F.lit(None).cast("string") if c.err is None else c.err
            empty = lambda c: F.lit(True) if c.kind == "z" else F.lit(False) if c.err is not None else c.v.isNull() | (c.v.cast("string") == "")
            rows = F.array(*[F.struct(F.when(err(c).isNull(), number(c)).alias("v"), err(c).alias("e"), F.lit(1).alias("cell"), empty(c).alias("blank")) for c in cells])
            parts.append(sheet.attach(sheet.spark.range(1), *[c.v for c in cells], *[c.err for c in cells]).select(F.inline(rows)))
            continue
        alone = isinstance(x, Val)
        r = sheet.rel_of(x)
        for c in r.cols:
            if c.kind in ("n", "d") or alone:
                blank = c.v.isNull() if not alone else F.lit(False)
                v = F.when(~blank, to_num(c).v)
            elif texts:
                v = c.v.cast("double") if c.kind == "b" else F.when(c.v.isNotNull(), F.lit(0.0))
            else:
                v = F.lit(None).cast("double")
            e = F.lit(None).cast("string") if c.err is None else c.err
            parts.append(sheet.attach(r.df, c.v, c.err).select(F.when(e.isNull(), v).alias("v"), e.alias("e"), F.lit(1).alias("cell"), (c.v.isNull() | (c.v.cast("string") == "")).alias("blank")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Aggregates of a column of numbers; EMPTY: the error of those that need a number at least.
REDUCE = {
    "SUM": "SUM", "AVERAGE": "AVERAGE", "COUNT": "COUNT", "MAX": "MAX", "MIN": "MIN", "PRODUCT": "PRODUCT", "SUMSQ": "SUMSQ", "STDEV.S": "STDEV.S", "STDEV": "STDEV.S", "STDEV.P": "STDEV.P", "STDEVP": "STDEV.P",
    "VAR.S": "VAR.S", "VAR": "VAR.S", "VAR.P": "VAR.P", "VARP": "VAR.P", "GEOMEAN": "GEOMEAN", "HARMEAN": "HARMEAN", "DEVSQ": "DEVSQ", "SKEW": "SKEW", "SKEW.P": "SKEW.P", "KURT": "KURT", "MODE.SNGL": "MODE", "MODE": "MODE",
    "AVERAGEA": "AVERAGE", "MAXA": "MAX", "MINA": "MIN", "STDEVA": "STDEV.S", "STDEVPA": "STDEV.P", "VARA": "VAR.S", "VARPA": "VAR.P",
}
EMPTY = {"AVERAGE": "#DIV/0!", "STDEV.S": "#DIV/0!", "STDEV.P": "#DIV/0!", "VAR.S": "#DIV/0!", "VAR.P": "#DIV/0!", "GEOMEAN": "#NUM!", "HARMEAN": "#NUM!", "SKEW": "#DIV/0!", "SKEW.P": "#DIV/0!", "KURT": "#DIV/0!", "MODE": "#N/A"}


def reduced(sheet: Sheet, df: DataFrame, name: str) -> Val:
    """One aggregate of the column ``v``; the first error of ``e`` travels, but not through COUNT."""
    v = ag.aggregate(name, F.col("v"))
    if name == "MODE":
        many = df.where("v is not null").groupBy("v").agg(F.count("*").alias("n")).where("n > 1").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        return sheet.one(many.select("v", when_bad(F.col("v").isNull(), "#N/A").alias("e")), "n", True)
    e = F.lit(None).cast("string") if name == "COUNT" else F.min("e")
    got = df.agg(v.cast("double").alias("v"), e.alias("e"))
    if name in EMPTY:
        got = got.select("v", F.coalesce("e", when_bad(F.col("v").isNull() | F.isnan("v"), EMPTY[name])).alias("e"))
    return sheet.one(got, "n", True)


def _reduce(name: str):
    plain = REGISTRY.get(name)

    @rel(name)
    def _(sheet: Sheet, args):
        if all(isinstance(x := sheet.arg(a), Val) for a in args) and plain:
            return plain.build([sheet.arg(a) for a in args])
        if plain and any(sheet.depends(a) for a in args):  # cells that follow from the row
            got = [sheet.arg(a) for a in args]
            return plain.build([c for x in got for c in ([c for r in x.rows for c in r if c.kind in ("n", "d")] if isinstance(x, Arr) else [sheet.scalar(x)])])
        return reduced(sheet, numbers(sheet, args, texts=name.endswith("A") and name not in ("COUNTA",)), REDUCE[name])


for _name in REDUCE:
    _reduce(_name)


@rel("COUNTA")
def _(sheet, args):
    return sheet.one(numbers(sheet, args).agg(F.count(F.when(~F.col("blank"), 1)).cast("double").alias("v")))


@rel("COUNTBLANK")
def _(sheet, args):
    return sheet.one(numbers(sheet, args).agg(F.count(F.when(F.col("blank"), 1)).cast("double").alias("v")))


@rel("AVEDEV")
def _(sheet, args):
    df = numbers(sheet, args)
    mean = df.agg(F.avg("v").alias("m"))
    got = df.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("v"), F.min("e").alias("e"))
    return sheet.one(got.select("v", F.coalesce("e", when_bad(F.col("v").isNull(), "#NUM!")).alias("e")), "n", True)


def chosen(sheet: Sheet, df: DataFrame, share: float, exclusive: bool = False) -> Val:
    v = ordered.percentiles(df, "v", {"v": float(share)}, exclusive).first().v
    return error("#NUM!") if v is None else Val(F.lit(v), "n")


@rel("MEDIAN")
def _(sheet, args):
    return chosen(sheet, numbers(sheet, args), 0.5)


@rel("PERCENTILE.INC PERCENTILE")
def _(sheet, args):
    return chosen(sheet, numbers(sheet, args[:1]), sheet.const(args[1]))


@rel("PERCENTILE.EXC")
def _(sheet, args):
    return chosen(sheet, numbers(sheet, args[:1]), sheet.const(args[1]), True)


@rel("QUARTILE.INC QUARTILE")
def _(sheet, args):
    return chosen(sheet, numbers(sheet, args[:1]), int(sheet.const(args[1])) / 4)


@rel("QUARTILE.EXC")
def _(sheet, args):
    return chosen(sheet, numbers(sheet, args[:1]), int(sheet.const(args[1])) / 4, True)


def at_rank(sheet, args, from_top: bool) -> Val:
    k = int(math.ceil(sheet.const(args[1])))
    _, at = ordered.at_ranks(numbers(sheet, args[:1]), "v", lambda n: [n - k if from_top else k - 1])
    return Val(F.lit(next(iter(at.values()))), "n") if at else error("#NUM!")


rel("LARGE")(lambda sheet, args: at_rank(sheet, args, True))
rel("SMALL")(lambda sheet, args: at_rank(sheet, args, False))


@rel("TRIMMEAN")
def _(sheet, args):
    return sheet.one(ag.trimmed_mean(numbers(sheet, args[:1]), "v", float(sheet.const(args[1])), "v"))


@rel("MODE.MULT")
def _(sheet, args):
    counts = numbers(sheet, args).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    most = counts.agg(F.max("n").alias("most"))
    got = counts.crossJoin(F.broadcast(most)).where("n = most").select("v")
    return Rel(got, [Val(F.col("v"), "n")], [(F.col("v"), True)], ("v",), ("v",))


@rel("FREQUENCY")
def _(sheet, args):
    bins = sheet.rel_of(sheet.arg(args[1]))
    held = bins.df.select(*[to_num(c).v for c in bins.cols]).limit(MOST_CRITERIA + 1).collect()
    if len(held) > MOST_CRITERIA:
        raise Unsupported
    edges = sorted(x for r in held for x in r if x is not None)
    got = wi.frequency(numbers(sheet, args[:1]), "v", edges, "n")
    return Rel(got, [Val(F.col("n").cast("double"), "n")], [(F.col("bin"), True)], ("bin",), ("n",))


def ranked(sheet, args, average: bool) -> Val:
    x, down = to_num(sheet.arg(args[0])), not (len(args) > 2 and sheet.const(args[2]))
    side = ordered.value_counts(numbers(sheet, args[1:2]), "v")
    r = (F.col("__n") - F.col("__less") - F.col("__c") if down else F.col("__less")) + 1 + ((F.col("__c") - 1) / 2 if average else 0)
    return sheet.keyed(side.select(F.col("__v").alias("k"), r.cast("double").alias("v")), x.v, "n")


rel("RANK.EQ RANK")(lambda sheet, args: ranked(sheet, args, False))
rel("RANK.AVG")(lambda sheet, args: ranked(sheet, args, True))


def percent_ranked(sheet, args, exclusive: bool) -> Val:
    digits = int(sheet.const(args[2], 3)) if len(args) > 2 else 3
    got = wi.percent_rank_of(numbers(sheet, args[:1]), "v", float(sheet.const(args[1])), "v", digits, exclusive)
    return sheet.one(got.select("v", when_bad(F.col("v").isNull(), "#N/A").alias("e")), "n", True)


rel("PERCENTRANK.INC PERCENTRANK")(lambda sheet, args: percent_ranked(sheet, args, False))
rel("PERCENTRANK.EXC")(lambda sheet, args: percent_ranked(sheet, args, True))


@rel("SUBTOTAL")
def _(sheet, args):
    code = int(sheet.const(args[0]))
    if code % 100 not in ag.SUBTOTAL_CODES or code > 111:
        return error("#VALUE!")
    name = ag.SUBTOTAL_CODES[code % 100]
    return RELATIONAL["COUNTA"](sheet, args[1:]) if name == "COUNTA" else reduced(sheet, visible(sheet, args[1:], code > 100), name)


@rel("AGGREGATE")
def _(sheet, args):
    """Codes 1 to 11 with options 0 to 3: options 1 and 3 leave out hidden rows, 2 and 3 errors."""
    code, option = int(sheet.const(args[0])), int(sheet.const(args[1], 0))
    if code not in ag.SUBTOTAL_CODES or option not in (0, 1, 2, 3):
        return error("#VALUE!")
    df = visible(sheet, args[2:], option in (1, 3))
    if option in (2, 3):
        df = df.withColumn("e", F.lit(None).cast("string"))
    return reduced(sheet, df, ag.SUBTOTAL_CODES[code])


def visible(sheet: Sheet, args: list[Node], leave_hidden: bool) -> DataFrame:
    """Without the rows that a table's columns ``hidden_manual`` and ``hidden_filter`` mark."""
    parts = []
    for a in args:
        r = sheet.rel_of(sheet.arg(a))
        marks = [c for c in ("hidden_manual", "hidden_filter") if c in r.df.columns]
        if leave_hidden and marks:
            r = Rel(r.df.where(" and ".join(f"not coalesce({c}, false)" for c in marks)), r.cols, r.order, r.names, r.heads)
        for c in r.cols:
            e = F.lit(None).cast("string") if c.err is None else c.err
            parts.append(sheet.attach(r.df, c.v, c.err).select(F.when(e.isNull(), to_num(c).v if c.err is not None else c.v.cast("double")).alias("v"), e.alias("e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# two or more columns


def vector(sheet: Sheet, n: Node) -> Rel:
    """An argument as one column: an array's cells row by row, a relation as it is."""
    x = sheet.arg(n)
    return sheet.rel_of(Arr([[c] for r in x.rows for c in r]) if isinstance(x, Arr) else x)


def together(sheet: Sheet, args: list[Node], flat: bool = True) -> tuple[DataFrame, list[str]]:
    """The arguments' columns, row beside row, as doubles x0, x1, ...; ``flat``: an array is one column."""
    rels = [vector(sheet, a) if flat else sheet.rel_of(sheet.arg(a)) for a in args]
    if any(r.df is not rels[0].df for r in rels):
        rels = zipped(sheet, rels)
    cells = [c for r in rels for c in r.cols]
    df = sheet.attach(rels[0].df, *[c.v for c in cells])
    return df.select(*[(c.v.cast("double") if c.kind == "n" and c.err is None else F.when(merge(c.err, F.lit(None).cast("string")).isNull(), to_num(c).v)).alias(f"x{i}") for i, c in enumerate(cells)]), [f"x{i}" for i in range(len(cells))]


@rel("SUMPRODUCT")
def _(sheet, args):
    rels = [sheet.arg(a) for a in args]
    if len(args) == 1 and isinstance(rels[0], Rel):
        r = rels[0]
        df = sheet.attach(r.df, *[c.v for c in r.cols])
        return sheet.one(df.agg(F.coalesce(sum((F.sum(F.coalesce(to_num(c).v, F.lit(0.0))) for c in r.cols), F.lit(0.0)), F.lit(0.0)).alias("v")))
    width = len(sheet.rel_of(rels[0]).cols)
    df, names = together(sheet, args, flat=False)
    total = F.lit(0.0)
    for j in range(width):
        product = F.lit(1.0)
        for c in names[j::width]:
            product = product * F.coalesce(F.col(c), F.lit(0.0))
        total = total + product
    return sheet.one(df.agg(F.coalesce(F.sum(total), F.lit(0.0)).alias("v")))


PAIRS = {
    "SUMXMY2": lambda x, y: F.sum(F.pow(x - y, 2)), "SUMX2MY2": lambda x, y: F.sum(x * x - y * y), "SUMX2PY2": lambda x, y: F.sum(x * x + y * y),
    "CORREL": F.corr, "PEARSON": F.corr, "COVARIANCE.S": F.covar_samp, "COVARIANCE.P": F.covar_pop, "COVAR": F.covar_pop, "RSQ": F.regr_r2, "SLOPE": F.regr_slope, "INTERCEPT": F.regr_intercept,
    "STEYX": lambda y, x: F.when(F.regr_count(y, x) > 2, F.sqrt((F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)) / (F.regr_count(y, x) - 2))),
}


def _pair(name: str, f):
    @rel(name)
    def _(sheet: Sheet, args):
        df, _ = together(sheet, args[:2])
        got = df.agg(f(F.col("x0"), F.col("x1")).cast("double").alias("v"))
        return sheet.one(got.select("v", when_bad(F.col("v").isNull() | F.isnan("v"), "#DIV/0!").alias("e")), "n", True)


for _name, _f in PAIRS.items():
    _pair(_name, _f)


def line(sheet: Sheet, args: list[Node], log: bool = False, through: bool = True) -> dict:
    """The least squares fit of the first column on the others, from sums of products."""
    ys = vector(sheet, args[0])
    if len(args) > 1 and args[1].op != "blank":
        x = sheet.arg(args[1])
        flat = not isinstance(x, Arr) or 1 in (len(x.rows), len(x.rows[0]))
        df, names = together(sheet, args[:2], flat)
    else:
        df = ordered.numbered(ys.df.select(*ys.names, to_num(ys.cols[0]).v.alias("x0")), *ys.names, alias="x1").select("x0", F.col("x1").cast("double"))
        names = ["x0", "x1"]
    y = F.log("x0") if log else F.col("x0")
    cols = [F.col(c) for c in names[1:]] + ([F.lit(1.0)] if through else [])
    k = len(cols)
    df = df.where(" and ".join(f"{c} is not null" for c in names))
    cells = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * y).alias(f"b{i}") for i, c in enumerate(cols)]
    got = df.agg(*cells, F.sum(y * y).alias("yy"), F.sum(y).alias("y"), F.count("*").alias("n")).first()
    if not got.n:
        raise Unsupported
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    b = np.array([got[f"b{i}"] for i in range(k)], float)
    inverse = np.linalg.pinv(a)
    w = inverse @ b
    rest = max(float(got.yy - w @ b), 0.0)
    total = float(got.yy - (got.y**2 / got.n if through else 0.0))
    free = got.n - k
    s2 = rest / free if free > 0 else float("nan")
    return {"w": w, "through": through, "se": np.sqrt(np.maximum(np.diag(inverse) * s2, 0)), "r2": 1 - rest / total if total else 1.0, "sey": math.sqrt(s2) if free > 0 else float("nan"), "f": (total - rest) / max(k - through, 1) / s2 if s2 else float("inf"), "free": free, "reg": total - rest, "res": rest}


def fit_block(sheet, args, log: bool) -> Arr:
    through = bool(sheet.const(args[2], True)) if len(args) > 2 else True
    m = line(sheet, args, log, through)
    w = list(m["w"]) if through else [*m["w"], 0.0]
    first = [*reversed(w[:-1]), w[-1]]
    cell = lambda x: Val(F.lit(float(x)), "n") if math.isfinite(x) else error("#N/A")
    rows = [[cell(math.exp(x) if log else x) for x in first]]
    if len(args) > 3 and sheet.const(args[3], False):
        se = list(m["se"]) if through else [*m["se"], float("nan")]
        pad = [error("#N/A")] * (len(first) - 2)
        rows += [[cell(x) for x in [*reversed(se[:-1]), se[-1]]]] + [[cell(p), cell(q), *pad] for p, q in ((m["r2"], m["sey"]), (m["f"], m["free"]), (m["reg"], m["res"]))]
    return Arr(rows)


rel("LINEST")(lambda sheet, args: fit_block(sheet, args, False))
rel("LOGEST")(lambda sheet, args: fit_block(sheet, args, True))


def fitted(sheet, args, log: bool):
    m = line(sheet, args[:2], log, bool(sheet.const(args[3], True)) if len(args) > 3 else True)
    new = sheet.arg(args[2]) if len(args) > 2 and args[2].op != "blank" else sheet.arg(args[1])

    def value(*xs: Val) -> Val:
        v = F.lit(float(m["w"][-1]) if m["through"] else 0.0)
        for x, w in zip(xs, m["w"]):
            v = v + to_num(x).v * float(w)
        return Val(F.exp(v) if log else v, "n", merge(*[x.err for x in xs]))

    if isinstance(new, Rel):
        return Rel(new.df, [value(*new.cols)], new.order, new.names, new.heads)
    return spread(sheet, [new], value)


rel("TREND")(lambda sheet, args: fitted(sheet, args, False))
rel("GROWTH")(lambda sheet, args: fitted(sheet, args, True))
rel("FORECAST.LINEAR FORECAST")(lambda sheet, args: fitted(sheet, [args[1], args[2], args[0]], False))


def moments(sheet, n: Node) -> tuple[Val, Val, Val]:
    df = numbers(sheet, [n]).agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    no = sheet.side(df)
    return tuple(Val(F.col(f"__j{no}_{c}"), "n") for c in "nms")


def call(name: str, *args) -> Val:
    return REGISTRY[name].build([a if isinstance(a, Val) else Val(a if isinstance(a, Column) else F.lit(a), "n") for a in args])


@rel("T.TEST TTEST")
def _(sheet, args):
    """Types 1 paired, 2 equal variances, 3 unequal ones."""
    tails, kind = int(sheet.const(args[2])), int(sheet.const(args[3]))
    if tails not in (1, 2) or kind not in (1, 2, 3):
        return error("#NUM!")
    if kind == 1:
        df, _ = together(sheet, args[:2])
        d = F.col("x0") - F.col("x1")
        no = sheet.side(df.agg(F.count(d).cast("double").alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("s")))
        n, m, s = (F.col(f"__j{no}_{c}") for c in "nms")
        t, free = F.abs(m) / F.sqrt(s / n), n - 1
    else:
        (n1, m1, s1), (n2, m2, s2) = ([x.v for x in moments(sheet, a)] for a in args[:2])
        if kind == 2:
            pooled = ((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)
            t, free = F.abs(m1 - m2) / F.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2
        else:
            a, b = s1 / n1, s2 / n2
            t, free = F.abs(m1 - m2) / F.sqrt(a + b), F.pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return call("T.DIST.2T" if tails == 2 else "T.DIST.RT", t, free)


@rel("F.TEST FTEST")
def _(sheet, args):
    (n1, _, s1), (n2, _, s2) = ([x.v for x in moments(sheet, a)] for a in args[:2])
    p = call("F.DIST.RT", s1 / s2, n1 - 1, n2 - 1)
    return Val(2 * F.least(p.v, 1 - p.v), "n", p.err)


@rel("Z.TEST ZTEST")
def _(sheet, args):
    n, m, s = (x.v for x in moments(sheet, args[0]))
    x = to_num(sheet.scalar(sheet.arg(args[1])))
    sigma = to_num(sheet.scalar(sheet.arg(args[2]))).v if len(args) > 2 else F.sqrt(s)
    p = call("NORM.S.DIST", (m - x.v) / (sigma / F.sqrt(n)), Val(F.lit(True), "b"))
    return Val(1 - p.v, "n", p.err)


@rel("CHISQ.TEST CHITEST")
def _(sheet, args):
    a, b = (sheet.rel_of(sheet.arg(x)) for x in args)
    width = len(a.cols)
    if width != len(b.cols):
        return error("#N/A")
    df, names = together(sheet, args, flat=False)
    got = df.agg(sum(F.sum(F.pow(F.col(names[j]) - F.col(names[j + width]), 2) / F.col(names[j + width])) for j in range(width)).alias("x"), F.count("*").cast("double").alias("r"))
    no = sheet.side(got)
    r = F.col(f"__j{no}_r")
    free = F.when(r > 1, (r - 1) * (width - 1) if width > 1 else r - 1).otherwise(F.lit(float(width - 1)))
    return call("CHISQ.DIST.RT", F.col(f"__j{no}_x"), free)


# cash flows


def flows(sheet: Sheet, args: list[Node]) -> DataFrame:
    """(i, v): the flows of all arguments with their places from 0."""
    r = [sheet.rel_of(sheet.arg(a)) for a in args]
    if len(r) > 1:
        r = [sheet.rel_of(Arr([[sheet.scalar(sheet.arg(a))] for a in args]))]
    r = r[0]
    if len(r.cols) > 1:  # a row of cells
        r = sheet.rel_of(Arr([[c] for row in sheet.arg(args[0]).rows for c in row]))
    df = r.df.select(*r.names, to_num(r.cols[0]).v.alias("v"))
    return ordered.numbered(df, *r.names, alias="i").select((F.col("i") - 1).alias("i"), "v")


def plain_or(name: str, f):
    """The registered function for scalars, the plan for columns and arrays."""
    plain = REGISTRY.get(name)

    @rel(name)
    def _(sheet: Sheet, args):
        if plain and any(sheet.depends(a) for a in args):
            return plain.build([sheet.arg(a) for a in args])
        if plain and all(isinstance(sheet.arg(a), Val) for a in args):
            return plain.build([sheet.arg(a) for a in args])
        return f(sheet, args)


def _npv(sheet, args):
    rate = to_num(sheet.scalar(sheet.arg(args[0])))
    df = sheet.attach(flows(sheet, args[1:]), rate.v)
    return sheet.one(df.agg(F.sum(F.col("v") / F.pow(1 + rate.v, F.col("i") + 1)).alias("v")))


plain_or("NPV", _npv)


def root(value, at: list[float]) -> float | None:
    """Where ``value`` of many rates at once changes its sign, by splitting the interval that holds it."""
    for _ in range(12):
        v = value(at)
        k = next((k for k in range(len(at) - 1) if v[k] is not None and v[k + 1] is not None and v[k] * v[k + 1] <= 0), None)
        if k is None:
            return None
        lo, hi = at[k], at[k + 1]
        if hi - lo < 1e-13:
            break
        at = [lo + (hi - lo) * i / 32 for i in range(33)]
    return (lo + hi) / 2


GRID = [-0.999, -0.99, -0.9, -0.75, -0.5, -0.3, -0.2, -0.1, -0.05, 0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0, 2.0, 5.0, 10.0, 100.0]


def solved(df: DataFrame, power: Column) -> Val:
    """The rate at which the flows ``v``, discounted by its power, are worth nothing: 33 rates in one aggregate."""

    def value(rates):
        return list(df.agg(*[F.sum(F.col("v") * F.exp(power * -math.log1p(r))).alias(f"r{i}") for i, r in enumerate(rates)]).first())

    x = root(value, GRID)
    return error("#NUM!") if x is None else Val(F.lit(x), "n")


plain_or("IRR", lambda sheet, args: solved(flows(sheet, args[:1]), F.col("i")))


def dated(sheet: Sheet, args: list[Node]) -> DataFrame:
    """(v, d): the flows with their days after the first row's date."""
    rels = [sheet.rel_of(sheet.arg(a)) for a in args]
    if any(len(r.cols) > 1 for r in rels):
        rels = [sheet.rel_of(Arr([[c] for row in sheet.arg(a).rows for c in row])) for a in args]
    if rels[0].df is not rels[1].df:
        rels = zipped(sheet, rels)
    r = rels[0]
    df = r.df.select(*[F.col(f"`{n}`").alias(f"o{i}") for i, n in enumerate(r.names)], to_num(r.cols[0]).v.alias("v"), to_num(rels[1].cols[0]).v.alias("d"))
    first = df.agg(F.min_by("d", F.struct(*[f"o{i}" for i in range(len(r.names))])).alias("d0"))
    return df.crossJoin(F.broadcast(first)).select("v", (F.col("d") - F.col("d0")).alias("d"))


@rel("XNPV")
def _(sheet, args):
    rate = to_num(sheet.scalar(sheet.arg(args[0])))
    df = sheet.attach(dated(sheet, args[1:3]), rate.v)
    return sheet.one(df.agg(F.sum(F.col("v") / F.pow(1 + rate.v, F.col("d") / 365)).alias("v")))


rel("XIRR")(lambda sheet, args: solved(dated(sheet, args[:2]), F.col("d") / 365))


@rel("MIRR")
def _(sheet, args):
    pay, earn = (to_num(sheet.scalar(sheet.arg(a))) for a in args[1:3])
    df = sheet.attach(flows(sheet, args[:1]), pay.v, earn.v)
    last = df.agg(F.max("i").alias("n"))
    v, i, n = F.col("v"), F.col("i"), F.col("n")
    got = df.crossJoin(F.broadcast(last)).agg(F.sum(F.when(v > 0, v * F.pow(1 + earn.v, n - i))).alias("gain"), F.sum(F.when(v < 0, -v / F.pow(1 + pay.v, i))).alias("cost"), F.max("n").alias("n"))
    got = got.select((F.pow(F.col("gain") / F.col("cost"), 1 / F.col("n")) - 1).alias("v"))
    return sheet.one(got.select("v", when_bad(F.col("v").isNull(), "#DIV/0!").alias("e")), "n", True)


# criteria


def tested(sheet: Sheet, c: Val, n: Node):
    """(predicate, None) of a criterion, or (None, (operator, Val)) of one that reads the formula's row."""
    ok, want = literal(n)
    if ok:
        return criterion(c.v, c.kind, want), None
    op, value = "=", n
    if n.op == "binary" and n.value == "&" and n.args[0].op == "text" and (m := ORDER.match(n.args[0].value)) and not m[2]:
        op, value = m[1], n.args[1]
    x = sheet.scalar(sheet.run(value))
    if sheet.depends(value):
        return None, (op, x)
    return F.coalesce(compare(op, c, x).v, F.lit(False)), None


def conditional(sheet: Sheet, name: str, value: Node | None, pairs: list[tuple[Node, Node]]) -> Val:
    rels = [vector(sheet, a) for a, _ in pairs]
    measured = vector(sheet, value) if value is not None else rels[0]
    if any(r.df is not measured.df for r in rels):
        measured, *rels = zipped(sheet, [measured, *rels])
    keep, keys = F.lit(True), []
    for r, (_, n) in zip(rels, pairs):
        test, row = tested(sheet, r.cols[0], n)
        if row is None:
            keep = keep & test
        else:
            keys.append((r.cols[0], *row))
    m = measured.cols[0]
    cell = F.lit(1.0) if name == "COUNT" else m.v.cast("double") if m.kind in ("n", "d") else F.lit(None).cast("double")
    df = sheet.attach(measured.df, keep, m.v).where(keep)
    agg = ag.aggregate(name, F.col("v")).cast("double").alias("v")
    empty = "#DIV/0!" if name == "AVERAGE" else None
    if not keys:
        got = df.select(cell.alias("v")).agg(agg)
        return sheet.one(got.select("v", when_bad(F.col("v").isNull(), empty).alias("e")), "n", True) if empty else sheet.one(got)
    low = lambda c: F.lower(to_text(c).v) if c.kind == "t" else to_num(c).v
    equal = [(low(c), low(x) if c.kind == "t" else to_num(x).v) for c, op, x in keys if op == "="]
    other = [(to_num(c).v, op, to_num(x).v) for c, op, x in keys if op != "="]
    if other:
        if len(other) > 1 or other[0][1] == "<>" or name not in ("SUM", "COUNT", "AVERAGE"):
            raise Unsupported
        return beyond(sheet, df, name, cell, equal, *other[0])
    grouped = df.select(F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(equal)]).alias("k"), cell.alias("v")).groupBy("k").agg(agg)
    out = sheet.keyed(grouped, F.struct(*[x.alias(f"k{i}") for i, (_, x) in enumerate(equal)]), "n", empty)
    return out if empty else Val(F.coalesce(out.v, F.lit(0.0)), "n")


def beyond(sheet, df, name, cell, equal, c, op, x) -> Val:
    """A criterion such as ">="&[x]: the running sums up to each distinct bound that rows ask for.

    Bounds and facts are laid in one order within each group of the equal criteria; a bound stands
    behind the facts that are at most it, or less than it.
    """
    keys = [f"k{i}" for i in range(len(equal))]
    facts = df.select(*[k.alias(n) for n, (k, _) in zip(keys, equal)], c.alias("b"), cell.alias("s")).where("b is not null").groupBy(*keys, "b").agg(F.sum("s").alias("s"), F.count("s").alias("n"))
    asked = sheet.attach(sheet.df, x, *[y for _, y in equal]).select(*[y.alias(n) for n, (_, y) in zip(keys, equal)], x.alias("b")).where("b is not null").distinct()
    after = op in ("<=", ">")  # of equal values, does the fact come before the bound
    both = facts.select(*keys, "b", "s", "n", F.lit(1 - after).alias("q")).unionByName(asked.select(*keys, "b", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(int(after)).alias("q")))
    both = ordered.running(ordered.running(both, "s", keys, ["b", "q"], "upto_s"), "n", keys, ["b", "q"], "upto_n")
    at = both.where(F.col("q") == int(after)).select(*keys, "b", "upto_s", "upto_n").distinct()
    if op in (">", ">="):
        total = facts.groupBy(*keys).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n")) if keys else facts.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
        at = (at.join(total, keys, "left") if keys else at.crossJoin(F.broadcast(total))).withColumns({f"upto_{c}": F.coalesce(f"all_{c}", F.lit(0)) - F.col(f"upto_{c}") for c in "sn"})
    v = {"SUM": F.col("upto_s"), "COUNT": F.col("upto_n").cast("double"), "AVERAGE": F.when(F.col("upto_n") > 0, F.col("upto_s") / F.col("upto_n"))}[name]
    out = sheet.keyed(at.select(F.struct("b", *keys).alias("k"), v.alias("v")), F.struct(x.alias("b"), *[y.alias(n) for n, (_, y) in zip(keys, equal)]), "n", None)
    if name == "AVERAGE":
        return Val(out.v, "n", when_bad(out.v.isNull(), "#DIV/0!"))
    return Val(F.coalesce(out.v, F.lit(0.0)), "n")


def _ifs(name: str, kind: str):
    @rel(name)
    def _(sheet: Sheet, args):
        if kind == "COUNT":
            return conditional(sheet, kind, None, list(zip(args[::2], args[1::2])))
        if name.endswith("IFS"):
            return conditional(sheet, kind, args[0], list(zip(args[1::2], args[2::2])))
        return conditional(sheet, kind, args[2] if len(args) > 2 else args[0], [(args[0], args[1])])


for _name, _kind in (("SUMIF", "SUM"), ("SUMIFS", "SUM"), ("COUNTIF", "COUNT"), ("COUNTIFS", "COUNT"), ("AVERAGEIF", "AVERAGE"), ("AVERAGEIFS", "AVERAGE"), ("MAXIFS", "MAX"), ("MINIFS", "MIN")):
    _ifs(_name, _kind)


def block(sheet: Sheet, n: Node) -> list[dict]:
    """A criteria block: headers, then rows of alternatives, from an array or a small table."""
    if n.op == "array":
        rows = [[literal(c)[1] for c in r] for r in n.args]
        return [dict(zip(map(str, rows[0]), r)) for r in rows[1:]]
    r = sheet.rel_of(sheet.arg(n))
    got = r.df.select(*r.heads).limit(MOST_CRITERIA + 1).collect()
    if len(got) > MOST_CRITERIA:
        raise Unsupported
    return [x.asDict() for x in got]


def database(sheet: Sheet, args) -> DataFrame:
    """The field's cells of the records that match: ``v`` as a number (texts that are numbers too), ``c`` as it is."""
    r = sheet.rel_of(sheet.arg(args[0]))
    field = sheet.const(args[1]) if args[1].op != "blank" else None
    have = {c.lower(): c for c in r.heads}
    column = r.heads[0] if field is None else r.heads[int(field) - 1] if isinstance(field, (int, float)) else have.get(str(field).lower())
    if column is None:
        raise Unsupported
    rows = [{have[k.lower()]: v for k, v in x.items() if k.lower() in have} for x in block(sheet, args[2])]
    c, kind = F.col(f"`{column}`"), kind_of(r.df.schema[column].dataType)
    v = parse_number(c) if kind == "t" else F.when(c.isNotNull(), to_num(Val(c, kind)).v)
    return r.df.where(any_row(r.df, rows)).select(v.alias("v"), c.alias("c"), F.lit(None).cast("string").alias("e"))


for _name, _kind in (("DSUM", "SUM"), ("DAVERAGE", "AVERAGE"), ("DCOUNT", "COUNT"), ("DMAX", "MAX"), ("DMIN", "MIN"), ("DPRODUCT", "PRODUCT"), ("DSTDEV", "STDEV.S"), ("DSTDEVP", "STDEV.P"), ("DVAR", "VAR.S"), ("DVARP", "VAR.P")):
    rel(_name)(lambda sheet, args, kind=_kind: reduced(sheet, database(sheet, args), kind))


@rel("DCOUNTA")
def _(sheet, args):
    return sheet.one(database(sheet, args).agg(F.count("c").cast("double").alias("v")))


@rel("DGET")
def _(sheet, args):
    df = database(sheet, args)
    cell = F.min("c").cast("double") if kind_of(df.schema["c"].dataType) == "n" else F.min("c")
    got = df.agg(F.count("*").alias("n"), cell.alias("v"))
    return sheet.one(got.select("v", F.when(F.col("n") == 0, "#VALUE!").when(F.col("n") > 1, "#NUM!").alias("e")), kind_of(df.schema["c"].dataType), True)


# lookups


def key_of(c: Val) -> Column:
    return F.lower(c.v) if c.kind == "t" else to_num(c).v if c.kind != "d" else c.v


def placed(sheet: Sheet, r: Rel) -> DataFrame:
    """(k, at, i): the first column's keys, an order, and for answers all columns c0, c1, ..."""
    cells = [shown(c).alias(f"c{j}") for j, c in enumerate(r.cols)]
    at = F.struct(*[F.col(f"`{n}`") for n in r.names]).alias("at")
    return sheet.attach(r.df, *[c.v for c in r.cols]).select(key_of(r.cols[0]).alias("k"), at, *cells)


def looked_up(sheet: Sheet, x: Val, table: Rel, answers: list[Val], mode: int, last: bool) -> tuple[Val, list[Val]]:
    """The answers' cells in the row that the mode finds, as Vals whose error is #N/A for none."""
    joint = Rel(table.df, [table.cols[0], *answers], table.order, table.names, table.heads)
    if not joint.names:
        raise Unsupported
    df = placed(sheet, joint).where("k is not null")
    struct = F.struct(*[f"c{j + 1}" for j in range(len(answers))])
    pick = (F.max_by if last else F.min_by)(struct, F.col("at"))
    first = df.groupBy("k").agg(pick.alias("v"))
    kind = table.cols[0].kind
    key = F.lower(to_text(x).v) if kind == "t" else to_num(x).v
    found = F.lit(None).cast("boolean")
    if mode in (-1, 1):
        keys = sheet.attach(sheet.df if sheet.df is not None else sheet.spark.range(1), key).select(key.alias("q")).where("q is not null").distinct()
        near = ordered.latest(keys, "q", first.withColumn("w", F.struct("v")), "k", "v", "v", following=mode == 1).where("v is not null")
        first = near.select(F.col("q").alias("k"), "v")
    if mode == 2:
        raise Unsupported
    got = sheet.keyed(first, key, "n", "#N/A")
    out = [Val(got.v[f"c{j + 1}"], c.kind, merge(x.err, got.err)) for j, c in enumerate(answers)]
    return got, out


def inline(sheet: Sheet, x: Val, keys: list[Val], results: list[Val], mode: int, last: bool = False) -> Val:
    """A lookup in an array's cells as one expression."""
    hits = []
    for k, r in zip(keys, results):
        if mode == 0:
            hits.append((compare("=", x, k).v, r))
        elif mode == 2 and k.kind == "t":
            hits.append((compare("=", x, k).v, r))
        else:
            hits.append((compare(">=" if mode < 0 else "<=", x, k).v, r))
    if mode == -1:
        hits = hits[::-1]
    if last:
        hits = hits[::-1]
    from .functions.logic import _choose

    return _choose([(Val(F.coalesce(c, F.lit(False)), "b"), r) for c, r in hits], error("#N/A"))


def if_missing(x: Val, other: Val | None) -> Val:
    return x if other is None else REGISTRY["IFNA"].build([x, other])


@rel("XLOOKUP")
def _(sheet, args):
    x = sheet.scalar(sheet.arg(args[0]))
    keys, back = sheet.arg(args[1]), sheet.arg(args[2])
    missing = sheet.scalar(sheet.arg(args[3])) if len(args) > 3 and args[3].op != "blank" else None
    mode = int(sheet.const(args[4], 0)) if len(args) > 4 else 0
    last = int(sheet.const(args[5], 1)) == -1 if len(args) > 5 else False
    if isinstance(keys, Arr):
        cells = lambda a: [c for r in a.rows for c in r]
        return if_missing(inline(sheet, x, cells(keys), cells(back), mode, last), missing)
    if back.df is not keys.df:
        keys, back = zipped(sheet, [keys, back])
    if mode == 2:
        return if_missing(by_pattern(sheet, args[0], keys, back.cols[0]), missing)
    return if_missing(looked_up(sheet, x, keys, back.cols[:1], mode, last)[1][0], missing)


def by_pattern(sheet, n: Node, keys: Rel, back: Val) -> Val:
    """The first row whose text meets a constant pattern."""
    pattern = sheet.const(n)
    df = sheet.attach(keys.df, back.v).where(F.lower(to_text(keys.cols[0]).v).rlike(wildcard(str(pattern).lower())))
    got = df.agg(F.min_by(F.struct(shown(back).alias("v")), F.struct(*[F.col(f"`{c}`") for c in keys.names])).alias("r"))
    return sheet.one(got.select("r.v", when_bad(F.col("r").isNull(), "#N/A").alias("e")), back.kind, True)


@rel("VLOOKUP")
def _(sheet, args):
    x, table, column = sheet.scalar(sheet.arg(args[0])), sheet.arg(args[1]), int(sheet.const(args[2]))
    near = bool(sheet.const(args[3], False)) if len(args) > 3 else False
    if isinstance(table, Arr):
        if not 1 <= column <= len(table.rows[0]):
            return error("#REF!")
        return inline(sheet, x, [r[0] for r in table.rows], [r[column - 1] for r in table.rows], -1 if near else 0)
    if not 1 <= column <= len(table.cols):
        return error("#REF!")
    ok, want = literal(args[0])
    if ok and isinstance(want, str) and re.search(r"[*?~]", want) and not near:
        got = by_pattern(sheet, args[0], table, table.cols[column - 1])
    else:
        got = looked_up(sheet, x, table, [table.cols[column - 1]], -1 if near else 0, False)[1][0]
    return got if got.kind != "n" else Val(F.coalesce(got.v.cast("double"), F.lit(0.0)), "n", got.err)


@rel("HLOOKUP")
def _(sheet, args):
    x, table, row = sheet.scalar(sheet.arg(args[0])), sheet.arg(args[1]), int(sheet.const(args[2]))
    near = bool(sheet.const(args[3], False)) if len(args) > 3 else False
    if isinstance(table, Arr):
        if not 1 <= row <= len(table.rows):
            return error("#REF!")
        return inline(sheet, x, table.rows[0], table.rows[row - 1], -1 if near else 0)
    # a table's headers are its first row
    if row == 1:
        return inline(sheet, x, [Val(F.lit(c), "t") for c in table.heads], [Val(F.lit(c), "t") for c in table.heads], 0)
    got = sheet.attach(table.df).orderBy(*sorting(table)).limit(row - 1).select(*[shown(c).alias(f"c{j}") for j, c in enumerate(table.cols)], *[F.col(f"`{n}`").alias(f"o{i}") for i, n in enumerate(table.names)])
    no = sheet.side(got.agg(*[F.max_by(f"c{j}", F.struct(*[f"o{i}" for i in range(len(table.names))])).alias(f"c{j}") for j in range(len(table.cols))]))
    return inline(sheet, x, [Val(F.lit(c), "t") for c in table.heads], [Val(F.col(f"__j{no}_c{j}"), c.kind) for j, c in enumerate(table.cols)], 0)


def position(sheet, args, mode: int, last: bool) -> Val:
    x, keys = sheet.scalar(sheet.arg(args[0])), sheet.arg(args[1])
    if isinstance(keys, Arr):
        cells = [c for r in keys.rows for c in r]
        return inline(sheet, x, cells, [Val(F.lit(float(i + 1)), "n") for i in range(len(cells))], mode, last)
    df = sheet.attach(keys.df, keys.cols[0].v).select(*[F.col(f"`{n}`") for n in keys.names], shown(keys.cols[0]).alias("__key"))
    df = ordered.numbered(df, *keys.names, alias="__place")
    r = Rel(df, [Val(F.col("__key"), keys.cols[0].kind)], [(F.col("__place"), True)], ("__place",), ("__key",))
    ok, want = literal(args[0])
    if mode == 2 or (ok and mode == 0 and isinstance(want, str) and re.search(r"[*?~]", want)):
        return by_pattern(sheet, args[0], r, Val(F.col("__place").cast("double"), "n"))
    # of equal bounds the approximate modes mean the last row
    return looked_up(sheet, x, r, [Val(F.col("__place").cast("double"), "n")], mode, last or mode == -1)[1][0]


@rel("MATCH")
def _(sheet, args):
    kind = int(sheet.const(args[2], 1)) if len(args) > 2 else 1
    return position(sheet, args, {0: 0, 1: -1, -1: 1}[max(-1, min(1, kind))], False)


@rel("XMATCH")
def _(sheet, args):
    mode = int(sheet.const(args[2], 0)) if len(args) > 2 else 0
    return position(sheet, args, mode, int(sheet.const(args[3], 1)) == -1 if len(args) > 3 else False)


@rel("LOOKUP")
def _(sheet, args):
    x, keys = sheet.scalar(sheet.arg(args[0])), sheet.arg(args[1])
    if isinstance(keys, Arr):
        cells = [c for r in keys.rows for c in r] if len(args) > 2 else [r[0] for r in keys.rows]
        back = [c for r in sheet.arg(args[2]).rows for c in r] if len(args) > 2 else [r[-1] for r in keys.rows]
        return inline(sheet, x, cells, back, -1)
    back = sheet.arg(args[2]) if len(args) > 2 else Rel(keys.df, keys.cols[-1:], keys.order, keys.names, keys.heads)
    return looked_up(sheet, x, keys, back.cols[:1], -1, True)[1][0]


@rel("INDEX")
def _(sheet, args):
    table = sheet.arg(args[0])
    column = int(sheet.const(args[2], 0)) if len(args) > 2 else 0
    if isinstance(table, Val):
        return table
    if isinstance(table, Arr):
        flat = [c for r in table.rows for c in r] if 1 in (len(table.rows), len(table.rows[0])) else None
        if flat and len(args) < 3:
            cells = flat
        else:
            cells = [r[max(column, 1) - 1] for r in table.rows] if column <= len(table.rows[0]) else None
        if cells is None:
            return error("#REF!")
        i = to_num(sheet.scalar(sheet.arg(args[1])))
        from .functions.logic import _choose

        return _choose([(Val(F.floor(i.v) == k + 1, "b", i.err if not k else None), c) for k, c in enumerate(cells)], error("#REF!"))
    if column > len(table.cols):
        return error("#REF!")
    if column:
        table = Rel(table.df, [table.cols[column - 1]], table.order, table.names, table.heads)
    ok, row = literal(args[1])
    if ok and not row:
        return table
    i = to_num(sheet.scalar(sheet.arg(args[1])))
    c = table.cols[0]
    df = ordered.numbered(sheet.attach(table.df, c.v).select(*[F.col(f"`{n}`") for n in table.names], shown(c).alias("v")), *table.names, alias="k")
    got = sheet.keyed(df.select(F.col("k").cast("double"), "v"), F.floor(i.v).cast("double"), c.kind, "#REF!")
    return Val(got.v, c.kind, merge(i.err, got.err))


# references


@rel("ROWS")
def _(sheet, args):
    x = sheet.arg(args[0])
    if isinstance(x, Rel):
        return sheet.one(x.df.agg(F.count("*").cast("double").alias("v")))
    return Val(F.lit(float(len(x.rows)) if isinstance(x, Arr) else 1.0), "n", None if isinstance(x, Arr) else x.err)


@rel("COLUMNS")
def _(sheet, args):
    x = sheet.arg(args[0])
    return Val(F.lit(float(len(x.cols) if isinstance(x, Rel) else len(x.rows[0]) if isinstance(x, Arr) else 1)), "n", x.err if isinstance(x, Val) else None)


def here(sheet: Sheet) -> Column:
    """The 1-based place of the formula's row: a join by the order columns' numbers."""
    if sheet.df is None or not sheet.order:
        raise Unsupported
    key = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(sheet.order)])
    df = ordered.numbered(sheet.df.select(*sheet.order), *sheet.order, alias="__place")
    side = df.select(F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(sheet.order)]).alias("k"), F.col("__place").alias("v"))
    return sheet.keyed(side, key, "n", None).v


@rel("ROW")
def _(sheet, args):
    if args and isinstance(x := sheet.arg(args[0]), Rel):
        df = ordered.numbered(x.df.select(*x.names), *x.names, alias="v")
        return Rel(df, [Val(F.col("v").cast("double"), "n")], [(F.col("v"), True)], ("v",), ("v",))
    return Val(here(sheet).cast("double"), "n")


@rel("COLUMN")
def _(sheet, args):
    if not args or args[0].op not in ("column", "name"):
        return Val(F.lit(float(len(sheet.df.columns) + 1 if sheet.df is not None else 1)), "n")
    table, column = (args[0].value[0], args[0].value[1]) if args[0].op == "column" else (None, str(args[0].value))
    df = self_or(sheet, table)
    names = [c.lower() for c in df.columns]
    return Val(F.lit(float(names.index(column.lower()) + 1)), "n") if column.lower() in names else error("#REF!")


def self_or(sheet: Sheet, table: str | None) -> DataFrame:
    return sheet.tables[table.lower()][0] if table and table.lower() in sheet.tables else sheet.df


@rel("OFFSET")
def _(sheet, args):
    """A column some rows and columns away: of the formula's table the cell there, of another the shifted column."""
    down, right = int(sheet.const(args[1], 0)), int(sheet.const(args[2], 0))
    n = args[0]
    if n.op != "column":
        raise Unsupported
    df = self_or(sheet, n.value[0])
    names = {c.lower(): i for i, c in enumerate(df.columns)}
    at = names.get(n.value[1].lower(), -10**6) + right
    if not 0 <= at < len(df.columns):
        return error("#REF!")
    column, kind = df.columns[at], kind_of(df.schema[df.columns[at]].dataType)
    if df is sheet.df or not n.value[0]:
        if not down:
            return Val(F.col(f"`{column}`"), kind)
        place = here(sheet) + down
        rows = ordered.numbered(sheet.df.select(*sheet.order, F.col(f"`{column}`").alias("__cell")), *sheet.order, alias="__place")
        got = sheet.keyed(rows.select(F.col("__place").alias("k"), F.col("__cell").alias("v")), place, kind, "#REF!")
        return Val(got.v, kind, got.err)
    r = sheet.relation(n.value[0], column)
    rows = ordered.numbered(r.df.select(*r.names, F.col(f"`{column}`").alias("__cell")), *r.names, alias="__place").where(F.col("__place") > down)
    if len(args) > 3 and args[3].op != "blank":
        rows = rows.where(F.col("__place") <= down + int(sheet.const(args[3])))
    return Rel(rows, [Val(F.col("__cell"), kind)], [(F.col("__place"), True)], ("__place",), ("__cell",))


@rel("INDIRECT")
def _(sheet, args):
    return sheet.run(parse("=" + str(sheet.const(args[0]))))


@rel("FORMULATEXT")
def _(sheet, args):
    name = str(args[0].value[1] if args[0].op == "column" else args[0].value).lower()
    return Val(F.lit("=" + sheet.formulas[name].lstrip("=")), "t") if name in sheet.formulas else error("#N/A")


@rel("ISFORMULA")
def _(sheet, args):
    name = str(args[0].value[1] if args[0].op == "column" else args[0].value).lower()
    return Val(F.lit(name in sheet.formulas), "b")


@rel("ISREF")
def _(sheet, args):
    return Val(F.lit(args[0].op in ("column", "cell", "range") or (args[0].op == "name" and str(args[0].value).lower() in sheet.tables)), "b")


# arrays


def keep(r: Rel, df: DataFrame, cols=None, order=None, names=None) -> Rel:
    return Rel(df, r.cols if cols is None else cols, r.order if order is None else order, r.names if names is None else names, r.heads)


def solid(sheet: Sheet, r: Rel) -> Rel:
    """The relation with its columns computed, as c0, c1, ..., beside what orders it."""
    df = sheet.attach(r.df, *[c.v for c in r.cols], *[c.err for c in r.cols])
    order = [F.col(f"`{n}`").alias(f"o{i}") for i, n in enumerate(r.names)]
    out = df.select(*order, *[shown(c).alias(f"c{j}") for j, c in enumerate(r.cols)])
    return Rel(out, [Val(F.col(f"c{j}"), c.kind) for j, c in enumerate(r.cols)], [(F.col(f"o{i}"), True) for i in range(len(r.names))], tuple(f"o{i}" for i in range(len(r.names))), tuple(f"c{j}" for j in range(len(r.cols))))


@rel("FILTER")
def _(sheet, args):
    r, test = sheet.rel_of(sheet.arg(args[0])), sheet.arg(args[1])
    if not isinstance(test, Rel) or test.df is not r.df:
        r, test = zipped(sheet, [r, sheet.rel_of(test)])
    hold = F.lit(False)
    for c in test.cols:
        b = (c.v.isNotNull() & (c.v != "")) if c.kind == "t" else to_bool(c).v
        hold = hold | F.coalesce(b if c.err is None else b & c.err.isNull(), F.lit(False))
    df = sheet.attach(r.df, hold).where(hold)
    if len(args) > 2 and args[2].op != "blank" and df.isEmpty():
        return sheet.rel_of(sheet.arg(args[2]))
    return keep(r, df)


def sorted_by(r: Rel, keys: list[tuple[Column, int]]) -> Rel:
    return keep(r, r.df, order=[(k, s >= 0) for k, s in keys] + r.order, names=())


@rel("SORT")
def _(sheet, args):
    r = solid(sheet, sheet.rel_of(sheet.arg(args[0])))
    at, way = int(sheet.const(args[1], 1)) if len(args) > 1 else 1, sheet.const(args[2], 1) if len(args) > 2 else 1
    if not 1 <= at <= len(r.cols):
        return error("#VALUE!")
    return sorted_by(r, [(key_of(r.cols[at - 1]), -1 if way < 0 else 1)])


@rel("SORTBY")
def _(sheet, args):
    r, keys = sheet.rel_of(sheet.arg(args[0])), [sheet.rel_of(sheet.arg(a)) for a in args[1::2]]
    if any(k.df is not r.df for k in keys):
        r, *keys = zipped(sheet, [r, *keys])
    ways = [sheet.const(a, 1) for a in args[2::2]] + [1] * len(keys)
    both = solid(sheet, Rel(r.df, r.cols + [k.cols[0] for k in keys], r.order, r.names, r.heads))
    out = sorted_by(both, [(key_of(both.cols[len(r.cols) + i]), -1 if ways[i] < 0 else 1) for i in range(len(keys))])
    return keep(out, out.df, cols=out.cols[: len(r.cols)])


def by_ends(r: Rel, rows: int | None, drop: bool) -> Rel:
    if rows is None:
        return r
    df = r.df.orderBy(*sorting(r, rows < 0))
    return keep(r, df.offset(abs(rows)) if drop else df.limit(abs(rows)))


def ends(drop: bool):
    def run(sheet: Sheet, args):
        x = sheet.arg(args[0])
        rows = int(sheet.const(args[1])) if len(args) > 1 and args[1].op != "blank" else None
        columns = int(sheet.const(args[2])) if len(args) > 2 and args[2].op != "blank" else None
        cut = lambda xs, k: xs if k is None else (xs[k:] if k >= 0 else xs[:k]) if drop else (xs[:k] if k >= 0 else xs[k:])
        if isinstance(x, Arr):
            if not drop and ((rows is not None and abs(rows) > len(x.rows)) or (columns is not None and abs(columns) > len(x.rows[0]))):
                return error("#VALUE!")
            return Arr([cut(r, columns) for r in cut(x.rows, rows)])
        r = sheet.rel_of(x)
        if columns is not None and not drop and abs(columns) > len(r.cols):
            return error("#VALUE!")
        r = by_ends(solid(sheet, r) if r.names else r, rows, drop)
        return keep(r, r.df, cols=cut(r.cols, columns))

    return run


rel("TAKE")(ends(False))
rel("DROP")(ends(True))


@rel("UNIQUE")
def _(sheet, args):
    r = solid(sheet, sheet.rel_of(sheet.arg(args[0])))
    once = bool(sheet.const(args[2], False)) if len(args) > 2 else False
    keys = [key_of(c).alias(f"k{j}") for j, c in enumerate(r.cols)]
    first = F.min(F.struct(*[F.col(f"`{n}`") for n in r.names], *[c.v.alias(f"x{j}") for j, c in enumerate(r.cols)])).alias("f")
    df = r.df.groupBy(*keys).agg(F.count("*").alias("n"), first)
    df = (df.where("n = 1") if once else df).select(*[F.col(f"f.{n}") for n in r.names], *[F.col(f"f.x{j}").alias(f"c{j}") for j in range(len(r.cols))])
    return Rel(df, [Val(F.col(f"c{j}"), c.kind) for j, c in enumerate(r.cols)], r.order, r.names, r.heads)


def picked(sheet, args) -> list[int]:
    out = []
    for a in args:
        x = sheet.arg(a)
        out += [int(literal(c)[1]) for r in a.args for c in r] if a.op == "array" else [int(sheet.const(a))] if isinstance(x, Val) else []
    return out


@rel("CHOOSECOLS")
def _(sheet, args):
    x, at = sheet.arg(args[0]), picked(sheet, args[1:])
    width = len(x.rows[0]) if isinstance(x, Arr) else len(sheet.rel_of(x).cols)
    if any(k == 0 or abs(k) > width for k in at):
        return error("#VALUE!")
    take = [k - 1 if k > 0 else k for k in at]
    if isinstance(x, Arr):
        return Arr([[r[k] for k in take] for r in x.rows])
    r = sheet.rel_of(x)
    return keep(r, r.df, cols=[r.cols[k] for k in take])


@rel("CHOOSEROWS")
def _(sheet, args):
    x, at = sheet.arg(args[0]), picked(sheet, args[1:])
    if isinstance(x, Arr):
        if any(k == 0 or abs(k) > len(x.rows) for k in at):
            return error("#VALUE!")
        return Arr([x.rows[k - 1 if k > 0 else k] for k in at])
    if 0 in at:
        return error("#VALUE!")
    r = solid(sheet, sheet.rel_of(x))
    df = ordered.numbered(r.df, *r.names, alias="__place")
    n = r.df.count() if min(at) < 0 else 0
    want = sheet.spark.createDataFrame([(i, k if k > 0 else n + 1 + k) for i, k in enumerate(at)], "__nth int, __place long")
    got = df.join(F.broadcast(want), "__place")
    return Rel(got, r.cols, [(F.col("__nth"), True)], ("__nth",), r.heads)


@rel("HSTACK")
def _(sheet, args):
    xs = [sheet.arg(a) for a in args]
    if all(isinstance(x, (Arr, Val)) for x in xs):
        xs = [x if isinstance(x, Arr) else Arr([[x]]) for x in xs]
        h = max(len(x.rows) for x in xs)
        if any(len(x.rows) != h for x in xs):
            return error("#VALUE!")
        return Arr([[c for x in xs for c in x.rows[i]] for i in range(h)])
    rels = [sheet.rel_of(x) for x in xs]
    if any(r.df is not rels[0].df for r in rels):
        rels = zipped(sheet, rels)
    return keep(rels[0], rels[0].df, cols=[c for r in rels for c in r.cols])


@rel("VSTACK")
def _(sheet, args):
    xs = [sheet.arg(a) for a in args]
    if all(isinstance(x, (Arr, Val)) for x in xs):
        rows = [r for x in xs for r in (x.rows if isinstance(x, Arr) else [[x]])]
        return error("#VALUE!") if len({len(r) for r in rows}) > 1 else Arr(rows)
    rels = [solid(sheet, sheet.rel_of(x)) for x in xs]
    if len({len(r.cols) for r in rels}) > 1:
        return error("#VALUE!")
    out, kinds = None, ["t" if len({r.cols[j].kind for r in rels}) > 1 else rels[0].cols[j].kind for j in range(len(rels[0].cols))]
    for k, r in enumerate(rels):
        cells = [(to_text(c).v if kind == "t" else c.v.cast("double") if kind == "n" else c.v).alias(f"c{j}") for j, (c, kind) in enumerate(zip(r.cols, kinds))]
        part = ordered.numbered(r.df, *r.names, alias="__place").select(F.lit(k).alias("__part"), "__place", *cells) if r.names else r.df.select(F.lit(k).alias("__part"), F.lit(0).cast("long").alias("__place"), *cells)
        out = part if out is None else out.unionByName(part)
    return Rel(out, [Val(F.col(f"c{j}"), k) for j, k in enumerate(kinds)], [(F.col("__part"), True), (F.col("__place"), True)], ("__part", "__place"), tuple(f"c{j}" for j in range(len(kinds))))


def in_line(down: bool):
    def run(sheet: Sheet, args):
        x = sheet.arg(args[0])
        skip = int(sheet.const(args[1], 0)) if len(args) > 1 else 0
        by_column = bool(sheet.const(args[2], False)) if len(args) > 2 else False
        if isinstance(x, (Arr, Val)):
            rows = x.rows if isinstance(x, Arr) else [[x]]
            cells = [c for r in (zip(*rows) if by_column else rows) for c in r]
            cells = [c for c in cells if not (skip in (1, 3) and c.kind == "z") and not (skip in (2, 3) and c.err is not None)]
            return Arr([[c] for c in cells]) if down else Arr([cells])
        if not down:
            raise Unsupported  # a row of unbounded length
        r = solid(sheet, x)
        kind = "n" if all(c.kind in "nd" for c in r.cols) else "t"
        cell = lambda c: to_num(c).v if kind == "n" and c.kind == "d" else c.v.cast("double") if kind == "n" else F.when(c.v.isNotNull(), to_text(c).v)
        df = r.df.select(*r.names, F.posexplode(F.array(*[cell(c) for c in r.cols])).alias("__at", "v"))
        df = df.where("v is not null") if skip in (1, 3) else df
        names = ("__at", *r.names) if by_column else (*r.names, "__at")
        return Rel(df, [Val(F.col("v"), kind)], [(F.col(n), True) for n in names], names, ("v",))

    return run


rel("TOCOL")(in_line(True))
rel("TOROW")(in_line(False))


@rel("TRANSPOSE")
def _(sheet, args):
    x = sheet.arg(args[0])
    if isinstance(x, Val):
        return x
    if isinstance(x, Rel):
        rows = x.df.limit(MOST_CRITERIA + 1).count()
        if rows > MOST_CRITERIA:
            raise Unsupported  # a sheet's columns are bounded
        r = solid(sheet, x)
        got = r.df.orderBy(*sorting(r)).collect()
        lit = lambda v, k: Val(F.lit(v), k)
        return Arr([[lit(row[f"c{j}"], c.kind) for row in got] for j, c in enumerate(r.cols)])
    return Arr([list(r) for r in zip(*x.rows)])


@rel("SEQUENCE")
def _(sheet, args):
    rows, columns, start, step = (sheet.const(args[i], 1) if len(args) > i else 1 for i in range(4))
    if rows < 1 or columns < 1:
        return error("#VALUE!")
    df = sheet.spark.range(int(rows)).withColumnRenamed("id", "row_id")
    cols = [Val((F.lit(float(start)) + float(step) * (F.col("row_id") * int(columns) + k)).cast("double"), "n") for k in range(int(columns))]
    return Rel(df, cols, [(F.col("row_id"), True)], ("row_id",), ("row_id",))


@rel("RANDARRAY")
def _(sheet, args):
    rows, columns, lo, hi = (sheet.const(args[i], d) if len(args) > i else d for i, d in enumerate((1, 1, 0, 1)))
    whole = bool(sheet.const(args[4], False)) if len(args) > 4 else False
    if rows < 1 or columns < 1 or lo > hi:
        return error("#VALUE!")
    df = sheet.spark.range(int(rows)).withColumnRenamed("id", "row_id")
    x = [F.rand() for _ in range(int(columns))]
    cols = [Val(F.floor(v * (hi - lo + 1)).cast("double") + float(lo) if whole else v * (float(hi) - float(lo)) + float(lo), "n") for v in x]
    return Rel(df, cols, [(F.col("row_id"), True)], ("row_id",), ("row_id",))


@rel("TEXTSPLIT")
def _(sheet, args):
    x = to_text(sheet.scalar(sheet.arg(args[0])))
    across = sheet.const(args[1]) if args[1].op != "blank" else None
    down = sheet.const(args[2]) if len(args) > 2 and args[2].op != "blank" else None
    cut = lambda c, by: F.split(c, F.concat(F.lit(r"\Q"), F.lit(str(by)), F.lit(r"\E")), -1)
    if sheet.depends(args[0]):
        return Val(F.element_at(cut(x.v, across if across is not None else down), 1), "t", x.err)
    df = sheet.attach(sheet.spark.range(1), x.v).select(F.posexplode(cut(x.v, down) if down is not None else F.array(x.v)).alias("row_id", "line"))
    if across is None:
        return Rel(df, [Val(F.col("line"), "t")], [(F.col("row_id"), True)], ("row_id",), ("line",))
    parts = df.select("row_id", cut(F.col("line"), across).alias("p"))
    width = parts.agg(F.max(F.size("p"))).first()[0]
    cells = [Val(F.get("p", k), "t", when_bad(F.size("p") <= k, "#N/A")) for k in range(width)]
    return Rel(parts, cells, [(F.col("row_id"), True)], ("row_id",), ("p",))


@rel("ARRAYTOTEXT")
def _(sheet, args):
    x = sheet.arg(args[0])
    strict = bool(sheet.const(args[1], 0)) if len(args) > 1 else False
    if isinstance(x, Rel):
        got = solid(sheet, x).df.limit(MOST_CRITERIA + 1).count()
        if got > MOST_CRITERIA:
            return error("#VALUE!")  # a cell's text is bounded
        x = RELATIONAL["TRANSPOSE"](sheet, args[:1])
        x = Arr([list(r) for r in zip(*x.rows)]) if isinstance(x, Arr) else x
    rows = x.rows if isinstance(x, Arr) else [[x]]
    one = lambda c: F.concat(F.lit('"'), to_text(c).v, F.lit('"')) if strict and c.kind == "t" else to_text(c).v
    if strict:
        text = F.concat(F.lit("{"), F.concat_ws(";", *[F.concat_ws(",", *[one(c) for c in r]) for r in rows]), F.lit("}"))
    else:
        text = F.concat_ws(", ", *[one(c) for r in rows for c in r])
    return Val(text, "t", merge(*[c.err for r in rows for c in r]))


def code(n: Node, sheet: Sheet) -> str:
    if n.op in ("name", "call"):
        return str(n.value).upper()
    v = sheet.const(n)
    return ag.GROUP_CODES[int(v)] if isinstance(v, (int, float)) else str(v).upper()


@rel("GROUPBY")
def _(sheet, args):
    """Keys in their own types; sorted by the keys' text, ``sort`` < 0 from the end; a depth of 1 adds the grand total."""
    keys, values = sheet.rel_of(sheet.arg(args[0])), sheet.rel_of(sheet.arg(args[1]))
    if values.df is not keys.df:
        keys, values = zipped(sheet, [keys, values])
    name, total = code(args[2], sheet), int(sheet.const(args[4], 0)) if len(args) > 4 else 0
    way = -1 if len(args) > 5 and sheet.const(args[5], 1) < 0 else 1
    df = sheet.attach(keys.df, *[c.v for c in keys.cols + values.cols])
    df = df.select(*[shown(c).alias(f"k{j}") for j, c in enumerate(keys.cols)], *[to_num(c).v.alias(f"v{j}") if c.kind != "n" else c.v.cast("double").alias(f"v{j}") for j, c in enumerate(values.cols)])
    names = [f"k{j}" for j in range(len(keys.cols))]
    cells = [ag.aggregate(name, F.col(f"v{j}")).cast("double").alias(f"a{j}") for j in range(len(values.cols))]
    out = df.groupBy(*names).agg(*cells).withColumn("__last", F.lit(0))
    cols = [Val(F.col(n), c.kind) for n, c in zip(names, keys.cols)]
    if total >= 1:
        texts = [to_text(Val(F.col(n), c.kind)).v.alias(n) for n, c in zip(names, keys.cols)]
        grand = df.agg(*cells).select(F.lit("Grand Total").alias(names[0]), *[F.lit("").alias(n) for n in names[1:]], *[f"a{j}" for j in range(len(cells))], F.lit(1).alias("__last"))
        out = out.select(*texts, *[f"a{j}" for j in range(len(cells))], "__last").unionByName(grand)
        cols = [Val(F.col(n), "t") for n in names]
    order = [(F.col("__last"), True), *[(F.col(n), way > 0) for n in names]]
    return Rel(out, cols + [Val(F.col(f"a{j}"), "n") for j in range(len(cells))], order, ("__last", *names) if way > 0 else (), (*names, *[f"a{j}" for j in range(len(cells))]))


@rel("PIVOTBY")
def _(sheet, args):
    """The first columns of the column field and the values; up to MOST_CRITERIA categories, in order, read first."""
    rows, columns, values = (sheet.rel_of(sheet.arg(a)) for a in args[:3])
    if columns.df is not rows.df or values.df is not rows.df:
        rows, columns, values = zipped(sheet, [rows, columns, values])
    name = code(args[3], sheet)
    total = int(sheet.const(args[5], 0)) if len(args) > 5 else 0
    df = sheet.attach(rows.df, *[c.v for c in rows.cols], columns.cols[0].v, values.cols[0].v)
    v = values.cols[0]
    df = df.select(*[shown(c).alias(f"k{j}") for j, c in enumerate(rows.cols)], shown(columns.cols[0]).alias("c"), (v.v.cast("double") if v.kind == "n" else F.lit(1.0)).alias("v"))
    have = sorted(r.c for r in df.select("c").where("c is not null").distinct().limit(MOST_CRITERIA + 1).collect())
    if len(have) > MOST_CRITERIA:
        raise Unsupported
    keys = [f"k{j}" for j in range(len(rows.cols))]
    got = ag.pivotby(df, keys, "c", "v", name, have, total=total >= 1)
    cells = [Val(F.col(f"`{k}`").cast("double"), "n") for k in have] + ([Val(F.col("Total").cast("double"), "n")] if total >= 1 else [])
    return Rel(got, [Val(F.col(k), c.kind) for k, c in zip(keys, rows.cols)] + cells, [(F.col(k), True) for k in keys], tuple(keys), tuple([*keys, *map(str, have), *(["Total"] if total >= 1 else [])]))


def copied_down(df: DataFrame, formulas: dict[str, str], tables: dict[str, tuple[DataFrame, list[str]]], order: list[str] = (), errors: bool = False, names=None) -> DataFrame:
    """``df`` with formulas copied down that may read whole columns of ``tables``.

    ``order``: the columns that stand for the rows' places in ``df``, needed by ROW and OFFSET.
    """
    sheet = Sheet(df.sparkSession, tables, df, order, names, formulas)
    got = {k: sheet.scalar(sheet.run(parse(f))) for k, f in formulas.items()}
    out = sheet.attach(df, *[e for x in got.values() for e in (x.v, x.err)])
    cells = {k: shown(x) for k, x in got.items()}
    if errors:
        cells |= {f"{k}__error": F.lit(None).cast("string") if x.err is None else x.err for k, x in got.items()}
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in cells], *[c.alias(k) for k, c in cells.items()])


def spill(spark: SparkSession, formula: str, tables: dict[str, tuple[DataFrame, list[str]]], names=None) -> DataFrame:
    """A formula's array as a DataFrame c1, c2, ... in its order; an error in a cell is null."""
    sheet = Sheet(spark, tables, names=names)
    got = sheet.run(parse(formula))
    r = sheet.rel_of(got)
    cols = [shown(c).alias(f"c{j + 1}") for j, c in enumerate(r.cols)]
    df = sheet.attach(r.df, *[c.v for c in r.cols], *[c.err for c in r.cols])
    return (df.orderBy(*sorting(r)) if r.order else df).select(*cols)


#: Functions whose value changes though nothing that they read does.
VOLATILE = {"RAND", "RANDBETWEEN", "RANDARRAY", "NOW", "TODAY", "OFFSET", "INDIRECT"}
ARRAYS = {"FILTER", "SORT", "SORTBY", "UNIQUE", "TAKE", "DROP", "CHOOSECOLS", "CHOOSEROWS", "HSTACK", "VSTACK", "TOCOL", "TOROW", "TRANSPOSE", "SEQUENCE", "RANDARRAY", "GROUPBY", "PIVOTBY", "TEXTSPLIT", "FREQUENCY", "MODE.MULT", "LINEST", "LOGEST", "TREND", "GROWTH", "INDEX", "OFFSET", "INDIRECT"}
LOOKUPS = {"VLOOKUP", "HLOOKUP", "XLOOKUP", "LOOKUP", "MATCH", "XMATCH", "INDEX"}


def catalogue() -> dict[str, dict]:
    """Every function: how it is planned, its numbers of arguments where they are fixed, and what is true of it."""
    from .functions.registry import PYTHON

    out = {}
    for name in sorted(REGISTRY.keys() | RELATIONAL.keys() | {"LET", "LAMBDA"}):
        f = REGISTRY.get(name)
        out[name] = {
            "least": f.least if f else None, "most": f.most if f and f.most < 255 else None, "pure": name not in VOLATILE, "volatile": name in VOLATILE, "elementwise": f is not None, "array": name in ARRAYS,
            "lookup": name in LOOKUPS, "reduction": name in RELATIONAL and name not in ARRAYS | LOOKUPS, "plan": "relation" if name in RELATIONAL else "python" if name in PYTHON else "expression",
        }
    return out
