"""Typed ports on a workbook file: inputs written to cells, the book computed, outputs read.

A manifest names the ports: scalars, records of scalars, ranges and tables, at an A1 address, a
defined name or a layout (a header row, columns, and how the rows end). ``batch`` runs a model of
scalar ports for many scenarios at once: scenarios are rows, cells that follow from inputs are
columns, and every layer of cells is one projection.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..values import ERRORS, Val, shown
from . import ports
from .recalc import Book, CellSheet, split_cell

KINDS = {"number": "double", "integer": "double", "string": "string", "boolean": "boolean", "date": "double", "datetime": "double"}
CASTS: dict[str, Callable] = {"number": float, "integer": int, "string": str, "boolean": bool, "date": lambda v: (dt.date(1899, 12, 30) + dt.timedelta(days=int(v))), "datetime": lambda v: dt.datetime(1899, 12, 30) + dt.timedelta(days=float(v))}


class PortError(ValueError):
    pass


def checked(name: str, value, kind: str, limits: dict):
    """The value in its type, or PortError."""
    if value is None:
        if limits.get("nullable", True):
            return None
        raise PortError(f"{name}: a value is needed")
    if isinstance(value, str) and value in ERRORS:
        raise PortError(f"{name}: {value}")
    good = {"number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "date": lambda v: isinstance(v, (int, float, dt.date)), "datetime": lambda v: isinstance(v, (int, float, dt.datetime))}
    if not good[kind](value):
        raise PortError(f"{name}: {value!r} is no {kind}")
    if not isinstance(value, (dt.date, dt.datetime)):
        value = CASTS[kind](value)
    if "min" in limits and value < limits["min"] or "max" in limits and value > limits["max"]:
        raise PortError(f"{name}: {value!r} is out of range")
    if limits.get("enum") and value not in limits["enum"]:
        raise PortError(f"{name}: {value!r} is not allowed")
    if limits.get("pattern") and not re.fullmatch(limits["pattern"], str(value)):
        raise PortError(f"{name}: {value!r} doesn't match {limits['pattern']!r}")
    return value


def stored(v):
    """A value as a cell holds it: dates as serial numbers."""
    if isinstance(v, dt.datetime):
        return (v - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
    return float((v - dt.date(1899, 12, 30)).days) if isinstance(v, dt.date) else v


class Session:
    def __init__(self, book: Book, manifest: dict):
        self.book, self.ports = book, {p["id"]: p for p in manifest["ports"]}

    def address(self, place: dict) -> tuple[str, str]:
        text = place.get("a1") or self.book.defined.get(str(place.get("name", "")).lower(), "")
        sheet, bang, area = text.rpartition("!")
        if not area:
            raise PortError(f"no cell for {place!r}")
        return sheet.strip("'").lstrip("=") if bang else next(iter(self.book.sheets)), area.replace("$", "")

    def fields(self, p: dict) -> dict[str, dict]:
        """Field name to its place, type and limits, of a scalar (one field "") or a record."""
        if p["shape"] == "scalar":
            return {"": {"location": p["location"], "type": p["schema"]["type"], "constraints": p.get("constraints", {})}}
        return {n: {"location": f["location"], "type": f["type"], "constraints": f.get("constraints", {})} for n, f in p["schema"]["fields"].items()}

    def table(self, p: dict) -> tuple[str, int, list[tuple[dict, int]], int]:
        """Sheet, header row, (column, its number), and the first row behind the table."""
        at, columns = p["location"]["layout"], p["schema"]["columns"]
        sheet, top = at["sheet"], int(at.get("header_row", 1))
        first = files.column_number(at.get("anchor_col", "A"))
        heads = {str(v).strip().lower(): j for (i, j), v in self.book.sheets.get(sheet, {}).items() if i == top}
        placed = [(c, files.column_number(c["col"]) if "col" in c else heads.get(c["name"].lower(), first + k)) for k, c in enumerate(columns)]
        last, row, get = self.book.bounds(sheet)[0], top + 1, self.book.sheets.get(sheet, {}).get
        how = at.get("terminate", "first_blank_row")
        while row <= last:
            cells = [get((row, j)) for _, j in placed]
            if how == "until_marker" and str(get((row, first))) == str(at.get("marker_text")):
                break
            if how == "first_blank_row" and all(v in (None, "") for v in cells):
                break
            row += 1
        return sheet, top, placed, row

    def write(self, inputs: dict) -> None:
        for name, value in inputs.items():
            p = self.ports.get(name)
            if p is None or p["dir"] != "in":
                raise PortError(f"no input {name!r}")
            if p["shape"] in ("scalar", "record"):
                for f, spec in self.fields(p).items():
                    v = checked(f"{name}.{f}" if f else name, value[f] if f else value, spec["type"], spec["constraints"])
                    sheet, area = self.address(spec["location"])
                    self.book.put((sheet, *split_cell(area)), stored(v))
            elif p["shape"] == "range":
                sheet, area = self.address(p["location"])
                kind = p["schema"].get("cell_type", p["schema"].get("type", "number"))
                self.book.write_range(sheet, area.partition(":")[0], [[stored(checked(name, v, kind, p.get("constraints", {}))) for v in r] for r in value])
            else:
                sheet, top, placed, end = self.table(p)
                marker = p["location"]["layout"].get("marker_text") if p["location"]["layout"].get("terminate") == "until_marker" else None
                rows = [[(j, stored(checked(f"{name}.{c['name']}", r.get(c["name"]), c["type"], c.get("constraints", {})))) for c, j in placed] for r in value]
                for i in range(top + 1, max(end, top + len(rows)) + 2):
                    for j in [j for _, j in placed]:
                        self.book.put((sheet, i, j), None)
                for i, r in enumerate(rows):
                    for j, v in r:
                        self.book.put((sheet, top + 1 + i, j), v)
                if marker is not None:
                    self.book.put((sheet, top + 1 + len(rows), placed[0][1]), marker)

    def read(self) -> dict:
        """Outputs by port: values, dicts, lists of rows, and for tables DataFrames."""
        out = {}
        for name, p in self.ports.items():
            if p["dir"] != "out":
                continue
            if p["shape"] in ("scalar", "record"):
                got = {}
                for f, spec in self.fields(p).items():
                    sheet, area = self.address(spec["location"])
                    got[f] = checked(f"{name}.{f}" if f else name, self.book.values.get((sheet, *split_cell(area))), spec["type"], spec["constraints"])
                out[name] = got[""] if p["shape"] == "scalar" else got
            elif p["shape"] == "range":
                sheet, area = self.address(p["location"])
                out[name] = self.book.read_range(sheet, area)
            else:
                sheet, top, placed, end = self.table(p)
                get = self.book.values.get
                rows = [(i, *[checked(f"{name}.{c['name']}", get((sheet, i, j)), c["type"], c.get("constraints", {})) for c, j in placed]) for i in range(top + 1, end)]
                out[name] = self.book.spark.createDataFrame(rows, "row_id long, " + ", ".join(f"`{c['name']}` {ports.TYPES[c['type']]}" for c, _ in placed))
        return out

    def evaluate_once(self, inputs: dict) -> dict:
        self.write(inputs)
        self.book.evaluate()
        return self.read()

    def batch(self, scenarios: DataFrame) -> DataFrame:
        """``scenarios`` (a column for each scalar input) with a column for each scalar output; errors are null."""
        book, live = self.book, {}
        df = scenarios
        for name, p in self.ports.items():
            if p["shape"] != "scalar":
                raise PortError(f"{name}: a batch takes scalar ports")
            if p["dir"] == "in":
                sheet, area = self.address(p["location"])
                at, kind = (sheet, *split_cell(area)), KINDS[p["schema"]["type"]]
                df = df.withColumn(f"__in_{name}", F.col(f"`{name}`").cast(kind))
                live[at] = Val(F.col(f"__in_{name}"), {"double": "n", "string": "t", "boolean": "b"}[kind])
                book.put(at, 0.0 if kind == "double" else "" if kind == "string" else False)
        book.evaluate()
        for layer in book.layers()[0]:
            cells = {}
            for at in layer:
                sheet = Scenario(book, at, df, live)
                if any(sheet.depends(a) for a in [book.formulas[at]]):
                    x = sheet.scalar(sheet.run(book.formulas[at]))
                    df = sheet.attach(df, x.v, x.err)
                    cells[at] = x
            for k, (at, x) in enumerate(cells.items()):
                c = "__" + "_".join(map(str, at)).replace("`", "")
                df = df.withColumn(c, shown(x)).withColumn(f"{c}_e", F.lit(None).cast("string") if x.err is None else x.err)
                live[at] = Val(F.col(f"`{c}`"), x.kind, F.col(f"`{c}_e`") if x.err is not None else None)
        out = []
        for name, p in self.ports.items():
            if p["dir"] == "out":
                sheet, area = self.address(p["location"])
                at = (sheet, *split_cell(area))
                x = live.get(at) or CellSheet(book, at).value(at)
                out.append(shown(x).cast(ports.TYPES[p["schema"]["type"]]).alias(name))
        return df.select(*[F.col(f"`{c}`") for c in scenarios.columns], *out)


class Scenario(CellSheet):
    """Cells that follow from a scenario's inputs are columns of its row."""

    def __init__(self, book: Book, at, df: DataFrame, live: dict):
        super().__init__(book, at, None, df)
        self.live = live

    def value(self, at):
        return self.live.get(at) or super().value(at)

    def do_cell(self, n):
        s, i, j, _, _ = self.book.area(self.at[0], n)
        return self.value((s, i, j))

    def depends(self, n):
        if n.op in ("cell", "range"):
            s, i, j, k, m = self.book.area(self.at[0], n)
            return any(a[0] == s and i <= a[1] <= k and j <= a[2] <= m for a in self.live)
        flat = [x for r in n.args for x in r] if n.op == "array" else n.args
        return any(self.depends(a) for a in flat)
