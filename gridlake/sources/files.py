"""CSV through Spark; JSON and XLSX workbooks, which are bounded by the format, on the driver."""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..values import ERRORS

MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, infer: bool = True, trim: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Columns become numbers or booleans where every non-empty cell is one; else they stay text."""
    df = spark.read.option("sep", delimiter).option("header", header).option("encoding", encoding).option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).csv(path)
    if not infer or not df.columns:
        return df
    q = [f"`{c}`" for c in df.columns]
    bad = df.agg(*[F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(q)], *[F.count(F.when(F.col(c).isNotNull() & ~F.lower(c).isin("true", "false"), 1)).alias(f"b{i}") for i, c in enumerate(q)], *[F.count(c).alias(f"c{i}") for i, c in enumerate(q)]).first()
    out = {}
    for i, name in enumerate(df.columns):
        kind = "string" if not bad[f"c{i}"] else "double" if not bad[f"n{i}"] else "boolean" if not bad[f"b{i}"] else "string"
        out[name] = F.col(q[i]).cast(kind)
    return df.withColumns(out)


def write_csv(df: DataFrame, path: str, order: list[str] = (), quote_all: bool = False, delimiter: str = ",") -> None:
    (df.orderBy(*order) if order else df).write.option("header", True).option("sep", delimiter).option("quoteAll", quote_all).mode("overwrite").csv(path)


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def read_json(path: str) -> dict[str, dict[tuple[int, int], object]]:
    """Cells by sheet of a versioned JSON workbook; a formula cell is its text with =."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    out = {}
    for name, sheet in doc.get("sheets", {}).items():
        out[name] = {(c["row"], c["col"]): ("=" + c["formula"].lstrip("=")) if c.get("formula") else (c.get("value") or {}).get("value") for c in sheet.get("cells", [])}
    return out


def write_json(path: str, sheets: dict[str, dict[tuple[int, int], object]]) -> None:
    def cell(at, v):
        if isinstance(v, str) and v.startswith("="):
            return {"row": at[0], "col": at[1], "formula": v}
        kind = "Boolean" if isinstance(v, bool) else "Int" if isinstance(v, int) else "Number" if isinstance(v, float) else "Text"
        return {"row": at[0], "col": at[1], "value": {"type": kind, "value": v}}

    doc = {"version": 1, "sheets": {n: {"cells": [cell(at, v) for at, v in sorted(c.items()) if v is not None]} for n, c in sheets.items()}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f)


def read_xlsx(path) -> dict[str, dict[tuple[int, int], object]]:
    """Cells by sheet: numbers, texts, booleans, and formulas as text with =."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS):
            target = rels[s.get(REL)].lstrip("/")
            cells = out[s.get("name")] = {}
            for c in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{NS['m']}}}c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r"))
                f, v, kind = c.find("m:f", NS), c.find("m:v", NS), c.get("t", "n")
                value = None if v is None else v.text
                if f is not None and f.text:
                    value = "=" + f.text
                elif kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
                elif kind == "b":
                    value = value == "1"
                elif kind == "n" and value is not None:
                    value = float(value)
                elif kind == "d" and value is not None:  # an ISO date
                    value = float((dt.datetime.fromisoformat(value) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1))
                cells[int(m[2]), column_number(m[1])] = value
    return out


def defined_names(path: str) -> dict[str, str]:
    """The workbook's defined names with their formulas."""
    with zipfile.ZipFile(path) as z:
        found = ET.fromstring(z.read("xl/workbook.xml")).find("m:definedNames", NS)
    return {} if found is None else {n.get("name"): n.text or "" for n in found}


def to_xlsx_bytes(sheets: dict[str, dict[tuple[int, int], object]], values: dict | None = None) -> bytes:
    out = io.BytesIO()
    write_xlsx(out, sheets, values)
    return out.getvalue()


def write_xlsx(path, sheets: dict[str, dict[tuple[int, int], object]], values: dict | None = None) -> None:
    """``path``: a name or a binary file. ``values``: what the formulas gave, kept beside them."""

    def result(name: str, at: tuple[int, int]) -> tuple[str, str]:
        v = (values or {}).get(name, {}).get(at)
        if v is None:
            return "", ""
        if isinstance(v, bool):
            return ' t="b"', f"<v>{int(v)}</v>"
        if isinstance(v, str):
            return (' t="e"' if v in ERRORS else ' t="str"'), f"<v>{escape(v)}</v>"
        return "", f"<v>{v!r}</v>"

    def sheet(name, cells) -> str:
        rows: dict[int, list] = {}
        for (i, j), v in sorted(cells.items()):
            if i > MAX_ROWS or j > MAX_COLUMNS:
                raise ValueError("beyond a worksheet's size")
            at = f"{column_letters(j)}{i}"
            if v is None:
                continue
            if isinstance(v, bool):
                x = f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
            elif isinstance(v, (int, float)):
                x = f'<c r="{at}"><v>{v!r}</v></c>'
            elif str(v).startswith("="):
                kind, got = result(name, (i, j))
                x = f'<c r="{at}"{kind}><f>{escape(str(v)[1:])}</f>{got}</c>'
            else:
                x = f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
            rows.setdefault(i, []).append(x)
        body = "".join(f'<row r="{i}">{"".join(c)}</row>' for i, c in rows.items())
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS["m"]}"><sheetData>{body}</sheetData></worksheet>'

    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS["m"]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, (name, cells) in zip(n, sheets.items()):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(name, cells))


def cells_to_frame(spark: SparkSession, cells: dict[tuple[int, int], object], header: bool = True) -> DataFrame:
    """A sheet's block of values as a table with row_id; columns with one kind of value keep it."""
    if not cells:
        return spark.createDataFrame([], "row_id long")
    width, first = max(j for _, j in cells), min(i for i, _ in cells)
    names = [str(cells.get((first, j)) or column_letters(j)) if header else column_letters(j) for j in range(1, width + 1)]
    rows = sorted({i for i, _ in cells if i >= first + header})
    kinds = []
    for j in range(1, width + 1):
        got = {bool if isinstance(v, bool) else float if isinstance(v, (int, float)) else str for i in rows if (v := cells.get((i, j))) is not None}
        kinds.append({frozenset([float]): "double", frozenset([bool]): "boolean"}.get(frozenset(got), "string"))
    cast = {"double": float, "boolean": bool, "string": str}
    data = [(i, *[None if (v := cells.get((i, j + 1))) is None else cast[k](v) for j, k in enumerate(kinds)]) for i in rows]
    return spark.createDataFrame(data, "row_id long, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
