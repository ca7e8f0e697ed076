import json
import random
import zipfile

import pytest

from gridlake.parser import FormulaError, canonical, parse_all, tokens
from gridlake.plans import recalc
from gridlake.plans.workbook import Workbook
from gridlake.sources import files


def test_book(spark, tmp_path):
    cells = {(1, 1): "n", (1, 2): "twice", (1, 3): "sum so far"}
    for r in range(2, 42):
        cells |= {(r, 1): float(r), (r, 2): f"=A{r}*2", (r, 3): f"=SUM(B$2:B{r})"}
    cells |= {(1, 5): "=SUM(B:B)", (2, 5): "=VLOOKUP(7,A2:C41,2,FALSE)", (3, 5): "=E1/0", (4, 5): "=F4", (4, 6): "=E4", (5, 5): "=Other!A1&\"!\"", (6, 5): "=rate*10", (7, 5): "=COUNTIF(A2:A41,\">40\")", (8, 5): "=INDEX(A2:B41,3,2)", (9, 5): "={1,2;3,4}", (11, 5): "=SUM(A1:A1000)", (12, 5): "=IF(E3>0,1,2)", (13, 5): "=1+"}
    sheets = {"Main": cells, "Other": {(1, 1): "text"}}
    files.write_xlsx(str(tmp_path / "a.xlsx"), sheets)
    with zipfile.ZipFile(tmp_path / "a.xlsx", "a") as z:
        book = z.read("xl/workbook.xml").decode().replace("</sheets>", "</sheets><definedNames><definedName name=\"rate\">0.5</definedName></definedNames>")
    with zipfile.ZipFile(tmp_path / "a.xlsx") as old, zipfile.ZipFile(tmp_path / "b.xlsx", "w") as new:
        for name in set(old.namelist()):
            new.writestr(name, book if name == "xl/workbook.xml" else old.read(name))
    book = recalc.load(spark, str(tmp_path / "b.xlsx"))
    got = book.evaluate()
    v = book.values
    assert [v["Main", r, 2] for r in range(2, 42)] == [2.0 * r for r in range(2, 42)]
    assert v["Main", 41, 3] == sum(2.0 * r for r in range(2, 42)) == v["Main", 1, 5]
    assert [v["Main", r, 5] for r in (2, 3, 4, 5, 6, 7, 8)] == [14.0, "#DIV/0!", "#CIRC!", "text!", 5.0, 1.0, 8.0]
    assert book.read_range("Main", "E9:F10") == [[1.0, 2.0], [3.0, 4.0]]
    assert v["Main", 11, 5] == sum(range(2, 42)) and v["Main", 12, 5] == "#DIV/0!" and v["Main", 13, 5] == "#NAME?"
    assert got.errors == {"#DIV/0!": 2, "#CIRC!": 2} and got.where["Main"] == ["E3", "E4", "F4", "E12"]
    book.write_range("Main", "A2", [[100], [200]])
    book.clear_range("Main", "E3:F5")
    book.evaluate()
    assert v["Main", 3, 2] == 400.0 and ("Main", 3, 5) not in v
    with pytest.raises(ValueError):
        recalc.load(spark, str(tmp_path / "b.xlsx"), limits=recalc.Limits(rows=10))
    with pytest.raises(FormulaError):
        recalc.load(spark, str(tmp_path / "b.xlsx"), malformed="strict")


def test_recalculate_file(spark, tmp_path):
    doc = {"version": 1, "defined_names": [{"name": "X", "definition": {"type": "literal", "value": {"type": "Int", "value": 10}}}], "sheets": {"S": {"cells": [{"row": 1, "col": 1, "value": {"type": "Int", "value": 4}}, {"row": 1, "col": 2, "formula": "=A1*X"}, {"row": 1, "col": 3, "formula": "=B1&\"\""}]}}}
    (tmp_path / "in.json").write_text(json.dumps(doc))
    out = recalc.recalculate_file(spark, str(tmp_path / "in.json"), str(tmp_path / "out.xlsx"))
    assert out.formulas == 2 and not out.errors
    with zipfile.ZipFile(tmp_path / "out.xlsx") as z:
        xml = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<f>A1*X</f><v>40.0</v>" in xml and 't="str"><f>B1&amp;""</f><v>40</v>' in xml
    assert files.to_xlsx_bytes({"S": {(1, 1): 1.0}})[:2] == b"PK"


def test_parser_tools():
    assert [t[:2] for t in tokens('=A1+"x"')] == [("name", "A1"), ("op", "+"), ("text", '"x"')]
    assert any(k == "bad" for k, *_ in tokens("=1 + ~~ 2"))
    assert canonical("= 1 + sum( a1 , 2)") == canonical("=1+SUM(a1,2)")
    a, b, c = parse_all(["=1+2", "=1+", "=1+2"])
    assert a is c and isinstance(b, FormulaError)


def test_workbook_edits(spark):
    rng = random.Random(1)
    sales = spark.createDataFrame([(i, rng.choice("ab"), float(i)) for i in range(20)], "id int, k string, v double")
    book = Workbook(malformed="error")
    book.add_table("sales", sales)
    book.add_table("keys", spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string"))
    book.set_formula("keys", "total", "=SUMIFS(sales[v],sales[k],[k])")
    book.set_formula("keys", "bad", "=1+")
    want = {k: sum(r.v for r in sales.collect() if r.k == k) for k in "ab"}
    before = spark.createDataFrame(book.evaluate("keys", ["total"]).collect(), "id int, k string, total double")
    assert {r.k: r.total for r in before.collect()} == want
    book.rename_table("sales", "facts")
    book.insert_rows("facts", spark.createDataFrame([(99, "a", 1000.0)], "id int, k string, v double"))
    got = book.changes("keys", "id", before, ["total"]).collect()
    assert [(r.id, r.column) for r in got] == [(1, "total")] and float(got[0].new) - float(got[0].old) == 1000.0
    book.delete_rows("facts", "id", spark.createDataFrame([(99,)], "id int"))
    assert book.changes("keys", "id", before, ["total"]).count() == 0
    assert [r.c1 for r in book.spill("=SORT(UNIQUE(facts[k]),1,-1)").collect()] == ["b", "a"]
    book.add_table("x", spark.createDataFrame([(1, 10.0)], "id int, a double"))
    book.set_formula("x", "p", "=[q]/2+[a]")
    book.set_formula("x", "q", "=[p]/2")
    r = book.evaluate("x", iterations=60, tolerance=1e-9).first()
    assert abs(r.p - 40 / 3) < 1e-6 and abs(r.q - 20 / 3) < 1e-6
    assert book.evaluate("x", errors=True).first().p__error == "#CIRC!"


def test_custom_aggregate_and_transaction(spark):
    from pyspark.sql import functions as F

    from gridlake.relations import catalogue

    book = Workbook()
    book.add_table("t", spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 5.0)], "id int, a double"))
    book.register_aggregate("SPREAD", lambda c: F.max(c) - F.min(c))
    book.set_formula("t", "s", "=SPREAD(t[a])+[a]")
    with book.cancellable("g"):
        assert [r.s for r in book.evaluate("t").orderBy("id").collect()] == [5.0, 8.0, 8.0]
    with pytest.raises(KeyError), book.transaction():
        book.set_formula("t", "x", "=[a]*2")
        raise KeyError
    assert "x" not in book.formulas["t"]
    with book.transaction():
        book.set_formula("t", "x", "=[a]*2")
        book.set_formula("t", "y", "=[x]+1")
    assert [r.y for r in book.evaluate("t").orderBy("id").collect()] == [5.0, 11.0, 11.0]
    book.undo()
    assert set(book.formulas["t"]) == {"s"}
    known = catalogue()
    assert len(known) > 400 and known["RAND"]["volatile"] and known["SUM"]["reduction"] and known["SIN"]["plan"] == "expression"
