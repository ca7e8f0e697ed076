import os

import pytest
from pyspark.sql import functions as F

from gridlake.compiler import add_column, compile_formula
from gridlake.operators import arrays, lookups
from gridlake.parser import FormulaError, parse, pretty
from gridlake.plans import ports
from gridlake.plans.workbook import Workbook, scenarios
from gridlake.sources import files
from gridlake.values import shown

HERE = os.path.dirname(__file__)


def vectors():
    with open(f"{HERE}/vectors.tsv", encoding="utf-8") as f:
        return [x.rstrip("\n").split("\t") for x in f if x.strip() and not x.startswith("#")]


def test_vectors(spark):
    rows = vectors()
    wrong = []
    for lo in range(0, len(rows), 15):
        part = rows[lo : lo + 15]
        vals = [compile_formula(f, {}) for f, _ in part]
        cols = [F.coalesce(v.err if v.err is not None else F.lit(None).cast("string"), shown(v).cast("string")).alias(f"c{i}") for i, v in enumerate(vals)]
        for (f, want), got in zip(part, spark.range(1).select(*cols).first()):
            try:
                ok = abs(float(got) - float(want)) <= 2e-6 * max(1, abs(float(want)))
            except (TypeError, ValueError):
                ok = str(got).upper() == want.upper()
            if not ok:
                wrong.append((f, got, want))
    assert not wrong


@pytest.mark.parametrize("text", ["=1+2*3", '=IF(A1>0,"x",SUM(B1:B3))', "={1,2;3,4}", "=-T[@c]%", "='My sheet'!A1&\"\"\"\""])
def test_pretty_is_stable(text):
    once = pretty(parse(text))
    assert pretty(parse(once)) == once


def test_bad_formula():
    with pytest.raises(FormulaError):
        parse("=1+")


def test_errors_travel(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, 6.0, 3.0)], "id int, a double, b double")
    out = add_column(df, "q", "=IF([b]=0,NA(),[a]/[b])", errors=True).orderBy("id").collect()
    assert [(r.q, r.q__error) for r in out] == [(None, "#N/A"), (2.0, None)]


def test_lookup_edges(spark):
    left = spark.createDataFrame([("A",), ("z",), (None,)], "k string")
    table = spark.createDataFrame([("a", 2, 1), ("A", 1, 2), (None, 9, 3)], "k2 string, v int, row_id int")
    got = {r.k: r.x for r in lookups.xlookup(left, "k", table, "k2", "v", "x", "row_id", missing=-1).collect()}
    assert got == {"A": 2, "z": -1, None: -1}
    got = {r.k: r.x for r in lookups.xlookup(left, "k", table, "k2", "v", "x", "row_id", last=True).collect()}
    assert got == {"A": 1, "z": None, None: None}


def test_order_statistics(spark, monkeypatch):
    from gridlake.operators import aggregates, ordered, windows

    monkeypatch.setattr(ordered, "SMALL", 20)
    values = [((k * 37) % 500) / 4 if k % 3 else 7.0 for k in range(2000)] + [None] * 10
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").repartition(4)
    have = sorted(v for v in values if v is not None)
    n, at = ordered.at_ranks(df, "v", lambda n: [0, 5, 999, n - 1, n])
    assert n == 2000 and at == {k: have[k] for k in (0, 5, 999, 1999)}
    kept = have[100:-100]
    assert abs(aggregates.trimmed_mean(df, "v", 0.1, "m").first().m - sum(kept) / len(kept)) < 1e-9
    ranks = {r.id: r.p for r in windows.rank(df, "v", "p", ascending=True).collect()}
    assert all(ranks[i] == (None if v is None else 1 + sum(h < v for h in have)) for i, v in list(enumerate(values))[::50])
    total, run = {}, {}
    for r in windows.running_total(df.withColumn("g", F.col("id") % 2), "v", ["g"], ["id"], "t").orderBy("id").collect():
        total[r.g] = total.get(r.g, 0.0) + (r.v or 0.0)
        run[r.id] = abs(r.t - total[r.g])
    assert max(run.values()) < 1e-6 and len(run) == len(values)
    empty = df.where("id < 0")
    assert ordered.percentiles(empty, "v", {"p": 0.5}).first().p is None and windows.rank(empty, "v", "p").count() == 0


def test_lookup_by_ranges(spark):
    bands = spark.createDataFrame([(float(k * k), f"b{k}") for k in range(60)] + [(None, "x")], "lo double, name string").repartition(3)
    keys = spark.createDataFrame([(float(k),) for k in range(-5, 4000, 7)] + [(None,), (16.0,), (16.0,)], "k double")
    low = lambda k: None if k is None or k < 0 else f"b{max(j for j in range(60) if j * j <= k)}"
    high = lambda k: None if k is None or k > 59 * 59 else f"b{min(j for j in range(60) if j * j >= k)}"
    for got, want in ((lookups.lookup_asof(keys, "k", bands, "lo", "name", "x"), low), (lookups.lookup_next(keys, "k", bands, "lo", "name", "x"), high)):
        rows = got.collect()
        assert len(rows) == keys.count() and all(r.x == want(r.k) for r in rows)


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r.row_id == r.v + 1 for r in arrays.numbered(df, "v").collect())


def test_workbook(spark):
    book = Workbook()
    book.add_table("t", spark.createDataFrame([(1, 2.0), (2, 5.0)], "id int, a double"))
    book.set_formula("t", "c", "=[b]+1")
    book.set_formula("t", "b", "=[a]*2")
    assert [r.c for r in book.evaluate("t").orderBy("id").collect()] == [5.0, 11.0]
    book.edit("t", "id", spark.createDataFrame([(2, 10.0)], "id int, a double"))
    assert [r.c for r in book.evaluate("t", ["c"]).orderBy("id").collect()] == [5.0, 21.0]
    book.undo()
    assert [r.c for r in book.evaluate("t").orderBy("id").collect()] == [5.0, 11.0]
    book.set_formula("t", "b", "=[c]")
    assert book.layers("t") == ([], {"b", "c"})


def test_scenarios_and_ports(spark):
    rows = spark.createDataFrame([(1, 100.0), (2, -1.0)], "id int, price double")
    assert [r.net for r in scenarios(rows, {"net": "=[price]*0.8"}).orderBy("id").collect()] == [80.0, -0.8]
    bad = ports.violations(rows, [ports.Port("price", "number", least=0)], "id").collect()
    assert [(r.id, r.column, r.problem) for r in bad] == [(2, "price", "min")]


def test_files(spark, tmp_path):
    cells = {"S": {(1, 1): "name", (1, 2): "n", (2, 1): "x<&>", (2, 2): 1.5, (3, 1): "=A2", (3, 2): 2.0}}
    for read, write, name in ((files.read_xlsx, files.write_xlsx, "a.xlsx"), (files.read_json, files.write_json, "a.json")):
        write(str(tmp_path / name), cells)
        assert read(str(tmp_path / name)) == cells
    df = files.cells_to_frame(spark, cells["S"])
    assert df.columns == ["row_id", "name", "n"] and [r.n for r in df.orderBy("row_id").collect()] == [1.5, 2.0]
    files.write_csv(df, str(tmp_path / "c"), ["row_id"])
    assert dict(files.read_csv(spark, str(tmp_path / "c")).dtypes) == {"row_id": "double", "name": "string", "n": "double"}
