"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")
def test_against_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    wrong = []
    queries = entry.queries()
    for name, sql in entry.oracle_sql().items():
        got = queries[name](spark, FOLDER)
        want = con.execute(sql).fetchdf().astype(object)
        want = want.where(want.notna(), None)
        if rows(got.columns, [tuple(r) for r in got.toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist()]) != rows(list(want.columns), want.values.tolist()):
            wrong.append(name)
    assert not wrong


def test_bases_of_large_keys(spark, tmp_path):
    """Keys beyond ROMAN's 3999 and beyond six digits to the base of 7."""
    keys = ", ".join(f"({k})" for k in (0, 3998, 3999, 4000, 117647, 117648, 9_999_999))
    con = duckdb.connect()
    con.execute(f"create table part as select k::BIGINT AS p_partkey, (k % 50 + 1)::INT AS p_size, 900 + k / 7 AS p_retailprice, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type from (values {keys}) v(k)")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    got = entry.queries()["fn_bases"](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()["fn_bases"])
    names = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_bounds_of_orders_without_keys(spark, tmp_path):
    """The nearest price may be that of an order whose key is null; the next one that has a key counts."""
    con = duckdb.connect()
    con.execute("create table part as select * from (values (1::BIGINT, 10::DOUBLE), (2, 20), (3, NULL), (4, 0), (NULL, 10)) v(p_partkey, p_retailprice)")
    con.execute("create table orders as select * from (values (1::BIGINT, 900::DOUBLE), (NULL, 1000), (3, 1500), (NULL, 1900), (5, 2001), (6, NULL)) v(o_orderkey, o_totalprice)")
    for t in ("part", "orders"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = entry.queries()["lookup_many_bounds"](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()["lookup_many_bounds"])
    names = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
