"""Every catalogue query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans.catalogue import QUERIES
from gridloom.plans.oracle import oracle_sql

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    plain = [tuple(x if x is None or isinstance(x, (bool, str)) else float(x) if hasattr(x, "__float__") else str(x) for x in r) for r in df.itertuples(index=False)]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
    else:
        assert len(got)


def test_interval_merge_odd_rows(spark, tmp_path):
    """Quantities with fractions, below zero and missing, keys below zero and missing: as in the SQL."""
    rows = [(1, 10, 2.5), (1, 14, 0.5), (1, 15, 1.5), (2, 10, 3.0), (2, 13, None), (2, 14, 2.0), (2, None, 3.0), (2, 30, 1.0), (3, None, None), (3, 4, 1.0), (4, 10, -5.0), (4, 7, 1.0), (5, None, 1.0), (5, None, 2.0), (None, 3, 1.0), (None, 5, 2.0)]
    rows += [(6, -5000, 1.0), (6, -2, 4.0), (6, 20, -30.0), (6, 25, 1.0), (7, 4, None), (7, 5, 1.0), (8, 1, None), (8, 1, 3.0), (8, 3, 2.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = duckdb.connect()
    want.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert _rows(QUERIES["interval_merge"](spark, str(tmp_path)).toPandas()) == _rows(want.sql(SQL["interval_merge"]).df())


def test_huffman_freq_large_and_odd_rows(spark, tmp_path):
    """Bytes are counted where they are, not one row for each; repeated and missing ids and texts as in the SQL."""
    rows = [(1, "aé€😀\n\0"), (1, "a"), (2, ""), (3, None), (None, "x"), (None, "xy"), ((1 << 62) + 1, "z"), (4, "word é " * 1_000_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.connect()
    want.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS DISTINCT FROM 4")
    out = QUERIES["huffman_freq"](spark, str(tmp_path))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r[0] is not None, *[x or 0 for x in r])
    got = sorted(map(tuple, out.collect()), key=key)
    small = [(4, b, 1_000_000 * b"word \xc3\xa9 ".count(b)) for b in sorted(set(b"word \xc3\xa9 "))]
    assert got == sorted([*want.sql(SQL["huffman_freq"]).fetchall(), *small], key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
