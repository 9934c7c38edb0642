"""Every registered query with SQL against DuckDB on the smallest test data, and the contract's functions."""

import importlib
import os
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
MODULES = ("flows", "problems", "relational", "numeric", "extras")
REGISTRIES = [importlib.import_module(f"abundera.queries.{m}").R for m in MODULES]
WITH_SQL = [(r, n) for r in REGISTRIES for n in r.queries if n in r.sql]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    yield con
    con.close()


def shown(v):
    if isinstance(v, float) and v != v:
        return object()  # NaN equals nothing, as in the driver's comparison
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "%.9g" % (float(v) + 0.0)
    return str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(shown(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("registry, name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_query_equals_sql(spark, duck, registry, name):
    df = registry.queries[name](spark, str(DATA))
    got = table([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(registry.sql[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == table(cur.fetchall(), columns)


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"p1_found", "p4_found", "p6_found", "p7_found"} <= set(names)
    assert entry.entry(spark).columns == ["protein", "sample", "value"]
