import duckdb
import pytest

import __spark_entry__ as entry
from lumenquery.plans import registry
from lumenquery.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def cell(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(str(cell(r[c])) for c in columns) for r in got.collect())
    rel = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(str(cell(r[names.index(c)])) for c in columns) for r in rel.fetchall())
    assert sorted(names) == columns and len(rows) == len(want)
    number = lambda x: float(x) if x.replace(".", "", 1).replace("-", "").replace("e", "").replace("+", "").isdigit() else None
    for a, b in zip(rows, want, strict=True):
        for x, y in zip(a, b, strict=True):
            u, v = number(x), number(y)
            assert x == y or (u is not None and v is not None and abs(u - v) <= 1e-4 * max(1, abs(u)))
