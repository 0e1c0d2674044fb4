"""Every registered query against its SQL in another engine, on the smallest tables."""

import math
from pathlib import Path

import pytest

from quadrille import plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0 if math.isfinite(v) else str(v)
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, expected = rows(plans.queries()[name](spark, str(DATA)).toPandas()), rows(duck.execute(plans.oracle_sql()[name]).df())
    assert got[0] == expected[0]
    assert got[1] == expected[1]
    assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert set(plans.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert "region_quality_report" in __spark_entry__.queries()
