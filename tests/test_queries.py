import math
from pathlib import Path

import pytest

from eigenweave import queries as Q

SF = "/root/testdata/sf0.01"


def rows(table, columns):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in r) for r in table[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    if name not in Q.ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.sql(Q.ORACLE_SQL[name]).df().astype(object)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got.toPandas().astype(object), columns) == rows(want, columns)
    spark.catalog.clearCache()


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if Path("/root/testdata/sf0.001").is_dir():
        assert entry.entry(spark).count() > 0
