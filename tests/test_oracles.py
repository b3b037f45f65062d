"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wavemill.plans import catalog, catalog_io, catalog_projects  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = sorted(f.removesuffix(".parquet") for f in os.listdir(SF)) if os.path.isdir(SF) else []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    text = lambda r: tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    got = sorted(text(r) for r in df.select(*columns).collect())
    rows = con.execute(entry.oracle_sql()[name])
    order = sorted(range(len(rows.description)), key=lambda i: rows.description[i][0])
    assert [rows.description[i][0] for i in order] == columns
    assert got == sorted(text([r[i] for i in order]) for r in rows.fetchall())


def test_entry_and_registers(spark):
    assert entry.entry(spark).count() >= 1
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
