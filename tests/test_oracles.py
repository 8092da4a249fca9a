"""Every registered colocation query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from swathkit.plans import colocation

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(colocation.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = colocation.QUERIES[name](spark, str(DATA))
    want = duck.execute(colocation.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(colocation.QUERIES) == set(colocation.ORACLES)


@pytest.mark.parametrize("name", ["colocate_month", "footprint_midpoint_centre", "points_from_xml", "filename_time", "granule_files", "manifest_tree"])
def test_times_are_utc_in_any_session(spark, duck, name):
    """A zone whose days begin hours later, with a gap in spring."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_equals_its_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
