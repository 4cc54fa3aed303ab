"""Every registered query against its checking SQL on the small tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer events lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield con
    con.close()


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=frame.index)
    for c in sorted(frame.columns):
        column = frame[c]
        if str(column.dtype).startswith("datetime"):
            out[c] = column.astype("datetime64[us]").astype(str)
        elif column.dtype == bool or pd.api.types.is_numeric_dtype(column.dtype):
            out[c] = column.astype(float)
        else:
            out[c] = [None if pd.isna(v) else str(v) for v in column]
    return out.sort_values(list(out.columns), na_position="last").reset_index(drop=True)


def test_every_query_has_a_statement():
    assert set(registry._QUERIES) <= set(registry.queries())
    assert set(registry._QUERIES) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry._QUERIES))
def test_query(spark, duck, name):
    _equal(spark, duck, name, FOLDER)


@pytest.mark.parametrize("name", ["event_net", "slope_class"])
def test_event_query_with_covered_events(spark, name):
    """The smallest tables have no event that passes the coverage gate; these have thousands."""
    folder = FOLDER.replace("sf0.001", "sf0.01")
    with duckdb.connect() as con:
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        assert _equal(spark, con, name, folder) > 1000


def _equal(spark, duck, name, folder):
    ours = _canonical(registry.queries()[name](spark, folder).toPandas())
    theirs = _canonical(duck.execute(registry.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        if a.dtype == float and b.dtype == float:
            np.testing.assert_allclose(a, b, atol=1.1e-6, rtol=0, err_msg=c)
        else:
            assert [None if pd.isna(v) else str(v) for v in a] == [
                None if pd.isna(v) else str(v) for v in b
            ], c
    return len(ours)


def test_entry_has_a_row_per_sensor_day(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == len({r["day"] for r in rows}) > 0
