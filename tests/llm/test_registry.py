"""Registered queries of the text operators against their SQL on the small tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from hygroflow.llm import registry

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted({int(q[2:].split("_")[0]) for q in names}) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as con:
        for table in ("documents", "pages", "benchmark", "labels", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        theirs = con.execute(registry.ORACLE_SQL[name]).df()
    ours = registry.QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [sorted(map(_plain, df[columns].itertuples(index=False)), key=str) for df in (ours, theirs)]
    assert rows[0] == rows[1]


def _plain(row) -> tuple:
    """Missing values as None and whole numbers as such, whatever pandas made of a column with nulls."""
    return tuple(None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in row)
