"""Name queries over part rows of their own, against the checking SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registry

PAIR = ("red ring", "red ring and brand 2")
SEEN = {
    "match_candidates": lambda r: r["block"] == "red ",
    "match_best": lambda r: r["company_a"] == "red ring Inc.",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    rows = [(1, "red ring", "Brand#1"), (25, "red ring", "Brand#2"), (25, "red rod", "Brand#1")]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string")
    parts.coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["match_candidates", "match_scored", "match_best", "match_parts", "match_jw"])
def test_names_of_different_lots_meet(spark, folder, name):
    ours = registry.queries()[name](spark, folder)
    rows = ours.collect()
    assert any(map(SEEN.get(name, lambda r: (r["norm_a"], r["norm_b"]) == PAIR), rows))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
        theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = [i for i, kind in enumerate(ours.dtypes) if kind[1] != "double"]
    assert sorted([r[i] for i in key] for r in rows) == sorted([r[i] for i in key] for r in theirs)
