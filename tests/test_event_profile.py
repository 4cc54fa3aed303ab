"""The event profile reads its logs while it is planned, not again for each of its figures."""

from __future__ import annotations

import __spark_entry__ as registry


def test_event_profile_rests_on_stored_traces(spark, tmp_path):
    events = spark.range(40).selectExpr(
        "id AS event_id",
        "timestamp_ntz'2024-01-08 00:00:00' + make_dt_interval(0, 0, 6 * cast(id AS int)) AS ts",
        "id AS user_id",
        "'view' AS event_type",
        "30.0D + id AS value",
        "'' AS props",
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = registry.queries()["event_profile"](spark, str(tmp_path))
    assert "events.parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert {"signal", "side", "off", "median", "std", "n_events"} == set(found.columns)
