"""Operators on small tables with known answers or brute force."""

from __future__ import annotations

import math
import random
import statistics
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hygroflow.functions.similarity import jaro_winkler, token_set_ratio
from hygroflow.operators import events as ev
from hygroflow.operators import linkage as lk
from hygroflow.operators import moments
from hygroflow.operators import series as sr
from hygroflow.operators.quantiles import grouped_median, grouped_quantiles
from hygroflow.plans import operations as op
from hygroflow.plans import pump_study as ps
from hygroflow.plans import slopes as sl
from hygroflow.session import stored
from hygroflow.settings import MATCH_WEIGHTS, Clock, MatchRule
from hygroflow.sources import files, snapshot
from hygroflow.streaming import incremental as inc

DAY = 1440
T0 = 28_400_000 - 28_400_000 % DAY  # minute number of a midnight


# -- quantiles -------------------------------------------------------------------
def test_quantiles_equal_the_sorted_list(spark):
    rng = random.Random(3)
    rows = []
    for key in range(6):
        for _ in range(rng.choice([1, 2, 7, 400])):
            v = rng.choice([0.0, -1.0, 1.0, 2.0, rng.gauss(0, 1), rng.uniform(-1e6, 1e6), 1e-300])
            rows.append((key, v, rng.randint(1, 3)))
    rows.append((7, None, 1))
    df = spark.createDataFrame(rows, "k int, v double, w int")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", {"q": 0.25, "m": 0.5}, "w").collect()}
    plain = {r["k"]: r["m"] for r in grouped_median(df, ["k"], "v", "m").collect()}
    assert set(got) == set(range(6))
    for key in range(6):
        flat = sorted(v for k, v, w in rows if k == key for _ in range(w))
        assert got[key]["m"] == pytest.approx(statistics.median(flat), rel=1e-12, abs=1e-300)
        assert got[key]["q"] == pytest.approx(pd.Series(flat).quantile(0.25), rel=1e-9, abs=1e-300)
        assert plain[key] == pytest.approx(statistics.median([v for k, v, _ in rows if k == key]))


def test_one_group_with_most_rows(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), (F.col("id") * 0.5).alias("v")
    )
    got = grouped_median(df, ["k"], "v", "m").where("k = 1").first()["m"]
    # ids 0, 3, .. and id 1 itself
    assert got == statistics.median([i * 0.5 for i in range(60_000) if i % 3 == 0 or i == 1])


# -- series ------------------------------------------------------------------------
def _series(spark, minutes_values, sensor="101"):
    return spark.createDataFrame(
        [(sensor, m, float(v)) for m, v in minutes_values], "sensor_id string, minute bigint, val double"
    )


@pytest.mark.parametrize("start", [0, DAY - 4])  # inside a day and across midnight
def test_gap_fill_takes_the_first_five_minutes(spark, start):
    df = _series(spark, [(T0 + start, 1), (T0 + start + 8, 9)])
    got = {r["minute"] - T0 - start: r["val"] for r in sr.gap_fill(df).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0, 4: 5.0, 5: 6.0, 8: 9.0}


@pytest.mark.parametrize("gap", [1, 2, 6, 7, 8, 3 * DAY])
def test_gap_sizes(spark, gap):
    got = sr.gap_fill(_series(spark, [(T0, 0), (T0 + gap, gap)])).collect()
    assert len(got) == 2 + min(5, gap - 1)
    assert all(r["val"] == pytest.approx(r["minute"] - T0) for r in got)


def test_nearest_tick_ties_and_empty_days(spark):
    ticks = spark.createDataFrame(
        [("s", T0), ("s", T0 + 1), ("s", T0 + 2), ("s", T0 + 5 * DAY)], "series string, minute bigint"
    )
    points = [
        (2 * (T0 + 1), True, T0 + 1),  # exactly on a tick
        (2 * (T0 + 1) + 1, True, T0 + 2),  # exactly between two: the later one
        (2 * (T0 + 1), False, T0 + 1),  # before the half minute
        (2 * (T0 + 1) + 1, False, T0 + 2),
        (2 * (T0 - 10), False, T0),  # before all ticks
        (2 * (T0 + 2 * DAY), True, T0 + 2),  # days without ticks
        (2 * (T0 + 4 * DAY), True, T0 + 5 * DAY),
        (2 * (T0 + 9 * DAY), False, T0 + 5 * DAY),  # after all ticks
    ]
    df = spark.createDataFrame([("s", h, o) for h, o, _ in points], "series string, half bigint, on_tick boolean")
    got = {(r["half"], r["on_tick"]): r["tick"] for r in sr.nearest_tick(ticks, df).collect()}
    assert got == {(h, o): t for h, o, t in points}


def _wide(spark, minutes):
    return spark.createDataFrame(
        [(T0 + m, 50.0 + m, 40.0, 20.0, 15.0) for m in minutes],
        "minute bigint, rh_in double, rh_out double, temp_in double, temp_out double",
    ).withColumn("ah_in", F.col("rh_in") / 10).withColumn("ah_out", F.col("rh_out") / 10)


def test_event_on_a_minute_is_in_both_segments(spark):
    wide = _wide(spark, range(0, 120))
    points = spark.createDataFrame(
        [(2 * (T0 + 30), True), (2 * (T0 + 30), False), (2 * (T0 + 60) + 1, True)], "half bigint, on_tick boolean"
    )
    got = {(r["half"] - 2 * T0, r["on_tick"]): r for r in ev.window_stats(points, wide).collect()}
    exact, loose, half = got[(60, True)], got[(60, False)], got[(121, True)]
    assert (exact["ah_n_pre"], exact["ah_n_post"]) == (21, 31) == (exact["rh_n_pre"], exact["rh_n_post"])
    assert (loose["ah_n_pre"], loose["ah_n_post"]) == (20, 30) == (half["ah_n_pre"], half["ah_n_post"])
    # the inside rises by one per minute, so nothing remains above its own trend
    assert exact["rh_net_2a"] == pytest.approx(0.0, abs=1e-9)
    assert exact["rh_net_2b"] == pytest.approx(30 - 0.33 * 30)


def test_dense_and_sparse_signals(spark):
    present = [m for m in range(0, 120) if m not in (40, 41, 42, 43, 44, 45, 46)]
    points = spark.createDataFrame([(2 * (T0 + 50), True)], "half bigint, on_tick boolean")
    row = ev.window_stats(points, _wide(spark, present)).first()
    assert (row["rh_n_pre"], row["ah_n_pre"]) == (21, 14)
    assert row["rh_net_2b"] is None  # an empty minute makes the dense slope missing
    # positions close the gap: 10 minutes, then 4 more with a jump of 8 between
    ys = [5.0 + m / 10 for m in range(30, 51) if m in present]
    xs = list(range(len(ys)))
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    assert row["ah_slope_in"] == pytest.approx(slope)
    assert row["ah_covered"] and row["rh_covered"]


def test_events_sharing_a_minute_share_a_window(spark):
    rows = [("2024-01-05 10:00:%02d" % s, str(x), str(x % 4), "1") for s in range(0, 60, 7) for x in range(50)]
    measure = spark.createDataFrame(rows + rows, "start_time string, execution_time string, state string, actuator_id string")
    events = ev.distinct_events(measure, "2024-01-01", ps.IDENTITY)
    assert events.count() == len(rows)
    assert ev.anchors(events).count() == 3  # exact, first half, second half


# -- operations ---------------------------------------------------------------------
def _measure(spark, rows):
    return spark.createDataFrame(
        [(t, "5", s, "1") for t, s in rows], "start_time string, execution_time string, state string, actuator_id string"
    )


def test_net_windows(spark):
    rows = [("2024-01-05 10:01:00", "2"), ("2024-01-05 10:11:00", "2"), ("2024-01-05 10:12:00", "1"), ("2024-01-05 10:21:00", "0")]
    attempts = op.attempts(_measure(spark, rows), Clock("2024-01-01", 0))
    got = {r["day"]: (r["need"], r["succ"], r["failed"], r["rate_pct"]) for r in op.net_success(attempts).collect()}
    assert got == {"2024-01-05": (2, 1, 1, 50.0), "total": (2, 1, 1, 50.0)}


def test_calendar_has_no_holes(spark):
    rows = [("2024-01-05 10:00:00", "1"), ("2024-01-08 10:00:00", "0"), ("2024-01-08 10:00:00", "3")]
    daily = op.attempts_by_state(op.attempts(_measure(spark, rows), Clock("2024-01-01", 0)))
    got = {r["day"]: (r["s0"], r["s1"], r["s2"], r["s3"], r["total"]) for r in daily.collect()}
    assert got == {
        "2024-01-05": (0, 1, 0, 0, 1), "2024-01-06": (0,) * 5, "2024-01-07": (0,) * 5, "2024-01-08": (1, 0, 0, 1, 2),
    }
    rates = {r["day"]: r["rate_pct"] for r in op.raw_success(daily).collect()}
    assert rates["2024-01-06"] is None and rates["total"] == 33.3


def test_floor_compares_stored_text(spark):
    rows = [("2024-01-05 02:00:00", "1"), ("2024-01-04 23:59:59", "1")]
    days = op.attempts(_measure(spark, rows), Clock("2024-01-05", 5)).select("day").collect()
    assert [r["day"] for r in days] == ["2024-01-04"]  # kept by the stored day, shown on the local one


# -- loading ---------------------------------------------------------------------------
def test_sync_twice(spark):
    calendar = spark.createDataFrame(
        [(1, "2024-01-01 10:00:00", 30, 1), (2, "2024-01-01 11:00:00", 30, 0)],
        "execution_id bigint, start_time string, execution_time bigint, executed bigint",
    )
    schedule = spark.createDataFrame([(1, 45), (2, 60)], "schedule_id bigint, execution_time bigint")
    data = spark.createDataFrame([(1, "2024-01-02 10:00:00"), (2, None)], "schedule_id bigint, last_execution string")
    empty = spark.createDataFrame([], "_source string, start_time timestamp_ntz, runtime bigint")
    first = inc.sync_executions(calendar, data, schedule, empty)
    assert first.count() == 3
    again = inc.sync_executions(calendar, data, schedule, first).collect()
    assert [(r["_source"], r["start_time"], r["runtime"]) for r in again] == [("schedule", None, 60)]
    ids = [r["execution_id"] for r in inc.with_identifier(first).collect()]
    assert len(set(ids)) == 3


def test_copies_stay_and_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(inc, "COPIES_PER_ROW", 3)
    rows = spark.createDataFrame([("a", 1)] * 7 + [("b", 1)] * 2 + [(None, 1)] * 4, "k string, n int")
    known = spark.createDataFrame([("b", 1), ("b", 1), (None, 1)], "k string, n int")
    got = sorted(str(r["k"]) for r in inc.absent(rows, known, ["k", "n"]).collect())
    assert got == ["None"] * 4 + ["a"] * 7
    keyed = inc.absent(rows.withColumn("x", F.lit(1)), known, ["k", "n"]).collect()
    assert sorted(str(r["k"]) for r in keyed) == got


def test_payload_axis_is_left_closed(spark):
    payload = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 00:00:00' AS start, timestamp_ntz'2024-01-01 03:00:00' AS end, 3600 AS step_s,"
        " array(1D, 2D, 3D) temperature_2m, array(1D, null, 3D) relative_humidity_2m, array(0D, 0D, 0D) rain,"
        " array(1D, 1D, 1D) surface_pressure, array(1D, 1D, 1D) wind_speed_10m"
    )
    rows = inc.explode_payload(payload).orderBy("datetime").collect()
    assert [r["datetime"].hour for r in rows] == [0, 1, 2]
    assert [r["relative_humidity_2m"] for r in rows] == [1.0, None, 3.0]
    assert inc.weather_new_rows(payload, inc.explode_payload(payload)).count() == 0


def test_snapshot_keeps_null_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    text = snapshot.stringify(df)
    assert [f.dataType.simpleString() for f in text.schema] == ["string", "string"]
    assert sorted(tuple(r) for r in text.collect()) == [("1", None), ("2", "x")]


def test_snapshot_is_read_back(spark):
    df = spark.createDataFrame([(1, None), (22, "xyz")], "a int, b string")
    assert [tuple(r) for r in snapshot.snapshot_counts({"t": df}).collect()] == [("t", 2, 3, 6)]


def test_csv_with_quotes_breaks_and_empty_texts(spark, tmp_path):
    texts = ['He said "hi", ok', "two\nlines", "", None, 'back\\slash "', " x "]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "name string, n int")
    back = files.csv_roundtrip(df).orderBy("n").collect()
    assert [r["name"] for r in back] == texts
    (tmp_path / "foreign.csv").write_text('name,n\n"He said ""hi"", ok",1\n"two\nlines",2\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "foreign.csv")).collect()] == [
        ('He said "hi", ok', 1), ("two\nlines", 2)]


def test_events_with_missing_parts_stay_apart(spark):
    wide = spark.createDataFrame([(m, 50.0 + m, 40.0, 1.0, 1.0) for m in range(100)], "minute long, rh_in double, rh_out double, ah_in double, ah_out double")
    ts = datetime(1970, 1, 1, 0, 30)
    rows = [("x", None, "y", ts, 60), ("x", "y", None, ts, 60), (None, "x", "y", ts, 60)]
    events = spark.createDataFrame(rows, "start_time string, execution_time string, state string, ts timestamp_ntz, half long")
    got = sl.slope_features(events, wide).collect()
    assert len({r["id_evento"] for r in got}) == len(got) == 3
    assert all(r["slope_internal_pre"] == pytest.approx(1.0) and r["slope_external_post"] == pytest.approx(0.0) for r in got)
    assert sl.event_relative_metrics(events, wide).count() == 3 * 51


def test_profile_of_far_values_keeps_its_deviation(spark):
    rows = [("RH", "in", 0, 1e9 + v, n) for v, n in ((0.0, 1), (1.0, 2), (2.0, 1))]
    traces = spark.createDataFrame(rows, "signal string, side string, off int, val double, n long")
    row = ev.event_profile(traces).first()
    assert row["n_events"] == 4 and row["std"] == pytest.approx(math.sqrt(0.5))


def test_unreadable_times_drop_out(spark):
    rows = [("2024-01-05 10:00:00", "1", "1", "1"), ("bad text", "1", "1", "1")]
    df = spark.createDataFrame(rows, "start_time string, execution_time string, state string, actuator_id string")
    clock_ = Clock("2024-01-01", 0)
    assert [r["day"] for r in op.attempts_by_state(op.attempts(df, clock_)).collect()] == ["2024-01-05"]
    assert {r["day"]: r["attempts"] for r in op.raw_success(op.attempts_by_state(op.attempts(df, clock_))).collect()} == {"2024-01-05": 1, "total": 1}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1), (None, 2)], "`name of it` string, n int")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.first_column(back).columns == ["company"]
    files.write_chart(df, str(tmp_path / "j"))
    lines = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert '"name of it":null' in lines


# -- study ------------------------------------------------------------------------------
def test_histogram_sums_to_events(spark):
    schema = "slot_no int, rh_score int, ah_score int, rh_net_2a double, rh_net_2b double, ah_net_2a double, ah_net_2b double"
    net = spark.createDataFrame([(1, 0, 7, *[1.0] * 4), (2, 0, 3, *[2.0] * 4), (4, 7, 3, *[None] * 4)], schema)
    state = ps.study_state(net)
    assert state.count() == 6
    rows = ps.score_histogram(state).collect()
    assert len(rows) == 16
    for signal in ("RH", "AH"):
        assert sum(r["n_events"] for r in rows if r["signal"] == signal) == 3


def test_states_merge_like_one_group(spark):
    rng = random.Random(11)
    far = [(k, 1e9 + rng.random(), rng.randint(1, 4)) for k in range(6) for _ in range(rng.choice((1, 2, 50)))] + [(9, None, 1)]
    df = spark.createDataFrame(far, "k int, v double, w long")
    states = df.groupBy("k", "w").agg(moments.state(F.col("v")).alias("s"))
    one = states.agg(moments.merged(moments.weighted(F.col("s"), F.col("w"))).alias("m")).first()["m"]
    flat = [v for _, v, w in far if v is not None for _ in range(w)]
    assert one["n"] == len(flat) and one["mean"] == pytest.approx(statistics.mean(flat), rel=1e-15)
    assert one["m2"] == pytest.approx(statistics.pvariance(flat) * len(flat), rel=1e-5)
    got = df.where("k = 9").agg(moments.state(F.col("v")).alias("s")).select(moments.stddev_samp(F.col("s")), moments.stddev_pop(F.col("s")))
    assert tuple(got.first()) == (None, None)


def test_ttest_and_summary_from_states(spark):
    rng = random.Random(12)
    schema = "slot_no int, rh_score int, ah_score int, rh_net_2a double, rh_net_2b double, ah_net_2a double, ah_net_2b double"
    rows = [(rng.randint(1, 3), rng.randint(0, 7), rng.randint(0, 7), *[rng.gauss(1, 2) for _ in range(4)]) for _ in range(200)]
    state = ps.study_state(spark.createDataFrame(rows, schema).repartition(5))
    tests = {(r["signal"], r["baseline"]): r for r in ps.ttest_net(state).collect()}
    for k, key in enumerate([("RH", "2a"), ("RH", "2b"), ("AH", "2a"), ("AH", "2b")], 3):
        values = [r[k] for r in rows]
        assert tests[key]["mean"] == pytest.approx(statistics.mean(values)) and tests[key]["n"] == 200
        assert tests[key]["std"] == pytest.approx(statistics.stdev(values))
    summary = {r["slot_no"]: r for r in ps.slot_summary(state).collect()}
    assert summary[4]["n_events"] == 0 and summary[4]["mean_score"] is None
    assert summary[2]["mean_rh_net"] == pytest.approx(statistics.mean(r[4] for r in rows if r[0] == 2))
    assert summary[2]["mean_score"] == pytest.approx(statistics.mean(r[2] for r in rows if r[0] == 2))


# -- linkage -----------------------------------------------------------------------------
def _brute(a_rows, b_rows):
    """Every pair of every block, straight from the definition."""
    w, found = MATCH_WEIGHTS, []
    for _, a in a_rows.iterrows():
        for _, b in b_rows[b_rows["block"] == a["block"]].iterrows():
            x, y = a["norm"], b["norm"]
            longest = max(len(x), len(y))
            contain = min(len(x), len(y)) / longest if longest and (x in y or y in x) else 0.0
            agree = a["acr"] == y or b["acr"] == x or a["acr"] == b["acr"]
            score = round(
                w["token"] * token_set_ratio(x, y) / 100 + w["char"] * jaro_winkler(x, y)
                + w["contain"] * contain + w["acronym"] * agree, 4,
            )
            if score >= 0.6:
                found.append((a["raw"], b["raw"], score))
    best = {}
    for x, y, s in found:
        if x not in best or (-s, y) < (-best[x][1], best[x][0]):
            best[x] = (y, s)
    return found, best


def _random_names(rng, n):
    words = ["red", "reds", "redstone", "re", "widget", "wagon", "wheel", "gear", "gears", "gizmo", "a", "b", "x", "red"]
    names = set()
    while len(names) < n:
        name = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        names.add(rng.choice([name, name.upper(), name + " Ltd.", name.replace(" ", " & ", 1), name + "!"]))
    return sorted(names | {"Ltd", "&", "rwg", "aab"})


@pytest.mark.parametrize("size", [7, 1000])  # many tiles and one tile per group
def test_matches_equal_all_pairs(spark, size, monkeypatch):
    monkeypatch.setattr(lk, "tiles", lambda a, b, rule, _, f=lk.tiles: f(a, b, rule, size))
    rng = random.Random(size)
    a = lk.prepared(spark.createDataFrame([(n,) for n in _random_names(rng, 90)], "c string"))
    b = lk.prepared(spark.createDataFrame([(n,) for n in _random_names(rng, 110)], "c string"))
    found, best = _brute(a.toPandas(), b.toPandas())
    got = {r["company_a"]: (r["company_b"], r["score"]) for r in lk.match_best(a, lk.forms(a), lk.forms(b)).collect()}
    assert got == best and len(best) > 40
    norm_a, norm_b = (dict(zip(f["raw"], f["norm"])) for f in (a.toPandas(), b.toPandas()))
    pairs = {(r["norm_a"], r["norm_b"], r["score"]) for r in lk.match_scored(lk.forms(a), lk.forms(b)).collect()}
    assert pairs == {(norm_a[x], norm_b[y], s) for x, y, s in found}


def test_limit_follows_the_weights():
    assert lk.long_limit(MatchRule()) in (989, 990)
    assert lk.long_limit(MatchRule(threshold=0.5)) == 0  # everything in the block is compared
    assert lk.long_limit(MatchRule(threshold=0.7)) > 10**9  # no such pair can match


def test_long_names_without_containment_are_found(spark):
    words = " ".join(f"w{i:04d}" for i in range(400))  # about 2,400 characters
    other = words.replace("w0200 w0201", "w0201 w0200")
    a = lk.prepared(spark.createDataFrame([(words,)], "c string"))
    b = lk.prepared(spark.createDataFrame([(other + " v",), ("w000 x",)], "c string"))
    _, best = _brute(a.toPandas(), b.toPandas())
    got = {r["company_a"]: (r["company_b"], r["score"]) for r in lk.match_best(a, lk.forms(a), lk.forms(b)).collect()}
    assert got == best


def test_only_lengths_of_the_other_list_are_laid_out(spark):
    long = "aaaa" * 100  # every place starts with the block key
    a = lk.forms(lk.prepared(spark.createDataFrame([(long,), ("aaaab",), ("zzzz",)], "c string")))
    b = lk.forms(lk.prepared(spark.createDataFrame([("aaaa",), ("aaaaaaa",), ("aaaaaab",), ("yyyy",)], "c string")))
    assert {r["block"]: sorted(r["lengths"]) for r in lk.name_lengths(b).collect()} == {"aaaa": [4, 7], "yyyy": [4]}
    assert lk._stretches(a, b).count() == 397 + 394 + 1
    got = {(r["norm_a"], r["norm_b"]) for r in lk.equality_pairs(a, b).select("norm_a", "norm_b").collect()}
    assert got >= {(long, "aaaa"), (long, "aaaaaaa"), ("aaaab", "aaaa")}
    assert all(x in y or y in x for x, y in got)


def test_block_sizes(spark):
    a = lk.prepared(spark.createDataFrame([("red one",), ("red two",), ("blue",)], "c string"))
    b = lk.prepared(spark.createDataFrame([("red x",), ("green",)], "c string"))
    assert [tuple(r) for r in lk.block_sizes(a, b).collect()] == [("red ", 2, 1, 2)]


@pytest.mark.parametrize("size", [2, 1000])  # many tiles and one tile per block
def test_candidates_are_all_pairs_of_a_block(spark, size):
    left = ["red one", "red two", "red two", "Red Two", "blue", "", None, *[f"red {k}" for k in range(7)]]
    right = ["red x", "red x", "RED y!", "green", "Ltd", None, *[f"red {k}" for k in range(5)]]
    a, b = (lk.prepared(spark.createDataFrame([(n,) for n in names], "c string")) for names in (left, right))
    expected = sorted((x["block"], x["raw"], y["raw"]) for x in a.collect() for y in b.collect() if x["block"] == y["block"] is not None)
    pairs = lk.candidates(a, b, size)
    rows = [tuple(r) for r in pairs.collect()]
    assert sorted((block, x, y) for block, x, _, y, _ in rows) == expected and len(expected) == 11 * 8 + 1
    assert len(set(rows)) == len(rows)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "REPARTITION_BY_NUM" in plan  # not put together by their few bytes


def test_block_sizes_count_the_candidates(spark, monkeypatch):
    a = lk.prepared(spark.createDataFrame([("red one",), ("red one",), ("red two",), ("blue",)], "c string"))
    b = lk.prepared(spark.createDataFrame([("red x",), ("red y",), ("blue",)], "c string"))
    assert sorted(map(tuple, lk.block_sizes(a, b).collect())) == [("blue", 1, 1, 1), ("red ", 3, 2, 6)]
    monkeypatch.setattr(lk, "candidates", lambda a, b, f=lk.candidates: f(a, b).where("raw_a != 'red two'"))
    assert sorted(map(tuple, lk.block_sizes(a, b).collect())) == [("blue", 1, 1, 1), ("red ", 2, 2, 4)]


def test_matching_sends_no_list_to_the_driver(spark):
    a = lk.prepared(spark.createDataFrame([("red one",), ("red two",), ("blue",)], "c string"))
    b = lk.prepared(spark.createDataFrame([("red one x",), ("ro",)], "c string"))
    forms = lk.forms(a), lk.forms(b)
    scored = lk.match_scored(*forms)
    for found in (scored, lk.match_rows(a, b, scored), lk.match_best(a, *forms)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_related_pairs_include_containment_below_the_threshold(spark):
    a = lk.forms(lk.prepared(spark.createDataFrame([("ab cd",), ("ab cd ef",)], "c string")))
    b = lk.forms(lk.prepared(spark.createDataFrame([("ab cdefgh ijklm nopq rstu vwxyz 0123",), ("ab cd xy",)], "c string")))
    got = {(r["norm_a"], r["norm_b"]) for r in lk.related_pairs(a, b).collect()}
    matching = {(r["norm_a"], r["norm_b"]) for r in lk.match_scored(a, b).collect()}
    low = ("ab cd", "ab cdefgh ijklm nopq rstu vwxyz 0123")
    assert low in got and low not in matching and matching <= got


def test_related_pairs_send_no_list_to_the_driver(spark):
    """Stored forms have a known small size, which would be broadcast."""
    a = stored(lk.forms(lk.prepared(spark.createDataFrame([("red one",), ("red two",), ("blue",)], "c string"))), "forms")
    b = stored(lk.forms(lk.prepared(spark.createDataFrame([("red one x",), ("ro",)], "c string"))), "forms")
    plan = lk.with_parts(lk.related_pairs(a, b))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
