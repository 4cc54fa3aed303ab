"""Checking SQL for an independent engine.

Every statement is written from the definition of the result: time slices are
range predicates, medians and quantiles are built-in aggregates, nearest
minutes are as-of joins.  None of it follows the shape of the Spark plans.
"""

from __future__ import annotations

FLOOR = "2024-01-02"


def _r(expr: str, name: str | None = None) -> str:
    """Rounded to six places without negative zero, ties nudged upwards."""
    name = name or expr
    return (
        f"CASE WHEN abs({expr}) < 5e-7 THEN 0.0 ELSE round(({expr}) + 1e-9, 6) END AS {name}"
    )


def _exact(x: str, digits: int) -> str:
    """Half-even rounding of the exact binary value, by formatted output."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _scaled(x: str, digits: int) -> str:
    """Half-even rounding of the scaled value, by the cast to a whole number."""
    return f"CAST({x} * {10 ** digits} AS BIGINT) / {10 ** digits}.0::DOUBLE"


def _ah(t: str, rh: str) -> str:
    return (
        f"216.7 * ({rh} / 100.0) * 6.112 * exp(17.67 * {t} / ({t} + 243.5)) / ({t} + 273.15)"
    )


def _score(x: str, edges: tuple) -> str:
    cases = " ".join(f"WHEN {x} <= {e} THEN {i}" for i, e in enumerate(edges))
    return f"CASE WHEN {x} IS NULL THEN 7 {cases} ELSE 7 END"


RH = (0, 1.5, 3, 5, 8, 12, 16)
AH = (0, 0.15, 0.3, 0.5, 0.8, 1.2, 1.6)

_SLOT = (
    "CASE WHEN {h} BETWEEN 6 AND 9 THEN 1 WHEN {h} BETWEEN 10 AND 13 THEN 2"
    " WHEN {h} BETWEEN 14 AND 17 THEN 3 ELSE 4 END"
)
_SLOT_NAMES = "(VALUES (1, '06:00–10:00'), (2, '10:00–14:00'), (3, '14:00–18:00'), (4, '18:00–06:00')) v(slot_no, slot)"

_MEANS = ("temp_in", "temp_out", "temp_delta", "ah_in", "ah_out", "ah_delta")

_BAND_HIT = (
    "((sensor_id IN ('101', '103') AND val BETWEEN {r0} AND {r1})"
    " OR (sensor_id IN ('102', '104') AND val BETWEEN {t0} AND {t1}))"
)


def _weighted_slope(y: str, x: str, part: str) -> str:
    """Textbook OLS slope, missing when any value of the part is."""
    return (
        f"CASE WHEN count(*) FILTER (WHERE {part}) = count({y}) FILTER (WHERE {part})"
        f" THEN regr_slope({y}, {x}) FILTER (WHERE {part}) END"
    )


def _angle(tangent: str) -> str:
    """Integral of (cos(a + d) / cos(a)) ** (nu - 1) over d, up to a quarter turn or 1e-17."""
    end = f"least(atan2(1.0, {tangent}), 80.0 / greatest(nu - 1, 1e-9) / ({tangent} + sqrt(pow({tangent}, 2) + 80.0 / greatest(nu - 1, 1e-9))))"
    at = f"({end} * i / 4000)"
    value = f"pow(greatest(cos({at}) - {tangent} * sin({at}), 0.0), nu - 1)"
    return (
        f"({end} / 12000 * list_sum(list_transform(range(0, 4001), lambda i:"
        f" (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {value})))"
    )


_FROM_START = "date_diff('minute', date_trunc('minute', ts), minute_ts)"

# name -> (inputs, body)
_TABLES: dict[str, tuple[tuple, str]] = {
    # -- inputs -----------------------------------------------------------------
    "packed": ((), """
        SELECT *, make_timestamp(epoch_us(TIMESTAMP '2024-01-01')
                  + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 6) AS pts
        FROM events"""),
    "sensor_data": (("packed",), """
        SELECT CAST(pts AS VARCHAR) AS measure_date,
               CASE WHEN event_id % 53 = 0 THEN '199' ELSE CAST(101 + event_id % 4 AS VARCHAR) END AS sensor_id,
               CASE WHEN event_id % 97 = 0 THEN 'ERR'
                    WHEN event_id % 4 IN (0, 2) THEN CAST(round(20 + value % 85, 2) AS VARCHAR)
                    ELSE CAST(round(value % 60 - 2, 2) AS VARCHAR) END AS data_value
        FROM packed"""),
    "actuator_measure": (("packed",), """
        SELECT CASE WHEN event_id % 101 = 0 THEN 'bad text'
                    ELSE strftime(date_trunc('second', pts), '%Y-%m-%d %H:%M:%S') END AS start_time,
               CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS execution_time,
               CAST(user_id % 4 AS VARCHAR) AS state,
               CASE WHEN event_id % 5 = 4 THEN '2' ELSE '1' END AS actuator_id
        FROM packed"""),
    "pump": (("actuator_measure",), f"""
        SELECT * FROM (SELECT *, TRY_CAST(start_time AS TIMESTAMP) AS started FROM actuator_measure)
        WHERE actuator_id = '1' AND start_time >= '{FLOOR}' AND started IS NOT NULL"""),
    "calendar": ((), """
        SELECT o_orderkey AS execution_id, o_orderdate AS start_time,
               CAST(floor(o_totalprice) AS BIGINT) AS execution_time,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS executed
        FROM orders"""),
    "runs": ((), """
        SELECT l_orderkey AS schedule_id, max(l_shipdate) AS last_execution,
               CAST(floor(any_value(o_totalprice)) AS BIGINT) AS execution_time
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey"""),
    "all_executions": (("calendar", "runs"), """
        SELECT 'calendar' AS _source, start_time, execution_time AS runtime
        FROM calendar WHERE execution_id % 2 = 0
        UNION ALL
        SELECT 'schedule', last_execution, execution_time FROM runs WHERE schedule_id % 2 = 0"""),
    "weather": ((), """
        SELECT d + to_hours(CAST(h AS BIGINT)) AS datetime, temperature_2m, relative_humidity_2m, rain,
               surface_pressure, wind_speed_10m
        FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events)
        CROSS JOIN range(24) t(h)
        LEFT JOIN (SELECT date_trunc('hour', ts)::TIMESTAMP AS hr, avg(value) AS temperature_2m,
                          avg(value % 100) AS relative_humidity_2m, min(value) AS rain,
                          max(value) AS surface_pressure, avg(value % 20) AS wind_speed_10m
                   FROM events GROUP BY 1) x ON x.hr = d + to_hours(CAST(h AS BIGINT))"""),
    "faulty": (("weather",), """
        SELECT date_trunc('day', datetime)::TIMESTAMP AS start, CAST(extract('hour' FROM datetime) AS INTEGER) AS position,
               temperature_2m, relative_humidity_2m, rain, surface_pressure, wind_speed_10m FROM weather
        UNION ALL
        SELECT d, 24, t, h, r, p, w
        FROM (SELECT date_trunc('day', datetime)::TIMESTAMP AS d, max(temperature_2m) AS t, max(relative_humidity_2m) AS h,
                     max(rain) AS r, max(surface_pressure) AS p, max(wind_speed_10m) AS w FROM weather GROUP BY 1)
        WHERE day(d) % 3 = 0
        UNION ALL
        SELECT DISTINCT date_trunc('day', datetime)::TIMESTAMP, 25, NULL, NULL, NULL, NULL, NULL
        FROM weather WHERE day(datetime) % 3 = 0"""),
    "rejected": (("faulty",), """
        SELECT start, start + INTERVAL 1 DAY AS "end", CASE WHEN day(start) % 7 = 0 THEN 0 ELSE 3600 END AS step_s, position,
               CASE WHEN day(start) % 7 = 0 THEN 'no axis' ELSE 'beyond the axis' END AS reason,
               temperature_2m, relative_humidity_2m, rain, surface_pressure, wind_speed_10m
        FROM faulty WHERE day(start) % 7 = 0 OR position >= 24"""),
    "customs": ((), """
        SELECT p_name AS description, p_type AS origin, p_brand AS cargo,
               p_type || ' ' || p_brand AS data_type,
               CASE WHEN p_partkey % 50 = 0 THEN 'n/a' ELSE CAST(p_retailprice AS VARCHAR) END AS fob,
               p_size % 2 + 6 AS regime, p_name AS packaging
        FROM part"""),
    "customs_flags": (("customs",), """
        SELECT *, contains(lower(description), 'red') AS t_description,
               contains(lower(origin), 'o') AS t_origin, contains(lower(cargo), 'brand#1') AS t_cargo,
               contains(lower(data_type), 'y brand') AS t_data_type,
               TRY_CAST(fob AS DOUBLE) IS NOT NULL AS t_fob, regime = 7 AS t_regime,
               contains(lower(packaging), 'g') AS t_packaging
        FROM customs"""),
    # -- ten-minute path ----------------------------------------------------------
    "readings": (("sensor_data",), f"""
        SELECT *, ts - INTERVAL 5 HOUR AS local_ts FROM (
            SELECT sensor_id, CAST(measure_date AS TIMESTAMP) AS ts, TRY_CAST(data_value AS DOUBLE) AS val
            FROM sensor_data)
        WHERE ts >= TIMESTAMP '{FLOOR}' AND {_BAND_HIT.format(r0=25, r1=100, t0=0, t1=55)}"""),
    "b10": (("readings",), """
        SELECT time_bucket(INTERVAL '10 minutes', local_ts) AS local_bucket, sensor_id,
               avg(val) AS avg_val
        FROM readings GROUP BY ALL"""),
    "buckets": (("b10",), f"""
        SELECT *, temp_in - temp_out AS temp_delta, ah_in - ah_out AS ah_delta FROM (
            SELECT *, CAST(extract('hour' FROM local_bucket) AS INTEGER) AS hour,
                   CAST(CAST(local_bucket AS DATE) AS VARCHAR) AS day,
                   {_ah('temp_in', 'rh_in')} AS ah_in, {_ah('temp_out', 'rh_out')} AS ah_out
            FROM (SELECT local_bucket,
                         max(CASE WHEN sensor_id = '101' THEN avg_val END) AS rh_in,
                         max(CASE WHEN sensor_id = '102' THEN avg_val END) AS temp_in,
                         max(CASE WHEN sensor_id = '103' THEN avg_val END) AS rh_out,
                         max(CASE WHEN sensor_id = '104' THEN avg_val END) AS temp_out
                  FROM b10 GROUP BY 1))"""),
    "complete": (("buckets",), """
        SELECT * FROM buckets WHERE temp_in IS NOT NULL AND temp_out IS NOT NULL
                                AND ah_in IS NOT NULL AND ah_out IS NOT NULL"""),
    "hourly": (("complete",), f"""
        SELECT CAST(h AS INTEGER) AS hour, {', '.join(f'coalesce(avg({c}), 0) AS {c}' for c in _MEANS)},
               count(temp_in) AS n
        FROM range(24) s(h) LEFT JOIN complete ON complete.hour = h GROUP BY h"""),
    "daily_env": (("complete",), f"""
        SELECT day, {', '.join(f'avg({c}) AS avg_{c}' for c in _MEANS)} FROM complete GROUP BY day"""),
    "pump_daily": (("pump",), """
        SELECT CAST(CAST(started - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS local_day,
               count(*) AS n_events, count(*) FILTER (WHERE state = '1') AS n_success
        FROM pump GROUP BY 1"""),
    # -- minute path ----------------------------------------------------------------
    "minute_median": (("sensor_data",), f"""
        SELECT sensor_id, date_trunc('minute', ts) AS ts, median(val) AS val FROM (
            SELECT sensor_id, CAST(measure_date AS TIMESTAMP) AS ts,
                   CAST(TRY_CAST(data_value AS FLOAT) AS DOUBLE) AS val FROM sensor_data)
        WHERE {_BAND_HIT.format(r0=0, r1=100, t0=0, t1=50)} GROUP BY ALL"""),
    "filled": (("minute_median",), """
        SELECT sensor_id, ts, val, false AS filled FROM minute_median
        UNION ALL
        SELECT sensor_id, ts + to_minutes(k),
               val + (nval - val) * k / (date_diff('minute', ts, nts)), true
        FROM (SELECT *, lead(ts) OVER w AS nts, lead(val) OVER w AS nval FROM minute_median
              WINDOW w AS (PARTITION BY sensor_id ORDER BY ts))
        CROSS JOIN range(1, 6) g(k)
        WHERE ts + to_minutes(k) < nts"""),
    "minutes": (("filled",), f"""
        SELECT coalesce(i.ts, o.ts) AS ts, i.rh AS rh_in, o.rh AS rh_out, i.ah AS ah_in, o.ah AS ah_out
        FROM (SELECT coalesce(a.ts, b.ts) AS ts, a.val AS rh, {_ah('b.val', 'a.val')} AS ah
              FROM (FROM filled WHERE sensor_id = '101') a
              FULL JOIN (FROM filled WHERE sensor_id = '102') b ON a.ts = b.ts) i
        FULL JOIN (SELECT coalesce(a.ts, b.ts) AS ts, a.val AS rh, {_ah('b.val', 'a.val')} AS ah
              FROM (FROM filled WHERE sensor_id = '103') a
              FULL JOIN (FROM filled WHERE sensor_id = '104') b ON a.ts = b.ts) o ON i.ts = o.ts"""),
    "limits": (("minutes",), """
        SELECT min(ts) FILTER (WHERE rh_in IS NOT NULL) AS first_in,
               max(ts) FILTER (WHERE rh_in IS NOT NULL) AS last_in,
               min(ts) FILTER (WHERE rh_out IS NOT NULL) AS first_out,
               max(ts) FILTER (WHERE rh_out IS NOT NULL) AS last_out FROM minutes"""),
    "events2": (("pump",), """
        SELECT DISTINCT start_time, execution_time, state, started AS ts,
               TRY_CAST(execution_time AS INTEGER) AS exec_secs FROM pump"""),
    "starts": (("events2",), "SELECT DISTINCT ts FROM events2"),
    "segments": (("starts", "minutes", "limits"), """
        SELECT s.ts, g.m AS minute_ts, g.m <= s.ts AS in_pre, g.m >= s.ts AS in_post,
               coalesce(g.m BETWEEN first_in AND last_in, false) AS grid_in,
               coalesce(g.m BETWEEN first_out AND last_out, false) AS grid_out,
               rh_in, rh_out, ah_in, ah_out
        FROM (SELECT ts, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 20 MINUTE,
                                                date_trunc('minute', ts) + INTERVAL 30 MINUTE,
                                                INTERVAL 1 MINUTE)) AS m FROM starts) g
        JOIN starts s ON s.ts = g.ts AND g.m BETWEEN s.ts - INTERVAL 20 MINUTE AND s.ts + INTERVAL 30 MINUTE
        CROSS JOIN limits
        LEFT JOIN minutes ON minutes.ts = g.m"""),
    "ah_stats": (("segments",), """
        SELECT ts, count(*) FILTER (WHERE side = 'in' AND in_pre) AS n_pre,
               count(*) FILTER (WHERE side = 'in' AND in_post) AS n_post,
               avg(v) FILTER (WHERE side = 'in' AND in_pre) AS pre_mean,
               regr_slope(v, k) FILTER (WHERE side = 'in' AND in_pre) AS sl_in,
               CASE WHEN count(*) FILTER (WHERE side = 'out') > 1
                    THEN regr_slope(v, k) FILTER (WHERE side = 'out') ELSE 0 END AS sl_out,
               arg_max(v, minute_ts) FILTER (WHERE side = 'in' AND in_post)
               - arg_max(v, minute_ts) FILTER (WHERE side = 'in' AND in_pre) AS actual
        FROM (SELECT *, row_number() OVER (PARTITION BY ts, side ORDER BY minute_ts) AS k FROM (
                SELECT ts, minute_ts, in_pre, in_post, 'in' AS side, ah_in AS v FROM segments
                UNION ALL
                SELECT ts, minute_ts, in_pre, in_post, 'out', ah_out FROM segments) WHERE v IS NOT NULL)
        GROUP BY ts"""),
    "rh_stats": (("segments",), f"""
        SELECT ts, count(*) FILTER (WHERE in_pre AND grid_in) AS n_pre,
               count(*) FILTER (WHERE in_post AND grid_in) AS n_post,
               avg(rh_in) FILTER (WHERE in_pre) AS pre_mean,
               {_weighted_slope('rh_in', _FROM_START, 'in_pre AND grid_in')} AS sl_in,
               CASE WHEN count(*) FILTER (WHERE grid_out) <= 1 THEN 0
                    ELSE {_weighted_slope('rh_out', _FROM_START, 'grid_out')} END AS sl_out,
               first(rh_in ORDER BY minute_ts DESC) FILTER (WHERE in_post AND grid_in)
               - first(rh_in ORDER BY minute_ts DESC) FILTER (WHERE in_pre AND grid_in) AS actual
        FROM segments GROUP BY ts"""),
    "effects": (("pump", "ah_stats"), f"""
        SELECT *, {_score('ah_net', AH)} AS ah_score,
               CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS local_day
        FROM (SELECT e.ts, e.state, actual - (0.33 * sl_in + 0.67 * sl_out) * 30 AS ah_net
              FROM (SELECT DISTINCT started AS ts, state FROM pump) e
              JOIN ah_stats USING (ts) WHERE n_pre >= 14 AND n_post >= 21)"""),
    "event_daily": (("effects",), """
        SELECT local_day, count(ah_net) AS n_events, median(ah_net) AS median_net,
               median(ah_score) AS median_score,
               avg(CASE WHEN ah_net > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_positive
        FROM effects GROUP BY local_day"""),
    "daily_full": (("buckets", "pump_daily", "daily_env", "event_daily"), """
        SELECT day, coalesce(p.n_events, 0) AS n_events, coalesce(n_success, 0) AS n_success,
               d.* EXCLUDE (day), e.n_events AS ev_n_events, median_net, median_score, pct_positive,
               coalesce(p.n_events, 0) > 0 AS pump_active
        FROM (SELECT DISTINCT day FROM buckets) s
        LEFT JOIN pump_daily p ON p.local_day = s.day
        LEFT JOIN daily_env d USING (day)
        LEFT JOIN event_daily e ON e.local_day = s.day"""),
    "net": (("events2", "rh_stats", "ah_stats"), f"""
        SELECT *, {_score('rh_net_2b', RH)} AS rh_score, {_score('ah_net_2b', AH)} AS ah_score
        FROM (SELECT e.ts, e.state, e.exec_secs,
                     {_SLOT.format(h="extract('hour' FROM e.ts)")} AS slot_no,
                     r.pre_mean AS rh_pre_mean, r.actual AS rh_actual,
                     r.actual - r.sl_in * 30 AS rh_net_2a,
                     r.actual - (0.33 * r.sl_in + 0.67 * r.sl_out) * 30 AS rh_net_2b,
                     a.pre_mean AS ah_pre_mean, a.actual AS ah_actual,
                     a.actual - a.sl_in * 30 AS ah_net_2a,
                     a.actual - (0.33 * a.sl_in + 0.67 * a.sl_out) * 30 AS ah_net_2b
              FROM events2 e JOIN rh_stats r USING (ts) JOIN ah_stats a USING (ts)
              WHERE r.n_pre >= 14 AND r.n_post >= 21 AND a.n_pre >= 14 AND a.n_post >= 21)"""),
    "scores": (("net",), """
        SELECT slot_no, 'RH' AS signal, rh_score AS score FROM net
        UNION ALL SELECT slot_no, 'AH', ah_score FROM net"""),
    "boxes": (("scores",), """
        SELECT signal, slot_no, count(*) AS n, avg(score) AS mu, quantile_cont(score, 0.25) AS q1,
               quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3
        FROM scores GROUP BY ALL"""),
    "whiskers": (("boxes", "scores"), """
        SELECT b.signal, b.slot_no, any_value(n) AS n, any_value(mu) AS mu, any_value(q1) AS q1,
               any_value(q2) AS q2, any_value(q3) AS q3,
               least(any_value(q1), min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1))) AS lo,
               greatest(any_value(q3), max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1))) AS hi
        FROM boxes b JOIN scores s ON s.signal = b.signal AND s.slot_no = b.slot_no
        GROUP BY b.signal, b.slot_no"""),
    "ticks": (("minutes", "limits"), """
        SELECT 'ah_in' AS series, ts AS m FROM minutes WHERE ah_in IS NOT NULL
        UNION ALL SELECT 'ah_out', ts FROM minutes WHERE ah_out IS NOT NULL
        UNION ALL SELECT 'rh_in', unnest(generate_series(first_in, last_in, INTERVAL 1 MINUTE)) FROM limits
        UNION ALL SELECT 'rh_out', unnest(generate_series(first_out, last_out, INTERVAL 1 MINUTE)) FROM limits"""),
    "nearest": (("starts", "ticks"), """
        SELECT series, ts, CASE WHEN pm IS NULL THEN nm WHEN nm IS NULL THEN pm
                                WHEN ts - pm < nm - ts THEN pm ELSE nm END AS tick
        FROM (SELECT q.series, q.ts, p.m AS pm, n.m AS nm
              FROM (SELECT series, ts FROM starts CROSS JOIN (SELECT DISTINCT series FROM ticks)) q
              ASOF LEFT JOIN ticks p ON q.series = p.series AND q.ts >= p.m
              ASOF LEFT JOIN ticks n ON q.series = n.series AND q.ts <= n.m)"""),
    "traces": (("net", "nearest", "minutes"), """
        SELECT upper(split_part(series, '_', 1)) AS signal, split_part(series, '_', 2) AS side, e.id,
               date_diff('minute', tick, e.at) AS off,
               CASE series WHEN 'rh_in' THEN rh_in WHEN 'rh_out' THEN rh_out
                           WHEN 'ah_in' THEN ah_in ELSE ah_out END AS v
        FROM (SELECT n.id, series, tick, unnest(generate_series(tick - INTERVAL 20 MINUTE, tick + INTERVAL 30 MINUTE,
                                                                INTERVAL 1 MINUTE)) AS at
              FROM (SELECT row_number() OVER () AS id, ts FROM net) n JOIN nearest USING (ts)) e
        LEFT JOIN minutes mm ON mm.ts = e.at"""),
    "good_traces": (("traces",), """
        SELECT signal, id, max(base) FILTER (WHERE side = 'in') AS base_in,
               max(base) FILTER (WHERE side = 'out') AS base_out
        FROM (SELECT signal, side, id, (count(*) - count(v)) / count(*) AS gaps,
                     avg(v) FILTER (WHERE off BETWEEN -3 AND -1) AS base
              FROM traces GROUP BY ALL)
        GROUP BY ALL HAVING max(gaps) <= 0.3 AND count(base) = 2"""),
    # -- operations ---------------------------------------------------------------------
    "online": (("sensor_data",), """
        SELECT sensor_id, day, hours AS online_hours, round_even(hours / 24 * 100, 1) AS pct_online FROM (
            SELECT sensor_id, CAST(CAST(l AS DATE) AS VARCHAR) AS day,
                   CAST(count(DISTINCT extract('hour' FROM l)) AS INTEGER) AS hours
            FROM (SELECT sensor_id, CAST(measure_date AS TIMESTAMP) - INTERVAL 5 HOUR AS l FROM sensor_data
                  WHERE sensor_id IN ('101', '102', '103', '104'))
            GROUP BY ALL)"""),
    "attempts": (("pump",), """
        SELECT t, CAST(CAST(t AS DATE) AS VARCHAR) AS day, state
        FROM (SELECT started - INTERVAL 5 HOUR AS t, state FROM pump)"""),
    "by_state": (("attempts",), """
        SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE state = '0') AS s0,
               count(*) FILTER (WHERE state = '1') AS s1, count(*) FILTER (WHERE state = '2') AS s2,
               count(*) FILTER (WHERE state = '3') AS s3, count(state) AS total
        FROM (SELECT unnest(generate_series(min(CAST(day AS DATE)), max(CAST(day AS DATE)), INTERVAL 1 DAY)) AS d
              FROM attempts)
        LEFT JOIN attempts ON attempts.day = CAST(CAST(d AS DATE) AS VARCHAR) GROUP BY 1"""),
    "net_days": (("attempts",), """
        SELECT day, count(*) AS need, count(*) FILTER (WHERE solved) AS succ FROM (
            SELECT day, bool_or(state = '1') AS solved FROM attempts
            GROUP BY day, time_bucket(INTERVAL '10 minutes', t) HAVING bool_or(state IN ('1', '2')))
        GROUP BY day"""),
    # -- slopes ---------------------------------------------------------------------------
    "metrics": (("events2", "minutes"), f"""
        SELECT CAST('0x' || substr(sha256(length(start_time) || ':' || start_time || length(execution_time) || ':' || execution_time || length(state) || ':' || state), 1, 15) AS BIGINT)
                   AS id_evento, CAST(date_diff('minute', date_trunc('minute', e.ts), e.at) AS DOUBLE) AS tiempo_relativo,
               rh_in AS humedad, rh_out AS humedad_externa, slot AS franja
        FROM (SELECT *, {_SLOT.format(h="extract('hour' FROM ts)")} AS own_slot,
                     unnest(generate_series(date_trunc('minute', ts) - INTERVAL 20 MINUTE,
                                            date_trunc('minute', ts) + INTERVAL 30 MINUTE, INTERVAL 1 MINUTE)) AS at
              FROM events2) e
        JOIN minutes m ON m.ts = e.at
        JOIN {_SLOT_NAMES} ON slot_no = e.own_slot
        WHERE rh_in IS NOT NULL OR rh_out IS NOT NULL"""),
    "features": (("metrics",), f"""
        SELECT *, slope_internal_pre - slope_external_pre AS slope_relative_pre,
               slope_internal_post - slope_external_post AS slope_relative_post,
               (slope_internal_post - slope_external_post) - (slope_internal_pre - slope_external_pre)
                   AS delta_detach
        FROM (SELECT id_evento, count(*) FILTER (WHERE tiempo_relativo < 0) AS n_pre,
                     count(*) FILTER (WHERE tiempo_relativo >= 0) AS n_post, min(franja) AS franja,
                     {_weighted_slope('humedad', 'tiempo_relativo', 'tiempo_relativo < 0')} AS slope_internal_pre,
                     {_weighted_slope('humedad_externa', 'tiempo_relativo', 'tiempo_relativo < 0')} AS slope_external_pre,
                     {_weighted_slope('humedad', 'tiempo_relativo', 'tiempo_relativo >= 0')} AS slope_internal_post,
                     {_weighted_slope('humedad_externa', 'tiempo_relativo', 'tiempo_relativo >= 0')} AS slope_external_post
              FROM metrics GROUP BY id_evento)
        WHERE n_pre >= 10 AND n_post >= 20"""),
    # -- measures -----------------------------------------------------------------------------
    "measures": (("sensor_data", "weather"), """
        SELECT date_trunc('hour', CAST(measure_date AS TIMESTAMP)) AS fecha_hora,
               CASE sensor_id WHEN '101' THEN 'Humidity 1' WHEN '102' THEN 'Temperature 1'
                              WHEN '103' THEN 'Humidity 2' ELSE 'Temperature 2' END AS medida,
               min(TRY_CAST(data_value AS DOUBLE)) AS value_min, avg(TRY_CAST(data_value AS DOUBLE)) AS value_avg,
               max(TRY_CAST(data_value AS DOUBLE)) AS value_max
        FROM sensor_data WHERE TRY_CAST(data_value AS DOUBLE) IS NOT NULL AND sensor_id <> '199' GROUP BY 1, 2
        UNION ALL
        SELECT datetime, medida, v, v, v FROM (
            SELECT datetime, temperature_2m AS w_temp, relative_humidity_2m AS w_humidity, rain AS w_rain,
                   surface_pressure AS w_pressure, wind_speed_10m AS w_wind FROM weather)
        UNPIVOT (v FOR medida IN (w_temp, w_humidity, w_rain, w_pressure, w_wind))"""),
    "pivoted": (("measures",), """
        SELECT fecha_hora, avg(value_avg) FILTER (WHERE medida = 'Temperature 1') AS temperature_1,
               avg(value_avg) FILTER (WHERE medida = 'Temperature 2') AS temperature_2,
               avg(value_avg) FILTER (WHERE medida = 'w_temp') AS w_temp
        FROM measures WHERE fecha_hora >= '2024-01-02' AND fecha_hora < '2024-01-05'
             AND medida IN ('Temperature 1', 'Temperature 2', 'w_temp') GROUP BY 1"""),
    # -- names ------------------------------------------------------------------------------
    "lots": ((), """
        SELECT p_name, p_brand,
               translate(reverse(lpad(CAST(p_partkey // 10 AS VARCHAR), 6, '0')), '0123456789', 'abcdefghij') AS lot
        FROM part"""),
    "names": (("lots",), """
        SELECT 'a' AS side, raw FROM (SELECT DISTINCT lot || ' ' || p_name || ' Inc.' AS raw FROM lots)
        UNION ALL
        SELECT 'b', raw FROM (SELECT upper(lot || ' ' || p_name) || ' & ' || p_brand || ' GmbH' AS raw FROM lots
                              UNION SELECT lot || ' ' || p_name || 's Ltd.' FROM lots)"""),
    "normed": (("names",), """
        SELECT side, raw, norm, array_to_string(list_transform(string_split(norm, ' '), lambda w: left(w, 1)), '') AS acr,
               left(norm, 4) AS block
        FROM (SELECT side, raw, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(
                  replace(lower(raw), '&', ' and '), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
                  lambda w: w NOT IN ('ltd', 'limited', 'inc', 'llc', 'corp', 'corporation', 'co', 'company',
                                      'gmbh', 'sarl', 'sa', 'bv', 'plc', 'oy', 'ag', 'kg')), ' ') AS norm
              FROM names)"""),
    "form_pairs": (("normed",), """
        SELECT a.norm AS norm_a, b.norm AS norm_b, a.n AS n_rows_a, b.n AS n_rows_b, b.name,
               a.acr AS acr_a, b.acr AS acr_b,
               CASE WHEN contains(a.norm, b.norm) OR contains(b.norm, a.norm)
                    THEN least(length(a.norm), length(b.norm))::DOUBLE / greatest(length(a.norm), length(b.norm))
                    ELSE 0.0 END AS contain,
               CASE WHEN a.acr = b.norm OR b.acr = a.norm OR a.acr = b.acr THEN 1.0 ELSE 0.0 END::DOUBLE AS acronym
        FROM (SELECT norm, acr, block, count(*) AS n FROM normed WHERE side = 'a' GROUP BY ALL) a
        JOIN (SELECT norm, acr, block, count(*) AS n, min(raw) AS name FROM normed WHERE side = 'b' GROUP BY ALL) b
             USING (block)"""),
    "token_sets": (("form_pairs",), """
        SELECT *, CASE WHEN sect = '' THEN ra ELSE trim(sect || ' ' || ra) END AS with_a,
               CASE WHEN sect = '' THEN rb ELSE trim(sect || ' ' || rb) END AS with_b
        FROM (SELECT *, array_to_string(list_sort(list_filter(wa, lambda w: list_contains(wb, w))), ' ') AS sect,
                     array_to_string(list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w))), ' ') AS ra,
                     array_to_string(list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w))), ' ') AS rb
              FROM (SELECT *, list_distinct(string_split(norm_a, ' ')) AS wa,
                           list_distinct(string_split(norm_b, ' ')) AS wb FROM form_pairs))"""),
    # longest common subsequence by the classic table, one row per character of the left text
    "subsequences": (("token_sets",), """
        SELECT *, list_reduce(
            list_transform(string_split(with_a, ''), lambda c: [ord(c)]),
            lambda above, ch: list_reduce(
                list_transform(range(1, len(with_b) + 1), lambda j: [CAST(j AS INTEGER), ord(with_b[j])]),
                lambda line, cell: list_append(line, greatest(line[-1], above[cell[1] + 1],
                                            above[cell[1]] + (CASE WHEN cell[2] = ch[1] THEN 1 ELSE 0 END))),
                [0]),
            list_transform(range(0, len(with_b) + 1), lambda j: 0))[-1] AS lcs
        FROM token_sets"""),
    "scored": (("subsequences",), """
        SELECT *, CAST(printf('%.4f', 0.35 * (ratio / 100) + 0.25 * jaro_winkler_similarity(norm_a, norm_b)
                              + 0.2 * contain + 0.2 * acronym) AS DOUBLE) AS score
        FROM (SELECT *, CASE WHEN sect <> '' AND (ra = '' OR rb = '') THEN 100.0::DOUBLE
                             WHEN sect = '' THEN whole
                             ELSE greatest(whole, 100.0::DOUBLE - 100.0::DOUBLE * (len(with_a) - len(sect)) / (len(sect) + len(with_a)),
                                           100.0::DOUBLE - 100.0::DOUBLE * (len(with_b) - len(sect)) / (len(sect) + len(with_b)))
                        END AS ratio
              FROM (SELECT *, 100.0::DOUBLE - 100.0::DOUBLE * (len(with_a) + len(with_b) - 2 * lcs)
                                              / (len(with_a) + len(with_b)) AS whole
                    FROM subsequences))
        WHERE norm_a <> '' AND norm_b <> ''"""),
    # -- significance ------------------------------------------------------------------------
    "tests": (("net",), """
        SELECT *, n - 1 AS nu, mean / (std / sqrt(n)) AS t FROM (
            SELECT signal, baseline, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std
            FROM (VALUES ('RH', '2a'), ('RH', '2b'), ('AH', '2a'), ('AH', '2b')) v(signal, baseline)
            LEFT JOIN (SELECT 'RH' AS signal, '2a' AS baseline, rh_net_2a AS x FROM net
                       UNION ALL SELECT 'RH', '2b', rh_net_2b FROM net
                       UNION ALL SELECT 'AH', '2a', ah_net_2a FROM net
                       UNION ALL SELECT 'AH', '2b', ah_net_2b FROM net) USING (signal, baseline)
            GROUP BY ALL)"""),
    # both tails over the whole, each by Simpson's rule over the angle with 4,000 strips
    "pvalues": (("tests",), f"""
        SELECT signal, baseline, n, mean, std, t, nu, p, -log10(p) AS log_p
        FROM (SELECT *, CASE WHEN nu >= 1 THEN pow(1 + t * t / nu, -(nu - 1) / 2.0)
                             * {_angle('abs(t) / sqrt(nu)')} / {_angle('0.0')} END AS p FROM tests)"""),
}


def _bucket_kpi() -> str:
    parts = {
        "avg_temp_lift": ("avg(temp_delta)", 2), "peak_temp_lift": ("max(temp_delta)", 2),
        "avg_ah_enrich": ("avg(ah_delta)", 3), "peak_ah_enrich": ("max(ah_delta)", 3),
        "avg_daytime_temp_in": ("avg(temp_in)", 1), "avg_daytime_temp_out": ("avg(temp_out)", 1),
        "avg_daytime_ah_in": ("avg(ah_in)", 2), "avg_daytime_ah_out": ("avg(ah_out)", 2),
    }
    cols = ", ".join(_r(_scaled(e, d), n) for n, (e, d) in parts.items())
    return f"SELECT {cols} FROM complete WHERE hour BETWEEN 6 AND 19"


_FEATURES = ("slope_internal_pre", "slope_external_pre", "slope_relative_pre", "slope_internal_post",
             "slope_external_post", "slope_relative_post", "delta_detach")
_WEATHER = ("temperature_2m", "relative_humidity_2m", "rain", "surface_pressure", "wind_speed_10m")
_DAILY = [f"avg_{c}" for c in _MEANS]
_SIDES = ("rh_in", "rh_out", "ah_in", "ah_out")


def _cols(plain: str, *floats: str) -> str:
    return ", ".join(([plain] if plain else []) + [_r(f) for f in floats])


def _edge_labels() -> str:
    rows = []
    for signal, edges, d in (("RH", RH, 1), ("AH", AH, 2)):
        labels = ["≤ 0"]
        labels += [f"{a:.{d}f} – {b:.{d}f}" for a, b in zip(edges, edges[1:])]
        labels.append(f"> {edges[-1]:.{d}f}")
        rows += [f"('{signal}', {i}, '{text}')" for i, text in enumerate(labels)]
    return f"(VALUES {', '.join(rows)}) l(signal, score, label)"


def _grade(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 'none' WHEN {x} >= 80 THEN 'good' WHEN {x} >= 50 THEN 'warn' ELSE 'bad' END"
    )


def _pct(a: str, b: str) -> str:
    return f"round_even({a} / nullif({b}, 0) * 100, 1)"


# query -> (inputs, final select)
_FINAL: dict[str, tuple[tuple, str]] = {
    "snapshot_counts": (("sensor_data", "calendar"), """
        SELECT table_name, count(DISTINCT r) AS n_rows, count(cell) AS n_cells,
               CAST(sum(length(cell)) AS BIGINT) AS n_chars
        FROM (SELECT 'sensor_data' AS table_name, row_number() OVER () AS r,
                     unnest([measure_date, sensor_id, data_value]) AS cell FROM sensor_data
              UNION ALL
              SELECT 'calendar_executions', row_number() OVER (),
                     unnest([CAST(execution_id AS VARCHAR), CAST(start_time AS VARCHAR),
                             CAST(execution_time AS VARCHAR), 'ON', 'OFF', CAST(executed AS VARCHAR)]) FROM calendar
              UNION ALL
              SELECT 'schedule', row_number() OVER (),
                     unnest([CAST(o_orderkey AS VARCHAR), CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)]) FROM orders
              UNION ALL
              SELECT 'schedule_data', row_number() OVER (),
                     unnest([CAST(l_orderkey AS VARCHAR), CAST(max(l_shipdate) AS VARCHAR)]) FROM lineitem GROUP BY l_orderkey)
        GROUP BY table_name"""),
    "weather_explode": (("weather",), f"SELECT {_cols('datetime', *_WEATHER)} FROM weather"),
    "weather_new_rows": (("weather",), f"""
        SELECT {_cols('datetime', *_WEATHER)} FROM weather WHERE extract('hour' FROM datetime) % 2 = 1"""),
    "weather_load": (("weather",), f"SELECT {_cols('datetime', *_WEATHER)} FROM weather"),
    "weather_rejects": (("rejected",), "SELECT " + _cols('start, "end", step_s, position, reason', *_WEATHER) + " FROM rejected"),
    "weather_reject_counts": (("rejected",), """
        SELECT start, reason, count(*) AS n_rejected, min(position) AS first_position,
               count(coalesce(temperature_2m, relative_humidity_2m, rain, surface_pressure, wind_speed_10m)) AS n_with_value
        FROM rejected GROUP BY ALL"""),
    "readings_window": (("sensor_data",), f"""
        SELECT sensor_id, CAST(ts AS DATE) AS day, count(*) AS n_rows, count(val) AS n_values, {_r('avg(val)', 'mean_value')}
        FROM (SELECT sensor_id, TRY_CAST(measure_date AS TIMESTAMP) AS ts, TRY_CAST(data_value AS DOUBLE) AS val FROM sensor_data)
        WHERE ts >= TIMESTAMP '2024-01-02 06:00:00' AND ts < TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1, 2"""),
    "readings_on_event_days": (("sensor_data", "actuator_measure"), f"""
        SELECT day, count(*) AS n_rows, count(val) AS n_values, {_r('avg(val)', 'mean_value')}
        FROM (SELECT CAST(TRY_CAST(measure_date AS TIMESTAMP) AS DATE) AS day, TRY_CAST(data_value AS DOUBLE) AS val FROM sensor_data)
        WHERE day IN (SELECT CAST(TRY_CAST(start_time AS TIMESTAMP) AS DATE) FROM actuator_measure
                      WHERE state = '3' AND CAST(execution_time AS INTEGER) >= 200 AND start_time <> 'bad text')
        GROUP BY 1"""),
    "rejected_times": (("actuator_measure",), """
        SELECT start_time, actuator_id, count(*) AS n_rows FROM actuator_measure
        WHERE TRY_CAST(start_time AS TIMESTAMP) IS NULL GROUP BY ALL"""),
    "executions_load": (("calendar", "runs", "all_executions"), """
        FROM all_executions
        UNION ALL
        SELECT * FROM (SELECT 'calendar' AS _source, start_time, execution_time AS runtime
                       FROM calendar WHERE executed = 1
                       UNION ALL SELECT 'schedule', last_execution, execution_time FROM runs) r
        WHERE NOT EXISTS (SELECT 1 FROM all_executions a WHERE a._source = r._source
                          AND a.start_time = r.start_time AND a.runtime = r.runtime)"""),
    "sync_executions": (("calendar", "runs", "all_executions"), """
        SELECT * FROM (SELECT 'calendar' AS _source, start_time, execution_time AS runtime
                       FROM calendar WHERE executed = 1
                       UNION ALL SELECT 'schedule', last_execution, execution_time FROM runs) r
        WHERE NOT EXISTS (SELECT 1 FROM all_executions a WHERE a._source = r._source
                          AND a.start_time = r.start_time AND a.runtime = r.runtime)"""),
    "chart_daily": (("daily_full",), "SELECT day, " + ", ".join(
        _r(_exact(c, 3), c) for c in [*_DAILY, "median_score", "pct_positive"])
        + ", n_events, pump_active, row_number() OVER (ORDER BY day) AS position FROM daily_full"),
    "chart_hourly": (("hourly",), "SELECT printf('%02d:00', hour) AS label, " + ", ".join(
        _r(_exact(c, 2 if c in ("temp_in", "temp_out") else 3), c) for c in _MEANS) + ", hour + 1::BIGINT AS position FROM hourly"),
    "csv_roundtrip": (("customs",), "SELECT * FROM customs"),
    "executed_calendar": (("calendar",), "SELECT start_time, execution_time FROM calendar WHERE executed = 1"),
    "band_filter": (("readings",), f"SELECT {_cols('sensor_id, ts', 'val')} FROM readings"),
    "measures_slice": (("measures",), f"""
        SELECT {_cols('fecha_hora, medida', 'value_min', 'value_avg', 'value_max')},
               row_number() OVER (ORDER BY fecha_hora) AS position FROM measures
        WHERE medida = 'Temperature 1' AND fecha_hora >= '2024-01-02'"""),
    "measures_pivot": (("pivoted",), f"SELECT {_cols('fecha_hora', 'temperature_1', 'temperature_2', 'w_temp')} FROM pivoted"),
    "measures_head": (("pivoted",), f"""
        SELECT {_cols('fecha_hora', 'temperature_1', 'temperature_2', 'w_temp')}
        FROM (FROM pivoted ORDER BY fecha_hora LIMIT 48)"""),
    "unified_measures": (("measures",), f"SELECT {_cols('fecha_hora, medida', 'value_min', 'value_avg', 'value_max')} FROM measures"),
    "customs_filter": (("customs_flags",), f"""
        SELECT description, origin, cargo, data_type, {_r('TRY_CAST(fob AS DOUBLE)', 'fob')}, regime, packaging
        FROM customs_flags WHERE t_description AND t_origin AND t_cargo AND t_data_type AND t_fob AND t_regime"""),
    "customs_boxes": (("customs_flags",), f"""
        SELECT description, origin, cargo, data_type, {_r('TRY_CAST(fob AS DOUBLE)', 'fob')}, regime, packaging
        FROM customs_flags WHERE t_description AND t_origin AND t_cargo AND t_data_type AND t_fob AND t_regime
             AND t_packaging"""),
    "customs_funnel": (("customs_flags",), """
        SELECT count(*) AS n_rows, count(*) FILTER (WHERE t_description) AS n_description,
               count(*) FILTER (WHERE t_origin) AS n_origin, count(*) FILTER (WHERE t_cargo) AS n_cargo,
               count(*) FILTER (WHERE t_data_type) AS n_data_type, count(*) FILTER (WHERE t_fob) AS n_fob,
               count(*) FILTER (WHERE t_regime) AS n_regime,
               count(*) FILTER (WHERE t_description AND t_origin AND t_cargo AND t_data_type AND t_fob AND t_regime)
                   AS n_filtered,
               count(*) FILTER (WHERE t_description AND t_origin AND t_cargo AND t_data_type AND t_fob AND t_regime
                                AND t_packaging) AS n_boxes
        FROM customs_flags"""),
    "schedule_runs": (("runs",), "SELECT * FROM runs"),
    "bucket_10min": (("b10",), f"SELECT {_cols('local_bucket, sensor_id', 'avg_val')} FROM b10"),
    "bucket_wide": (("buckets",), f"""
        SELECT {_cols('local_bucket, hour, day', 'rh_in', 'rh_out', *_MEANS)} FROM buckets"""),
    "bucket_completeness": (("buckets", "complete"), """
        SELECT count(*) AS total_buckets, (SELECT count(*) FROM complete) AS complete_buckets,
               min(day) AS first_day, max(day) AS last_day FROM buckets"""),
    "hourly_profile": (("hourly",), f"SELECT {_cols('hour, n', *_MEANS)} FROM hourly"),
    "daily_env": (("daily_env",), f"SELECT {_cols('day', *_DAILY)} FROM daily_env"),
    "pump_daily": (("pump_daily",), "SELECT * FROM pump_daily"),
    "event_daily": (("event_daily",), f"SELECT {_cols('local_day, n_events', 'median_net', 'median_score', 'pct_positive')} FROM event_daily"),
    "daily_full": (("daily_full",), f"""
        SELECT {_cols('day, n_events, n_success, ev_n_events, pump_active', *_DAILY, 'median_net', 'median_score', 'pct_positive')}
        FROM daily_full"""),
    "kpi_daytime": (("complete",), _bucket_kpi()),
    "kpi_peak_hours": (("complete",), """
        SELECT (SELECT hour FROM complete WHERE hour BETWEEN 6 AND 19
                ORDER BY temp_delta DESC, local_bucket LIMIT 1) AS peak_temp_hour,
               (SELECT hour FROM complete GROUP BY hour ORDER BY avg(ah_delta) DESC, hour LIMIT 1) AS peak_ah_hour"""),
    "kpi_shares": (("buckets", "complete"), f"""
        SELECT {_r('(SELECT avg(CASE WHEN temp_delta < 0 THEN 1.0 ELSE 0 END) * 100 FROM complete WHERE hour BETWEEN 0 AND 5)', 'night_cool_pct')},
               {_r('(SELECT avg(CASE WHEN rh_in >= 99 THEN 1.0 ELSE 0 END) * 100 FROM buckets WHERE rh_in IS NOT NULL)', 'rh_sat_pct')}"""),
    "kpi_pump": (("event_daily",), f"""
        SELECT {_r(_scaled('median(median_score)', 2), 'overall_median_score')},
               {_r(_scaled('avg(pct_positive)', 1), 'overall_pct_positive')}, count(*) AS n_pump_days,
               count(*) FILTER (WHERE pct_positive >= 50) AS days_mostly_positive,
               count(*) FILTER (WHERE n_events > 0 AND median_score >= 1) AS days_score_positive
        FROM event_daily"""),
    "ah_correlation": (("complete",), f"SELECT {_r('corr(ah_in, ah_out)', 'ah_corr')} FROM complete"),
    "days_without_pump": (("buckets", "pump_daily"), """
        SELECT count(DISTINCT day) AS n_sensor_days,
               count(DISTINCT day) FILTER (WHERE day NOT IN (SELECT local_day FROM pump_daily)) AS n_no_pump_days
        FROM buckets"""),
    "minute_median": (("minute_median",), f"SELECT {_cols('sensor_id, ts', 'val')} FROM minute_median"),
    "gap_fill": (("filled",), f"SELECT {_cols('sensor_id, ts, filled', 'val')} FROM filled"),
    "ah_minute_series": (("minutes",), f"""
        SELECT {_cols('ts', 'ah_in', 'ah_out')} FROM minutes WHERE ah_in IS NOT NULL OR ah_out IS NOT NULL"""),
    "event_segments": (("segments",), f"SELECT {_cols('ts, minute_ts, in_pre, in_post, grid_in, grid_out', *_SIDES)} FROM segments"),
    "nearest_tick": (("nearest",), "SELECT series, ts, tick FROM nearest "),
    "ordinal_slope": (("ah_stats", "rh_stats"), f"""
        SELECT ts, {_r('a.sl_in', 'ah_slope_in')}, {_r('a.sl_out', 'ah_slope_out')},
               {_r('r.sl_in', 'rh_slope_in')}, {_r('r.sl_out', 'rh_slope_out')}
        FROM ah_stats a JOIN rh_stats r USING (ts) WHERE a.n_pre >= 14 AND a.n_post >= 21"""),
    "event_net": (("net",), "SELECT " + _cols(
        "ts, state, exec_secs, slot_no, rh_score, ah_score",
        *[f"{s}_{m}" for s in ("rh", "ah") for m in ("pre_mean", "actual", "net_2a", "net_2b")]) + " FROM net"),
    "event_profile": (("traces", "good_traces"), f"""
        SELECT signal, side, CAST(off AS INTEGER) AS off, count(*) AS n_events, {_r('median(z)', 'median')}, {_r('stddev_pop(z)', 'std')}
        FROM (SELECT signal, side, off, v - CASE side WHEN 'in' THEN base_in ELSE base_out END AS z
              FROM traces JOIN good_traces USING (signal, id)) GROUP BY ALL"""),
    "score_histogram": (("scores",), f"""
        SELECT l.signal, l.score, l.label, count(s.score) AS n_events
        FROM {_edge_labels()} LEFT JOIN scores s ON s.signal = l.signal AND s.score = l.score GROUP BY ALL"""),
    "slot_summary": (("net",), f"""
        SELECT v.slot_no, slot, count(ts) AS n_events, {_r('avg(ah_score)', 'mean_score')},
               {_r('avg(rh_net_2b)', 'mean_rh_net')}, {_r('avg(ah_net_2b)', 'mean_ah_net')}
        FROM {_SLOT_NAMES} LEFT JOIN net ON net.slot_no = v.slot_no GROUP BY v.slot_no, slot"""),
    "slot_boxplot": (("whiskers", "scores"), f"""
        SELECT b.signal, b.slot_no, slot, n AS n_events, {_r('mu', 'mean')}, {_r('q1')}, {_r('q2', 'median')},
               {_r('q3')}, {_r('lo', 'whisker_low')}, {_r('hi', 'whisker_high')},
               (SELECT count(*) FROM scores s WHERE s.signal = b.signal AND s.slot_no = b.slot_no
                                              AND (s.score < lo OR s.score > hi)) AS n_outliers
        FROM whiskers b JOIN {_SLOT_NAMES} ON v.slot_no = b.slot_no"""),
    "ttest_net": (("pvalues",), f"SELECT {_cols('signal, baseline, n, nu', 'mean', 'std', 't', 'p', 'log_p')} FROM pvalues"),
    "pump_verdict": (("pvalues",), f"""
        SELECT n_events, {_cols('', 'p_rh', 'p_ah', 'mean_ah')},
               CASE WHEN p_ah < 0.05 AND mean_ah > 0.3 THEN 'RELEVANT' WHEN p_ah < 0.05 THEN 'MARGINAL'
                    ELSE 'NOT CONCLUSIVE' END AS verdict,
               CASE WHEN coalesce(p_rh, 1) >= 0.05 AND p_ah < 0.05 THEN 'RH masked by temperature'
                    WHEN coalesce(p_rh, 1) >= 0.05 THEN 'neither signal significant' ELSE 'none' END AS note
        FROM (SELECT max(n) FILTER (WHERE signal = 'AH') AS n_events, max(p) FILTER (WHERE signal = 'RH') AS p_rh,
                     max(p) FILTER (WHERE signal = 'AH') AS p_ah, max(mean) FILTER (WHERE signal = 'AH') AS mean_ah
              FROM pvalues WHERE baseline = '2b')"""),
    "event_relative_metrics": (("metrics",), f"SELECT {_cols('id_evento, franja', 'tiempo_relativo', 'humedad', 'humedad_externa')} FROM metrics"),
    "slope_features": (("features",), f"SELECT {_cols('id_evento, n_pre, n_post, franja', *_FEATURES)} FROM features"),
    "slope_table": (("features",), f"""
        SELECT id_evento, franja, {_r('delta_detach')}, CASE WHEN abs(delta_detach) < 0.02 THEN '0'
               WHEN slope_relative_post > 0 THEN CASE WHEN delta_detach > 0 THEN 'IF' ELSE 'IS' END
               WHEN delta_detach < 0 THEN 'DF' ELSE 'DS' END AS class_v0 FROM features"""),
    "slope_class": (("features",), """
        SELECT id_evento, CASE WHEN abs(delta_detach) < 0.02 THEN '0'
               WHEN slope_relative_post > 0 THEN CASE WHEN delta_detach > 0 THEN 'IF' ELSE 'IS' END
               WHEN delta_detach < 0 THEN 'DF' ELSE 'DS' END AS class_v0 FROM features"""),
    "online_hours": (("online",), f"SELECT {_cols('sensor_id, day, online_hours', 'pct_online')} FROM online"),
    "online_totals": (("online",), f"""
        SELECT sensor_id, CAST(sum(online_hours) AS BIGINT) AS total_hours,
               {_r('round_even(sum(online_hours) / (count(*) * 24) * 100, 1)', 'avg_pct_online')},
               count(*) AS days_with_data FROM online GROUP BY sensor_id"""),
    "attempts_by_state": (("by_state",), "SELECT * FROM by_state"),
    "raw_success": (("by_state",), f"""
        SELECT day, attempts, successes, {_r(_pct('successes', 'attempts'), 'rate_pct')} FROM (
            SELECT day, total AS attempts, s1 AS successes FROM by_state
            UNION ALL SELECT 'total', CAST(sum(total) AS BIGINT), CAST(sum(s1) AS BIGINT) FROM by_state)"""),
    "net_success": (("net_days",), f"""
        SELECT day, need, succ, need - succ AS failed, {_r(_pct('succ', 'need'), 'rate_pct')} FROM (
            FROM net_days UNION ALL
            SELECT 'total', CAST(coalesce(sum(need), 0) AS BIGINT), CAST(coalesce(sum(succ), 0) AS BIGINT) FROM net_days)"""),
    "daily_grades": (("online", "attempts", "net_days"), f"""
        SELECT day, hours_101, hours_102, hours_103, hours_104,
               {', '.join(_r(f"online_pct_{s}") for s in (101, 102, 103, 104))}, s1, s0, {_r('raw_pct')}, {_r('net_pct')},
               {_grade('raw_pct')} AS raw_grade, {_grade('net_pct')} AS net_grade
        FROM (SELECT day, {', '.join(f"coalesce(h{s}, 0) AS hours_{s}" for s in (101, 102, 103, 104))},
                     {', '.join(f"online_pct_{s}" for s in (101, 102, 103, 104))}, coalesce(s1, 0) AS s1, coalesce(s0, 0) AS s0, coalesce(total, 0) AS total,
                     {_pct('s1', 'total')} AS raw_pct, {_pct('succ', 'need')} AS net_pct
              FROM (SELECT day, {', '.join(f"max(online_hours) FILTER (WHERE sensor_id = '{s}') AS h{s}, max(pct_online) FILTER (WHERE sensor_id = '{s}') AS online_pct_{s}" for s in (101, 102, 103, 104))}
                    FROM online GROUP BY day)
              FULL JOIN (SELECT day, count(*) FILTER (WHERE state = '1') AS s1,
                                count(*) FILTER (WHERE state = '0') AS s0, count(*) AS total
                         FROM attempts GROUP BY day) USING (day)
              LEFT JOIN net_days USING (day))
        WHERE total > 0 OR hours_101 > 0"""),
    "absolute_humidity": (("buckets",), f"SELECT {_cols('local_bucket', 'ah_in', 'ah_out')} FROM buckets"),
    "score_bins": (("buckets",), f"""
        SELECT local_bucket, {_score('ah_delta', AH)} AS ah_score, {_score('(rh_in - rh_out)', RH)} AS rh_score
        FROM buckets"""),
    "time_slots": (("events2",), f"""
        SELECT ts, exec_secs, state, slot_no, slot FROM (
            SELECT *, {_SLOT.format(h="extract('hour' FROM ts)")} AS no FROM events2)
        JOIN {_SLOT_NAMES} ON slot_no = no"""),
    "local_clock": (("readings",), """
        SELECT sensor_id, ts, local_ts, time_bucket(INTERVAL '10 minutes', local_ts) AS local_bucket,
               CAST(CAST(local_ts AS DATE) AS VARCHAR) AS day, CAST(extract('hour' FROM local_ts) AS INTEGER) AS hour
        FROM readings"""),
    "name_normalize": (("normed",), "SELECT raw, norm, acr, block FROM normed"),
    "match_candidates": (("normed",), """
        SELECT block, count(DISTINCT a.raw) AS n_a, count(DISTINCT b.raw) AS n_b, count(*) AS n_pairs
        FROM (FROM normed WHERE side = 'a') a JOIN (FROM normed WHERE side = 'b') b USING (block) GROUP BY block"""),
    "match_parts": (("scored",), f"""
        SELECT {_cols('norm_a, norm_b, acronym', 'contain')}, {_r('ratio / 100', 'token')} FROM scored
        WHERE score >= 0.6 OR contain > 0 OR acr_a = norm_b OR acr_b = norm_a"""),
    "match_jw": (("scored",), f"""
        SELECT norm_a, norm_b, {_r('jaro_winkler_similarity(norm_a, norm_b)', 'jaro_winkler')} FROM scored
        WHERE score >= 0.6 OR contain > 0 OR acr_a = norm_b OR acr_b = norm_a"""),
    "match_scored": (("scored",), f"""
        SELECT {_cols('norm_a, norm_b, n_rows_a, n_rows_b', 'score')} FROM scored WHERE score >= 0.6"""),
    "match_rows": (("scored", "normed"), f"""
        SELECT a.raw AS company_a, b.raw AS company_b, {_r('ratio / 100', 'token')},
               {_r('jaro_winkler_similarity(norm_a, norm_b)', 'char')}, {_cols('acronym', 'contain', 'score')},
               row_number() OVER (ORDER BY score DESC, a.raw, b.raw) AS position
        FROM scored s JOIN normed a ON a.side = 'a' AND a.norm = s.norm_a JOIN normed b ON b.side = 'b' AND b.norm = s.norm_b
        WHERE score >= 0.6"""),
    "match_best": (("scored", "normed"), f"""
        SELECT n.raw AS company_a, arg_min(name, (-score, name)) AS company_b, {_r('max(score)', 'score')},
               row_number() OVER (ORDER BY n.raw) AS position
        FROM scored s JOIN normed n ON n.side = 'a' AND n.norm = s.norm_a
        WHERE score >= 0.6 GROUP BY n.raw"""),
    "distinct_events": (("events2",), "SELECT ts, exec_secs, state FROM events2"),
}


# the names of lots and the plain names of the parts; the other queries have the lots alone
_ALL_NAMES = """
        SELECT 'a' AS side, raw FROM (SELECT lot || ' ' || p_name || ' Inc.' AS raw FROM lots
                                      UNION SELECT p_name || ' Inc.' FROM lots)
        UNION ALL
        SELECT 'b', raw FROM (SELECT upper(lot || ' ' || p_name) || ' & ' || p_brand || ' GmbH' AS raw FROM lots
                              UNION SELECT lot || ' ' || p_name || 's Ltd.' FROM lots
                              UNION SELECT upper(p_name) || ' & ' || p_brand || ' GmbH' FROM lots
                              UNION SELECT p_name || 's Ltd.' FROM lots)"""
_WITH_ALL_NAMES = ("match_candidates", "match_parts", "match_jw", "match_scored", "match_best")


def _needed(names, seen: list) -> list:
    for name in names:
        if name not in seen:
            _needed(_TABLES[name][0], seen)
            seen.append(name)
    return seen


def statements() -> dict[str, str]:
    """One self-contained statement per query."""
    result = {}
    for query, (inputs, body) in _FINAL.items():
        tables = _needed(inputs, [])
        once = ("minute_median", "filled", "minutes", "packed", "pump")  # have several readers
        bodies = {name: _TABLES[name][1] for name in tables}
        if query in _WITH_ALL_NAMES:
            bodies["names"] = _ALL_NAMES
        prefix = ",\n".join(
            f"{name} AS {'MATERIALIZED ' if name in once else ''}({body})" for name, body in bodies.items()
        )
        result[query] = f"WITH {prefix}\n{body}" if tables else body
    return result
