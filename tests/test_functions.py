"""Hand-computed cases of the column functions."""

from __future__ import annotations

import decimal
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing, scoring, student, text
from hygroflow.functions.rounding import round_exact, round_scaled
from hygroflow.functions.similarity import common_subsequence, jaro_winkler, token_set_ratio
from hygroflow.settings import AH_EDGES


def _values(spark, rows, schema, column):
    data = [(i, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, f"i int, v {schema}")
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").select("x").collect()]


def test_score_edges(spark):
    given = [-1.0, 0.0, 0.15, 0.1501, 1.6, 1.61, None, float("nan"), float("-inf"), float("inf")]
    assert _values(spark, given, "double", scoring.score(F.col("v"), AH_EDGES)) == [
        0, 0, 1, 2, 6, 7, 7, 7, 7, 7,
    ]


def test_slots(spark):
    hours = [5, 6, 9, 10, 13, 14, 17, 18, 23, 0]
    assert _values(spark, hours, "int", scoring.slot_number(F.col("v"))) == [
        4, 1, 1, 2, 2, 3, 3, 4, 4, 4,
    ]


def test_numbers_out_of_text(spark):
    given = ["1.5d", "nan", "ERR", " 1.5 ", "2f", "0x1p3", None, "-3e1", "inf"]
    got = _values(spark, given, "string", parsing.to_number(F.col("v")))
    assert got[0] is None and math.isnan(got[1]) and got[2] is None and got[3] == 1.5
    assert got[4] is None and got[5] is None and got[6] is None and got[7] == -30.0
    assert got[8] is None
    assert _values(spark, ["-inf", "Infinity", "x"], "string", parsing.to_number_or_infinity(F.col("v"))) == [
        -math.inf, math.inf, None,
    ]
    in_band = _values(spark, given, "string", parsing.to_number(F.col("v")).between(0, 100))
    assert [bool(x) for x in in_band] == [False, False, False, True] + [False] * 5


def test_rounding(spark):
    rng = random.Random(1)
    given = [0.125, 0.375, 33.995, 2.675, -2.675, 0.70625, 0.78375, 1.005, -0.5, 1e6 + 0.005]
    given += [round(rng.uniform(-60, 60), 3) for _ in range(300)] + [rng.uniform(-60, 60) for _ in range(50)]
    for digits in (2, 4):
        exact = _values(spark, given, "double", round_exact(F.col("v"), digits))
        assert exact == [round(x, digits) for x in given]
        scaled = _values(spark, given, "double", round_scaled(F.col("v"), digits))
        assert scaled == [float(np.round(x, digits)) for x in given]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_clock_ignores_the_session_zone(spark, zone):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = F.lit("2024-03-10 02:30:30.123456").cast("timestamp_ntz")  # does not exist in New York
        row = spark.range(1).select(
            clock.minute_index(ts).alias("m"),
            clock.from_minute(clock.minute_index(ts)).cast("string").alias("back"),
            clock.from_micros(clock.micros(ts)).cast("string").alias("us"),
            clock.day_text(clock.shifted(ts, 5)).alias("day"),
            clock.bucket(ts).cast("string").alias("bucket"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert row["m"] == 28500630
    assert row["back"] == "2024-03-10 02:30:00" and row["us"] == "2024-03-10 02:30:30.123456"
    assert row["day"] == "2024-03-09" and row["bucket"] == "2024-03-10 02:30:00"


def test_student_p(spark):
    cases = [(2.0, 10), (2.0, 9), (2.0, 1), (2.0, 2), (-2.0, 10), (0.0, 5), (2.0, 100_000),
             (2.0, 100_001), (4.0, 10_000_000)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t double, n bigint")
    p = [r[0] for r in df.select(student.two_sided_p(F.col("t"), F.col("n")), "i").orderBy("i").collect()]
    assert p[0] == pytest.approx(0.07339, abs=1e-5)
    assert p[1] == pytest.approx(0.07655, abs=1e-5)
    assert p[2] == pytest.approx(1 - 2 * math.atan(2) / math.pi)
    assert p[3] == pytest.approx(1 - 2 / math.sqrt(2 + 4))
    assert p[4] == p[0] and p[5] == pytest.approx(1.0)
    assert p[6] == pytest.approx(p[7], rel=1e-4)
    assert p[8] == pytest.approx(math.erfc(4 / math.sqrt(2)), rel=1e-4)


def _exact_p(t: int, nu: int) -> float:
    """Finite sum for even degrees of freedom, with 90 digits."""
    with decimal.localcontext(decimal.Context(prec=90)):
        whole = decimal.Decimal(nu + t * t)
        sine, cos2 = decimal.Decimal(t) / whole.sqrt(), nu / whole
        term = total = decimal.Decimal(1)
        for k in range(1, nu // 2):
            term = term * (2 * k - 1) / (2 * k) * cos2
            total += term
        return float(1 - sine * total)


def test_student_tails_keep_their_digits(spark):
    cases = [(t, nu) for t in (1, 8, 10, 20) for nu in (2, 10, 100, 1000, 100_000)]
    cases += [(t, nu) for t in (8, 10, 20) for nu in (1, 10**6, 10**9)]
    df = spark.createDataFrame([(float(t), n) for t, n in cases], "t double, n bigint")
    got = [r[0] for r in df.coalesce(1).select(student.two_sided_p(F.col("t"), F.col("n"))).collect()]
    for (t, nu), p in zip(cases, got, strict=True):
        if nu == 1:
            expected, rel = 2 / math.pi * math.atan(1 / t), 1e-9
        elif nu <= 100_000:
            expected, rel = _exact_p(t, nu), 1e-9
        else:
            # the normal tail and the first term of its expansion in 1 / nu
            normal, density = math.erfc(t / math.sqrt(2)), math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            expected, rel = normal + 2 * density * (t**3 + t) / (4 * nu), 3 * (t**4 / nu) ** 2 + 1e-9
        assert p > 0 and p == pytest.approx(expected, rel=rel), (t, nu)


def test_slope_classes(spark):
    rows = [(0.01, 1.0), (0.5, 1.0), (-0.5, 1.0), (-0.5, -1.0), (0.5, -1.0), (None, None), (None, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d double, r double")
    got = [x[0] for x in df.select(scoring.slope_class(F.col("d"), F.col("r")), "i").orderBy("i").collect()]
    assert got == ["0", "IF", "IS", "DF", "DS", "DS", "IS"]


def test_grades(spark):
    assert _values(spark, [80.0, 79.9, 50.0, 49.9, None], "double", scoring.grade(F.col("v"))) == [
        "good", "warn", "warn", "bad", "none",
    ]


def test_names(spark):
    norm = text.normalized(F.col("v"))
    names = ["A&B Ltd.", "  Café—Niño, S.A. ", "Company Inc", "LTD"]
    assert _values(spark, names, "string", norm) == ["a and b", "café niño s a", "", ""]
    assert _values(spark, names[:1], "string", text.acronym(norm)) == ["aab"]
    assert _values(spark, names[:1], "string", text.block_key(norm)) == ["a an"]


def test_containment(spark):
    df = spark.createDataFrame([("", "", 0), ("ab", "abcd", 1), ("abcd", "bc", 2), ("ab", "cd", 3)], "a string, b string, i int")
    got = [r[0] for r in df.select(text.containment(F.col("a"), F.col("b")), "i").orderBy("i").collect()]
    assert got == [0.0, 0.5, 0.5, 0.0]


def test_similarities():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611111)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133333)
    assert jaro_winkler("abc", "xyz") == 0.0 and jaro_winkler("", "") == 1.0
    assert common_subsequence("kitten", "sitting") == 4 and common_subsequence("", "a") == 0
    assert token_set_ratio("blue bolt", "bolt blue blue") == 100.0
    assert token_set_ratio("blue bolt", "blue") == 100.0 and token_set_ratio("", "blue") == 0.0
    # shared "blue" and remainders "bolt", "gear": against one full text 8 of 13 characters match
    assert token_set_ratio("blue bolt", "blue gear") == pytest.approx(100 * 8 / 13)
