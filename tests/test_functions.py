"""Edge frames for the parsing and scalar rules (FIXTURES.md part C)."""

import math

from pyspark.sql import functions as F

from rentalytics.functions import (amenity_count, amenity_flag, amenity_list, date_text, haversine_km,
                                   integral_text, numeric_text, price_text, tf_flag, truthy_int)


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_numeric_text(spark):
    got = [r[0] for r in one_col(spark, ["1e3", " 12 ", "1d", "nan", "", "1,000", "N/A", "-2.5", ".5", None])
           .select(numeric_text("v")).collect()]
    assert got == [1000.0, 12.0, None, None, None, None, None, -2.5, 0.5, None]


def test_numeric_text_infinity(spark):
    got = one_col(spark, ["inf", "-Infinity"]).select(numeric_text("v")).collect()
    assert math.isinf(got[0][0]) and got[1][0] < 0


def test_integral_text_exact_and_whole(spark):
    got = [r[0] for r in one_col(spark, ["1100000000000000001", "12.0", "12.7", "x", " 7 "])
           .select(integral_text("v")).collect()]
    assert got == [1100000000000000001, 12, None, None, 7]


def test_price_text(spark):
    got = [r[0] for r in one_col(spark, ["$1,250.00", "-5 €", "", None, "€ 80"]).select(price_text("v")).collect()]
    assert got == [1250.0, 5.0, None, None, 80.0]


def test_tf_flag_and_truthy(spark):
    df = one_col(spark, ["t", "f", None, "x"])
    assert [r[0] for r in df.select(tf_flag("v")).collect()] == [True, False, False, False]
    df2 = one_col(spark, ["true", "1", "T", "yes", "y", "1.0", None, "no", "\tYes\n"])
    assert [r[0] for r in df2.select(truthy_int("v")).collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 1]


def test_amenity_count(spark):
    got = [r[0] for r in one_col(spark, [None, "[]", '["a, b"]', '["a", "b", "c"]'])
           .select(amenity_count("v")).collect()]
    assert got == [1, 1, 2, 3]


def test_amenity_list_parse(spark):
    got = [r[0] for r in one_col(spark, ['["Wifi", "Kitchen"]', None, "not a list", "['a', 'b']"])
           .select(amenity_list("v")).collect()]
    assert got == [["Wifi", "Kitchen"], [], [], ["a", "b"]]


def test_amenity_flag_is_substring_case_insensitive(spark):
    got = [r[0] for r in one_col(spark, ['["Ironing board"]', '["Kitchen"]', None])
           .select(amenity_flag("v", "Iron")).collect()]
    assert got == [True, False, False]


def test_haversine_null_and_known_distance(spark):
    df = spark.createDataFrame([(None, 2.35), (48.8566, 2.3522), (48.8666, 2.3522)], "lat double, lon double")
    got = [r[0] for r in df.select(haversine_km("lon", "lat", 2.3522, 48.8566)).collect()]
    assert got[0] is None
    assert got[1] == 0.0
    assert abs(got[2] - 1.1119) < 1e-3


def test_date_text(spark):
    got = [r[0] for r in one_col(spark, ["2024-02-29", "2024-02-30", "garbage", None]).select(date_text("v")).collect()]
    assert str(got[0]).startswith("2024-02-29") and got[1:] == [None, None, None]


def test_parsing_matches_a_text_once(spark):
    """No expression that the optimizer copies into filters may hold long chains of regular
    expressions: their generated method then outgrows what the JVM compiles."""
    from rentalytics.functions import date_text, integral_text, numeric_text, truthy_int

    df = spark.createDataFrame([("1",)], "v string")
    for parse, most in ((numeric_text, 2), (integral_text, 1), (truthy_int, 1), (date_text, 1)):
        plan = df.select(parse("v").alias("p"))._jdf.queryExecution().analyzed().toString().lower()
        assert plan.count("rlike") + plan.count("regexp_replace") <= most, parse.__name__


def test_dates_read_by_the_cast_are_those_of_the_pattern(spark):
    from rentalytics.functions import date_text

    texts = [f"{y}-{m:02d}-{d:02d}" for y in ("0000", "0001", "1000", "1582", "1900", "2000", "2023", "2024", "9999")
             for m in (0, 1, 2, 10, 13) for d in (0, 1, 15, 28, 29, 30, 31, 32)] + ["2020-1-02", " 2020-01-02", "2020-01-02\n", "soon", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    by_pattern = F.try_to_date("v", "yyyy-MM-dd").cast("timestamp_ntz")
    assert df.where(~date_text("v").eqNullSafe(by_pattern)).collect() == []


def test_whole_numbers_as_text(spark):
    from rentalytics.functions import integral_text

    want = {"12": 12, " 12.0 ": 12, "1e3": 1000, "12.5": None, "9223372036854775807": 2 ** 63 - 1, "9223372036854775808": None,
            "9e18": None, "-8e18": -8 * 10 ** 18, "inf": None, "nan": None, "1d": None, "": None, "100000000000000223": 100000000000000223}
    df = spark.createDataFrame([(t,) for t in want], "v string")
    assert {r.v: r.n for r in df.select("v", integral_text("v").alias("n")).collect()} == want
