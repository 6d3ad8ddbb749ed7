"""Property: the bounded-memory selection equals Spark's exact percentile."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rentalytics.operators.quantiles import exact_quantiles_many

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False),
                            st.sampled_from([float("inf"), float("-inf"), 1.7e308, -1.7e308, 5e-324])),
                  min_size=1, max_size=60)
probs = st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), min_size=1, max_size=3, unique=True)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values, probs, st.integers(2, 5), st.integers(1, 8))
def test_selection_equals_percentile(spark, vals, ps, buckets, final_rows):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles_many(df, {"x": ps}, final_rows=final_rows, buckets=buckets)["x"]
    expect = df.agg(F.percentile("x", ps).alias("p")).first().p
    if expect is None:
        assert got == [None] * len(ps)
    else:
        assert repr(got) == repr(list(expect))  # NaN between two infinities on both sides


def test_extreme_ranges_end(spark):
    infinity = float("inf")
    rows = [(float(i),) for i in range(1000)] + [(infinity,), (-infinity,), (1.7e308,), (-1.7e308,), (5e-324,)]
    df = spark.createDataFrame(rows, "x double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    direct = exact_quantiles_many(df, {"x": probs})["x"]
    for final_rows in (1, 8):
        assert exact_quantiles_many(df, {"x": probs}, final_rows=final_rows)["x"] == direct
    assert direct == list(df.agg(F.percentile("x", probs).alias("p")).first().p)


def test_each_series_is_looked_up_not_searched(spark):
    """A value meets the brackets of its own series only, by a join on the series."""
    from rentalytics.operators import quantiles as Q

    values = spark.createDataFrame([(0, 1.0), (0, 5.0), (1, 1.0), (1, 5.0), (2, 1.0)], "c int, v double")
    brackets = [F.struct(F.lit(c).alias("of"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                for c, lo, hi in ((0, 0.0, 2.0), (0, 1.0, 9.0), (1, 4.0, 5.0))]
    hits = Q._inside(values, brackets)
    assert sorted((r.c, r.v, r.lo) for r in hits.collect()) == [(0, 1.0, 0.0), (0, 1.0, 1.0), (0, 5.0, 1.0), (1, 5.0, 4.0)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "lambda" not in plan
