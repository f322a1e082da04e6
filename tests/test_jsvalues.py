"""JavaScript value semantics: Number(), parseInt(), Math.round()."""

import pytest
from pyspark.sql import functions as F

from usagelens.functions import js_round, to_int, to_num


def _eval(spark, col_fn, values, tp="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {tp}")
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_to_num(spark):
    vals = ["", "  ", "1.5", " 2 ", ".5", "1.", "1e-3", "-4", "+7", "1.5d", "inf", "NaN", "0x10", "abc", None]
    got = _eval(spark, to_num, vals)
    assert got == [0.0, 0.0, 1.5, 2.0, 0.5, 1.0, 0.001, -4.0, 7.0, None, None, None, None, None, None]


def test_to_int(spark):
    vals = ["12.7", "12abc", "1e3", "", "true", "-5", " 42 ", "+3", None, "abc12"]
    got = _eval(spark, to_int, vals)
    assert got == [12, 12, 1, None, None, -5, 42, 3, None, None]


@pytest.mark.parametrize("x,d,want", [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -2.0), (0.125, 2, 0.13),
                                      (19.5, 0, 20.0), (1234.56785, 4, 1234.5679)])
def test_js_round(spark, x, d, want):
    got = spark.range(1).select(js_round(F.lit(x), d).alias("r")).first()["r"]
    assert got == pytest.approx(want, abs=1e-12)


def test_money_sum_is_order_independent(spark):
    from usagelens.functions import money_sum

    vals = [(0.1,), (0.2,), (0.3,)] * 1000
    a = spark.createDataFrame(vals, "x double").agg(money_sum("x")).first()[0]
    b = spark.createDataFrame(list(reversed(vals)), "x double").repartition(7).agg(money_sum("x")).first()[0]
    assert a == b == 600.0


@pytest.mark.parametrize("raw,want", [(None, 50), ("", 50), ("abc", 50), ("0", 50), ("-5", 50), ("12.7", 12),
                                      (" 7x", 7), (900, 900), ("500", 500), (20, 20)])
def test_feed_limit(raw, want):
    from usagelens.operators.feed import feed_limit

    assert feed_limit(raw) == want
