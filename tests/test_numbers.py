from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ebbtide.functions.numbers import parse_number, plain_number, round_half_even, to_fixed

FINITE = st.floats(-1e6, 1e6, allow_nan=False)
HALFWAY = st.integers(-10**7, 10**7).map(lambda k: k / 10000)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(FINITE, HALFWAY, HALFWAY.map(lambda x: x + 0.00005)), min_size=200, max_size=200))
def test_rounding_matches_the_exact_decimal(spark, numbers):
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = df.select("x", round_half_even(F.col("x"), 4).alias("r"), to_fixed(F.col("x"), 3).alias("f")).collect()
    for x, rounded, fixed in got:
        assert rounded == round(x, 4)
        exact = abs(Decimal(x)).quantize(Decimal("0.001"), ROUND_HALF_UP)
        assert fixed == f"{'-' if x < 0 else ''}{exact}"


def test_halfway_points_of_rounded_magnitudes(spark):
    df = spark.range(20000).selectExpr("id / 10000D AS x").select("x", to_fixed(F.col("x"), 3).alias("f"))
    for x, fixed in df.collect():
        assert fixed == str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP))


def test_plain_number(spark):
    expected = {0.0: "0", 1.0: "1", 95.0: "95", 0.42: "0.42", 0.002: "0.002", 100.5: "100.5",
                0.0001: "0.0001", 1e7: "10000000", 1.25e9: "1250000000", 1e-7: "1e-7",
                1.5e-7: "1.5e-7", 1e21: "1e+21", -3.0: "-3"}
    df = spark.createDataFrame([(x,) for x in expected], "x double")
    assert dict(df.select("x", plain_number(F.col("x"))).collect()) == expected


def test_parse_number_reads_numbers_only(spark):
    expected = {"1": 1.0, " 2.5 ": 2.5, "+3": 3.0, "-.5": -0.5, "1e3": 1000.0, "5.": 5.0,
                "1d": None, "0x10": None, "": None, "abc": None, "1,5": None, "Infinity": float("inf")}
    df = spark.createDataFrame([(x,) for x in expected], "x string")
    assert dict(df.select("x", F.expr(parse_number("x"))).collect()) == expected
