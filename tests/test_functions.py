import math

from pyspark.sql import functions as F

from loanrisk.functions import num


def one(spark, expr, value, schema="x double"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_dround_ties_match_sql_rounding(spark):
    df = spark.createDataFrame([(0.00015,), (0.00145,), (0.00465,)], "x double")
    got = [r[0] for r in df.select(num.dround("x", 4)).collect()]
    assert got == [0.0001, 0.0014, 0.0046]
    plain = [r[0] for r in df.select(F.round("x", 4)).collect()]
    assert plain == [0.0002, 0.0015, 0.0047]   # why dround exists


def test_text_parsers(spark):
    assert one(spark, num.first_number("x"), " 36 months", "x string") == 36.0
    assert one(spark, num.first_number("x"), "< 1 year", "x string") == 1.0
    assert one(spark, num.first_number("x"), "10+ years", "x string") == 10.0
    assert one(spark, num.first_number("x"), "none", "x string") is None
    assert one(spark, num.percent_strict("x"), "13.56%", "x string") == 13.56
    assert one(spark, num.percent_lenient("x"), "bad", "x string") is None
    assert one(spark, num.percent_lenient("x"), "nan", "x string") is None
    assert one(spark, num.grade_number("x"), "C", "x string") == 3.0
    assert one(spark, num.grade_number("x"), "X", "x string") is None
    assert one(spark, num.null_token("x"), "n/a", "x string") is None
    assert one(spark, num.null_token("x"), "RENT", "x string") == "RENT"


def test_month_parsing(spark):
    import datetime as dt
    assert one(spark, num.month_date("x"), "Jan-2015", "x string") == dt.date(2015, 1, 1)
    assert one(spark, num.month_date_lenient("x"), "garbage", "x string") is None


def test_income_bands_right_closed(spark):
    df = spark.createDataFrame([(40000.0,), (40000.01,), (0.0,), (100000.0,), (100000.5,)], "x double")
    got = [r[0] for r in df.select(num.income_band("x")).collect()]
    assert got == ["<40k", "40-70k", None, "70-100k", ">100k"]
    names = [r[0] for r in spark.createDataFrame([("<40k",), (">100k",), ("40-70k",)], "s string")
             .select(num.metric_safe("s")).collect()]
    assert names == ["lt40k", "gt100k", "40_70k"]


def test_score_scaling(spark):
    assert abs(num.FACTOR - 28.8539) < 1e-4 and abs(num.OFFSET - 684.9586) < 1e-4
    pts = one(spark, num.integer_points(num.log_odds_to_points("x")), 0.0)
    assert pts == 685
    x = 1.3
    s = num.OFFSET + num.FACTOR * x
    pub = one(spark, num.points_to_pd("x"), s)
    assert abs(pub - (1 - 1 / (1 + math.exp(-x)))) < 1e-12
    cons = one(spark, num.points_to_pd_consistent("x"), s)
    assert abs(cons - 1 / (1 + math.exp(-x))) < 1e-12
    # numpy-style half-to-even
    assert one(spark, num.integer_points("x"), 2.5) == 2
    assert one(spark, num.integer_points("x"), 3.5) == 4


def test_categorical_encodings(spark):
    df = spark.createDataFrame([(12.0, "MORTGAGE"), (3.0, "OWN"), (1.0, "RENT"), (0.5, "ANY"),
                                (None, None)], "y double, h string")
    got = df.select(num.emp_stability("y"), num.home_ownership_code("h")).collect()
    assert [tuple(r) for r in got] == [("senior", 3), ("established", 2), ("early", 1),
                                        ("new", 0), ("new", 0)]
    iv = spark.createDataFrame([(0.31,), (0.3,), (0.11,), (0.05,), (0.01,)], "v double")
    assert [r[0] for r in iv.select(num.iv_strength("v")).collect()] == [
        "strong", "medium", "medium", "weak", "useless"]


def test_dround_equals_sql_round_on_random_doubles(spark):
    """Property: dround(x, k) == SQL ROUND(x, k) (DuckDB) on many doubles,
    including exact binary ties and values near them."""
    import duckdb
    import numpy as np
    rng = np.random.default_rng(7)
    xs = np.concatenate([
        rng.integers(0, 10**6, 3000) / 10**5 + 5e-5,      # decimal ties at 4 digits
        rng.random(3000) * 100 - 50,                      # arbitrary values
        np.array([0.00015, 0.00145, 0.00465, 2.5e-05, -0.00015, 1.00005]),
    ])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for k in (2, 3, 4):
        got = [r[0] for r in df.select(num.dround("x", k)).collect()]
        con = duckdb.connect()
        want = [r[0] for r in con.execute(
            f"SELECT round(x, {k}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs.tolist()]).fetchall()]
        assert got == want
