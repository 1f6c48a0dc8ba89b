"""Isotonic calibration: pooled in ranges, looked up in ranges."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from loanrisk.operators import calibration
from loanrisk.operators.calibration import Knots


def brute(rows):
    """(score, label) -> [lo, hi, rows, positives] by pooling with a stack."""
    groups = {}
    for x, y in rows:
        if x is not None and y is not None:
            n, s = groups.get(x, (0, 0))
            groups[x] = n + 1, s + y
    stack = []
    for x in sorted(groups):
        stack.append([x, x, *groups[x]])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, hi, w, s = stack.pop()
            stack[-1] = [stack[-1][0], hi, stack[-1][2] + w, stack[-1][3] + s]
    return stack


def cases():
    rng = random.Random(3)
    yield [(rng.random(), int(rng.random() < 0.3)) for _ in range(1500)]                    # no trend
    yield [(x / 700, int(rng.random() < x / 700)) for x in range(700)]                       # rising
    yield [(x / 400, int(rng.random() > x / 400)) for x in range(400)] + [(2.0, 1)]          # falling: one block, then a rise
    yield [(float(x), 1) for x in range(300)] + [(300.0, 0)] * 5000                          # the last score pools everything
    yield [(rng.choice([0.1, 0.5, 0.9]), rng.randrange(2)) for _ in range(500)] + [(None, 1), (0.3, None)]
    yield [(0.5, 1)]
    yield []


@pytest.mark.parametrize("case", range(7))
def test_pooling_in_ranges(spark, case):
    """Whatever the size of a range, the blocks are those of one stack over all rows."""
    rows = list(cases())[case]
    df = spark.createDataFrame(rows, "s double, y int").repartition(4)
    for size in (8, 1024):
        got = calibration.isotonic_blocks(df, "s", "y", range_blocks=size)
        assert [list(r) for r in got.select("lo", "hi", "w", "s").orderBy("lo").collect()] == brute(rows)


def test_lookup(spark, monkeypatch):
    """Between, on and outside knots, over several ranges; as a broadcast and as a join."""
    rng = random.Random(1)
    at = sorted(rng.sample(range(1000), 90))
    value = sorted(rng.random() for _ in at)
    knots = Knots.of_lists(spark, [float(a) for a in at], value)
    x = [None, -5.0, 2000.0, *map(float, at), *[rng.uniform(-10, 1010) for _ in range(300)]]
    df = spark.createDataFrame([(v, "kept") for v in x], "x double, other string")

    def want(v):
        k = bisect.bisect_right(at, v)
        if k in (0, len(at)):
            return value[0] if k == 0 else value[-1]
        return value[k - 1] + (v - at[k - 1]) / (at[k] - at[k - 1]) * (value[k] - value[k - 1])

    for per_range, most, cells in ((1024, 4096, 2_000_000), (7, 4096, 2_000_000), (7, 4096, 0), (1, 20, 0)):
        monkeypatch.setattr(calibration, "RANGE_KNOTS", per_range)
        monkeypatch.setattr(calibration, "MAX_RANGES", most)
        monkeypatch.setattr("loanrisk.operators.metrics.MAX_BROADCAST_CELLS", cells)
        out = Knots(knots.table).apply(df, "x", "p")
        assert out.columns == ["x", "other", "p"]
        got = out.collect()
        assert len(got) == len(x)
        assert all(r.p is None if r.x is None else r.p == pytest.approx(want(r.x), abs=1e-12) for r in got)


def test_no_knots(spark):
    empty = calibration.isotonic(spark.createDataFrame([], "s double, default_flag int"), "s")
    assert [tuple(r) for r in empty.apply(spark.createDataFrame([(1.0,), (None,)], "x double"), "x", "p").collect()] == [(1.0, None), (None, None)]


def test_plan_holds_no_knots(spark):
    """The size of the plan does not grow with the knots."""
    def plan(n):
        knots = Knots(spark.range(n).select(F.col("id").cast("double").alias("at"), (F.col("id") / n).alias("value")))
        return knots.apply(spark.range(10).withColumn("x", F.col("id") / 3), "x", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert abs(len(plan(50)) - len(plan(900))) < 200


def test_filters_on_the_result_plan_fast(spark):
    import time
    knots = Knots.of_lists(spark, [float(a) for a in range(50)], [a / 50 for a in range(50)])
    began = time.time()
    out = knots.apply(spark.range(10).withColumn("x", F.col("id") / 3), "x", "p").where("p IS NOT NULL").groupBy("p").count().where("p > 0")
    assert out.count() == 9 and time.time() - began < 60
