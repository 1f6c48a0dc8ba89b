"""Isotonic calibration without a list of knots on the driver.

*Fit.* Equal scores are grouped first (rows, positives), so a score that many loans
share is one block. Sorted blocks are cut into ranges of ``RANGE_BLOCKS``, and each
range pools its adjacent violators in a fold over one row. Only blocks at the ends of
ranges can still violate: while some do, the blocks that are left are ranked and cut
anew at other places, so that touching blocks meet in a range. Pooling is associative,
and the fit does not depend on where the cuts were. The driver sees the number of
blocks and of violations in a round.

*Lookup.* The fit is a table of knots in sorted ranges, at most ``MAX_RANGES`` of them.
A score finds its range by binary search in the array of the ranges' first knots (one
row, bounded), joins that range's arrays, and finds its two knots there by a second
binary search: linear between, flat outside. Ranges are broadcast only when their size
was checked; beyond that they join by shuffle, and a range that many rows hit is split
by the skew join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanrisk.operators.metrics import small_side
from loanrisk.sources.io import staged

RANGE_BLOCKS = 1024    # blocks that are pooled in one fold
RANGE_KNOTS = 1024     # knots of a range of the lookup, at least
MAX_RANGES = 4096      # ranges of the lookup, at most

_ROW_BITS = (1 << 33) - 1   # monotonically_increasing_id: partition << 33 | row


def ranked(df: DataFrame, *order: str, drop: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Adds ``rank``, the position in ``order`` from 0: a place in a range partition
    plus the rows of the partitions before it (a number a partition). ``drop``: columns
    that only the order needs; they are not stored."""
    at = F.monotonically_increasing_id()
    held = staged(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit(_ROW_BITS))}).drop(*drop), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return (held.join(F.broadcast(parts), "_part").withColumn("rank", F.col("_before") + F.col("_row"))
            .drop("_part", "_row", "_before"))


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def pool(blocks: Column) -> Column:
    """Pool adjacent violators of sorted blocks (lo, hi, w, s: scores from lo to hi,
    rows, positives).

    A fold with a stack of pooled blocks that carry the running sums (w, s). A block
    whose mean is not above the last one's is pooled with all blocks behind the point
    of the running sums from which the slope to the new sums is largest: the tangent
    to the convex minorant."""
    stack = "array<struct<lo: double, hi: double, w: bigint, s: bigint>>"
    zero = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("s"))

    def sums(stack_, k):
        return F.when(k > 0, F.struct(F.get(stack_, k - 1)["w"].alias("w"), F.get(stack_, k - 1)["s"].alias("s"))).otherwise(zero)

    def slope(a, b):
        return (b["s"] - a["s"]) / (b["w"] - a["w"])

    def joined(acc, x, total):
        places = F.transform(F.sequence(F.lit(0), F.size(acc)), lambda k: F.struct(slope(sums(acc, k), total).alias("slope"), (-k).alias("back")))
        return _let(-F.array_max(places)["back"], lambda keep: F.concat(F.slice(acc, F.lit(1), keep), F.array(F.struct(
            F.coalesce(F.get(acc, keep)["lo"], x["lo"]).alias("lo"), x["hi"].alias("hi"), total["w"].alias("w"), total["s"].alias("s")))))

    def push(acc, x):
        def grown(total):
            n = F.size(acc)
            rises = (n == 0) | (slope(sums(acc, n - 1), sums(acc, n)) < x["s"] / x["w"])
            block = F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), total["w"].alias("w"), total["s"].alias("s"))
            return F.when(rises, F.concat(acc, F.array(block))).otherwise(joined(acc, x, total))
        before = sums(acc, F.size(acc))
        return _let(F.struct((before["w"] + x["w"]).alias("w"), (before["s"] + x["s"]).alias("s")), grown)

    return _let(F.aggregate(blocks, F.array().cast(stack), push), lambda out: F.transform(out, lambda b, k: F.struct(
        b["lo"].alias("lo"), b["hi"].alias("hi"), (b["w"] - sums(out, k)["w"]).alias("w"), (b["s"] - sums(out, k)["s"]).alias("s"))))


def _pool_ranges(blocks: DataFrame, shift: int, size: int) -> DataFrame:
    """``lo, hi, w, s, range`` after pooling within ranges of ``size`` ranks."""
    whole = blocks.groupBy(F.floor((F.col("rank") + shift) / size).alias("range")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "w", "s"))).alias("blocks"))   # at most ``size``
    return whole.select("range", F.explode(pool(F.col("blocks"))).alias("b")).select("range", "b.*")


def _touching(blocks: DataFrame) -> int:
    """Neighbouring ranges whose touching blocks violate; over a row a range."""
    mean = F.col("s") / F.col("w")
    ends = blocks.groupBy("range").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    return ends.withColumn("before", F.lag("last").over(Window.orderBy("range"))).where("before >= first").count()


def isotonic_blocks(cal: DataFrame, score: str, label: str, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """M9: ``lo, hi, w, s``: the pooled blocks of the isotonic fit of a 0/1 label."""
    x, y = F.col(score).cast("double"), F.col(label).cast("long")
    blocks = (cal.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("lo"))
              .agg(F.count(F.lit(1)).alias("w"), F.sum(y).alias("s")).select("lo", F.col("lo").alias("hi"), "w", "s"))
    turn = 0
    while True:
        blocks = ranked(blocks, "lo")
        # another cut each time, so that two blocks part at most by chance again
        pooled = staged(_pool_ranges(blocks, turn * 389 % range_blocks, range_blocks), "pooled")
        if not _touching(pooled):
            return pooled.drop("range")
        blocks, turn = pooled.drop("range"), turn + 1


@dataclass
class Knots:
    """A monotone calibration as a table of sorted knots ``at, value``, with the
    sorted arrays of its ``ranges`` made when first used."""
    table: DataFrame

    @staticmethod
    def of_blocks(blocks: DataFrame) -> "Knots":
        """A knot at each end of a block."""
        mean = F.col("s") / F.col("w")
        ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
        return Knots(staged(blocks.select(F.explode(ends).alias("at"), mean.alias("value")), "knots"))

    @staticmethod
    def of_lists(spark: SparkSession, at: list[float], value: list[float]) -> "Knots":
        return Knots(spark.createDataFrame(list(zip(at, value)), "at double, value double"))

    @cached_property
    def lookup(self) -> tuple[DataFrame, DataFrame, int, int]:
        """The ranges (number, arrays of knots and the next range's first), their
        first knots in one row, and the largest lengths of both."""
        n = self.table.count()
        per_range = max(RANGE_KNOTS, -(-n // MAX_RANGES))
        number = F.expr(f"CAST(rank div {per_range} AS INT)")
        ranges = (ranked(self.table, "at").groupBy(number.alias("_range"))
                  .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("knots")))
        after = F.lead(F.element_at("knots", 1)).over(Window.orderBy("_range"))   # a row a range
        ranges = ranges.withColumn("_after", after).select("_range", F.when(
            F.col("_after").isNull(), F.col("knots")).otherwise(F.concat("knots", F.array("_after"))).alias("knots"))
        ranges = staged(ranges.select("_range", F.col("knots.at").alias("_at"), F.col("knots.value").alias("_value")), "knot-ranges")
        first = staged(ranges.agg(F.array_sort(F.collect_list(F.element_at("_at", 1))).alias("_first")), "knot-first")
        return ranges, first, per_range + 1, max(1, -(-n // per_range))

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """``df`` with ``out``, the calibrated ``score``; null for null, and for all
        where there are no knots."""
        ranges, first, most_knots, n_ranges = self.lookup
        d = df.withColumn("_x", F.col(score).cast("double")).crossJoin(F.broadcast(first))   # one row of at most MAX_RANGES numbers
        d = d.withColumn("_range", F.greatest(_search(F.col("_first"), F.col("_x"), n_ranges) - 1, F.lit(0))).drop("_first")
        d = d.join(small_side(ranges, 2 * most_knots), "_range", "left").withColumn("_k", _search(F.col("_at"), F.col("_x"), most_knots))
        k = F.col("_k")
        low, high = F.get("_at", k - 1), F.get("_at", k)
        below, above = F.get("_value", k - 1), F.get("_value", k)
        between = below + (F.col("_x") - low) / (high - low) * (above - below)
        p = (F.when(F.col("_x").isNull(), F.lit(None).cast("double")).when(k == 0, F.get("_value", F.lit(0)))
             .when(k >= F.size("_at"), F.element_at("_value", -1)).otherwise(between))
        return d.withColumn(out, p).drop("_x", "_range", "_at", "_value", "_k")


def _search(sorted_: Column, x: Column, size: int) -> Column:
    """Binary search: how many of the sorted numbers (at most ``size``) are not above
    ``x``. A fold over the steps: as a chain of projections it would double with each
    step when a filter on the result is pushed through them."""
    steps = [1]
    while 2 * steps[0] <= size:
        steps.insert(0, 2 * steps[0])
    return F.aggregate(F.lit(steps), F.lit(0), lambda k, step: F.when(
        F.get(sorted_, k + step - 1) <= x, k + step).otherwise(k))   # null behind the end


def isotonic(cal: DataFrame, score: str, label: str = "default_flag") -> Knots:
    """M9: isotonic fit of the label on one score column (ties pooled, flat ends)."""
    return Knots.of_blocks(isotonic_blocks(cal, score, label))
