"""Distributed evaluation metrics.

Everything starts from the *score ladder*: one row per distinct
(group, score) with its positive / negative counts and the counts strictly
below it. Ties collapse to one row during partial aggregation, so a hot
score value never becomes a hot task.

The running counts are exact and parallel:

1. ``groupBy(group, score)`` -> distinct scores with counts;
2. split each group's score axis into ``buckets`` ranges of roughly equal
   numbers of distinct scores (``percentile_approx`` boundaries per group)
   and find each score's range by a binary search written with built-in
   array lookups;
3. totals per (group, range): at most ``buckets`` rows per group, cumulated
   with a window over that small frame and broadcast back;
4. the running count inside each range by a window partitioned by
   (group, range) - each range holds about 1/``buckets`` of the distinct
   scores, so no task gets a whole group.

AUC, KS, exact quantiles, calibration bins and the CDF table are then plain
aggregates over the ladder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanrisk.functions.num import dround, income_band, metric_safe
from loanrisk.sources.io import staged

# --- fixed values -----------------------------------------------------------
CALIBRATION_BINS = 10        # quantile bins of the calibration error
KS_CURVE_POINTS = 200        # thresholds 0..1 of the KS / CDF table
SEGMENT_MIN_ROWS = 50        # a segment needs more rows than this ...
# ... and both classes, for its Gini to be reported.
# ---------------------------------------------------------------------------

DEFAULT_BUCKETS = None    # -> 4 x spark.sql.shuffle.partitions, at least 8
MAX_BROADCAST_CELLS = 2_000_000   # groups x ranges above this: plain (shuffle) join


def default_buckets(df: DataFrame) -> int:
    """Ranges only need to spread the running counts over the tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, 4 * parts)


def power_of_two(n: int) -> int:
    size = 2
    while size < n:
        size *= 2
    return size


def bucket_of(d: DataFrame, score: str, splits: F.Column, size: int) -> DataFrame:
    """Binary search: how many of the ``size`` sorted splits lie strictly below
    the score, in log2(size) array lookups (built-in expressions, no UDF).

    Each step is its own projection of the previous index (a nested
    expression would double in size per step)."""
    d = d.withColumn("_bucket", F.lit(0))
    step = size // 2
    while step >= 1:
        b = F.col("_bucket")
        d = d.withColumn("_bucket", F.when(F.element_at(splits, b + step) < F.col(score), b + step)
                         .otherwise(b))
        step //= 2
    return d


def _with_bucket(d: DataFrame, score: str, by: list[str], buckets: int) -> DataFrame:
    """Attach a range index with about equal numbers of distinct scores per
    range, computed per group (groups may live on different scales).

    Splits are ``percentile_approx`` over the distinct scores, padded with
    +inf to a power of two. Without groups they are one bounded array, inlined
    as a literal; with groups they are one row per group, broadcast (bounded
    by the number of groups, e.g. features or income bands, x ``buckets``).
    """
    size = power_of_two(max(buckets, 2))
    probs = [i / size for i in range(1, size)]
    q = F.percentile_approx(F.col(score), probs, 10 * size)
    if not by:
        row = d.agg(q.alias("s")).first()
        vals = [float(x) for x in (row["s"] or [])] + [float("inf")]
        vals += [float("inf")] * (size - len(vals))
        d = d.withColumn("_splits", F.lit(vals))
        return bucket_of(d, score, F.col("_splits"), size).drop("_splits")
    sp = d.groupBy(*by).agg(F.concat(q, F.array(F.lit(float("inf")))).alias("_splits"))
    return bucket_of(d.join(small_side(sp, size), by), score, F.col("_splits"), size).drop("_splits")


def small_side(df: DataFrame, per_row: int = 1) -> DataFrame:
    """Store a per-group frame, and broadcast it only if its size allows.

    ``df`` has ``per_row`` numbers in a row; its rows are counted from the stored
    table's footers. Above MAX_BROADCAST_CELLS numbers it joins by shuffle.
    """
    df = staged(df, "ladder-groups")
    return F.broadcast(df) if df.count() * per_row <= MAX_BROADCAST_CELLS else df


def distinct_scores(df: DataFrame, score: str = "p", label: str = "y",
                    by: list[str] | None = None) -> DataFrame:
    """(by, score) -> pos, neg: ties collapse here, with map-side partial sums."""
    y = F.col(label).cast("long")
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(*(by or []), score)
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
            .withColumn(score, F.col(score).cast("double")))


def score_ladder(df: DataFrame, score: str = "p", label: str = "y",
                 by: list[str] | None = None, buckets: int | None = DEFAULT_BUCKETS,
                 collapsed: bool = False) -> DataFrame:
    """Distinct (by, score) rows with pos, neg, cnt, and running counts.

    Columns: by..., score, pos, neg, cnt, pos_lt, neg_lt, n_lt, n_le,
    n_pos, n_neg, n (group totals). ``collapsed``: the input already is
    ``distinct_scores`` output; else the distinct scores are stored in the shared
    folder first, so the input is read once. ``by`` is for low-cardinality groups
    (features, income bands): per-group range splits and range totals are
    broadcast, so their size is groups x ``buckets``.
    """
    by = list(by or [])
    buckets = buckets or default_buckets(df)
    d = df if collapsed else staged(distinct_scores(df, score, label, by), "ladder-scores")
    d = _with_bucket(d, score, by, buckets)

    # Per-range totals: at most len(splits) - 1 rows per group.
    tot = d.groupBy(*by, "_bucket").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offs = tot.select(
        *by, "_bucket",
        F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_pos_before"),
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_neg_before"),
        F.sum("_bp").over(whole).alias("n_pos"),
        F.sum("_bn").over(whole).alias("n_neg"),
    )
    # One row per (group, range), four numbers each.
    d = d.join(small_side(offs, 4), [*by, "_bucket"])
    inside = (Window.partitionBy(*by, "_bucket").orderBy(score)
              .rowsBetween(Window.unboundedPreceding, -1))
    pos_lt = F.col("_pos_before") + F.coalesce(F.sum("pos").over(inside), F.lit(0))
    neg_lt = F.col("_neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    return (d.select(*by, score, "pos", "neg", pos_lt.alias("pos_lt"), neg_lt.alias("neg_lt"),
                     "n_pos", "n_neg")
            .withColumns({"cnt": F.col("pos") + F.col("neg"),
                          "n": F.col("n_pos") + F.col("n_neg")})
            .withColumn("n_lt", F.col("pos_lt") + F.col("neg_lt"))
            .withColumn("n_le", F.col("n_lt") + F.col("cnt")))


def _rank_aggs() -> list[F.Column]:
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    tpr_fpr = F.when(both, (F.col("n_pos") - F.col("pos_lt")) / F.col("n_pos")
                     - (F.col("n_neg") - F.col("neg_lt")) / F.col("n_neg"))
    num = F.sum((F.col("pos").cast("decimal(38,0)")
                 * (F.col("neg_lt") * 2 + F.col("neg")).cast("decimal(38,0)")))
    return [num.alias("_num"), F.max("n_pos").alias("positives"),
            F.max("n_neg").alias("negatives"), F.max(tpr_fpr).alias("_ks")]


def _rank_finals(gini_digits: int = 4, auc_digits: int = 4) -> list[F.Column]:
    auc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                 F.col("_num").cast("double")
                 / (F.col("positives").cast("double") * F.col("negatives").cast("double") * 2.0))
    return [
        F.col("positives").cast("long").alias("positives"),
        F.col("negatives").cast("long").alias("negatives"),
        dround(auc, auc_digits).alias("auc"),
        dround(auc * 2 - 1, gini_digits).alias("gini"),
        F.when(auc.isNotNull(), dround(F.greatest(F.col("_ks"), F.lit(0.0)), 4)).alias("ks"),
    ]


def rank_metrics(ladder: DataFrame, by: list[str] | None = None, gini_digits: int = 4,
                 auc_digits: int = 4) -> DataFrame:
    """AUC (ties count half), Gini, KS per group, plus class counts.

    AUC = sum(pos * (2 neg_lt + neg)) / (2 n_pos n_neg), summed exactly as decimals.
    KS  = max(0, max over thresholds of TPR - FPR) at thresholds score >= s.
    """
    by = list(by or [])
    return ladder.groupBy(*by).agg(*_rank_aggs()).select(*by, *_rank_finals(gini_digits, auc_digits))


def _quantile_aggs(qs: list[float], score: str) -> list[F.Column]:
    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("n") - 1) * F.lit(float(q))
        lo = F.floor(h)
        hi = F.least(F.ceil(h), F.col("n") - 1)
        aggs += [F.min(F.when(F.col("n_le") > lo, F.col(score))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("n_le") > hi, F.col(score))).alias(f"_hi{i}"),
                 F.max(h - lo).alias(f"_d{i}")]
    return aggs


def _quantile_finals(qs: list[float]) -> list[F.Column]:
    return [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_d{i}")).alias(f"q{i}")
            for i in range(len(qs))]


def quantile_edges(ladder: DataFrame, qs: list[float], score: str = "p",
                   by: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group (like quantile_cont).

    The value at 0-based rank r is min(score) over rows with n_le > r, so
    each quantile is two conditional minima in one aggregate.
    """
    by = list(by or [])
    return ladder.groupBy(*by).agg(*_quantile_aggs(qs, score)).select(*by, *_quantile_finals(qs))


def calibration_table(ladder: DataFrame, edges: list[float], score: str = "p") -> DataFrame:
    """M14 curve: bin = number of inner edges strictly below the score.

    Returns (bin, rows, mean_predicted, observed_rate) for non-empty bins;
    ``calibration_curve`` rounds it for display.
    """
    b = F.lit(0)
    for e in edges:
        b = b + F.when(F.col(score) > F.lit(float(e)), 1).otherwise(0)
    t = (ladder.withColumn("bin", b).groupBy("bin")
         .agg(F.sum("cnt").alias("rows"),
              F.sum(F.col(score) * F.col("cnt")).alias("_sp"),
              F.sum("pos").alias("_sy")))
    return t.select("bin", F.col("rows").cast("long").alias("rows"),
                    (F.col("_sp") / F.col("rows")).alias("mean_predicted"),
                    (F.col("_sy") / F.col("rows")).alias("observed_rate"))


def calibration_curve(table: DataFrame, digits: int = 6) -> DataFrame:
    return table.select("bin", "rows", dround("mean_predicted", digits).alias("mean_predicted"),
                        dround("observed_rate", digits).alias("observed_rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Unweighted mean |observed - predicted| over non-empty bins, round 4."""
    return table.agg(dround(F.avg(F.abs(F.col("observed_rate") - F.col("mean_predicted"))), 4)
                     .alias("calibration_error"))


def inner_calibration_edges(ladder: DataFrame, score: str = "p",
                            n_bins: int = CALIBRATION_BINS) -> list[float]:
    """The n_bins - 1 inner quantile edges (a bounded collect of n_bins - 1 values)."""
    qs = [i / n_bins for i in range(1, n_bins)]
    row = quantile_edges(ladder, qs, score).first()
    return [float(row[f"q{i}"]) for i in range(len(qs)) if row[f"q{i}"] is not None]


def ks_curve(ladder: DataFrame, score: str = "p", points: int = KS_CURVE_POINTS) -> DataFrame:
    """Share of each class with score <= t, for t = j / (points - 1).

    Each distinct score goes to the first threshold at or above it; per
    threshold counts (<= ``points`` rows) are cumulated with a small window.
    """
    step = 1.0 / (points - 1)
    s = F.col(score)
    c = F.least(F.greatest(F.ceil(s * (points - 1)).cast("int"), F.lit(0)), F.lit(points - 1))
    c = F.when((c > 0) & (s <= (c - 1) * F.lit(step)), c - 1).otherwise(c)
    c = F.when(s > c * F.lit(step), c + 1).otherwise(c)
    first = ladder.withColumn("j", c).where(F.col("j") < points)
    per = first.groupBy("j").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    grid = ladder.sparkSession.range(points).select(F.col("id").cast("int").alias("j"))
    # The grid has ``points`` rows, so these windows run over a bounded frame.
    upto = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    g = grid.join(per, "j", "left").withColumns({
        "_tot_pos": F.sum("_p").over(every), "_tot_neg": F.sum("_n").over(every)})
    return g.select(
        "j",
        (F.col("j") * F.lit(step)).alias("threshold"),
        dround(F.try_divide(F.coalesce(F.sum("_n").over(upto), F.lit(0)), F.col("_tot_neg")), 6)
        .alias("cdf_non_default"),
        dround(F.try_divide(F.coalesce(F.sum("_p").over(upto), F.lit(0)), F.col("_tot_pos")), 6)
        .alias("cdf_default"),
    )


def evaluate(scored: DataFrame, score: str = "p", label: str = "y",
             buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """One row with gini, ks, auc, calibration error, actual and predicted rate
    (nulls for an empty hold-out).

    Three jobs: range splits, one aggregate (rank metrics, rates, edges),
    calibration bins. Cached frames are recomputable from lineage if an
    executor is lost.
    """
    # The scoring pipeline upstream runs once: distinct scores are cached
    # (at most one row per distinct score) and feed both ladder passes.
    d = distinct_scores(scored, score, label).cache()
    lad = score_ladder(d, score, label, buckets=buckets, collapsed=True).cache()
    qs = [i / CALIBRATION_BINS for i in range(1, CALIBRATION_BINS)]
    # One pass: rank metrics, class rates and the calibration edges.
    rates = [F.sum("pos").alias("_sp"), F.sum("cnt").alias("_sc"),
             F.sum(F.col(score) * F.col("cnt")).alias("_spc")]
    one = lad.agg(*_rank_aggs(), *rates, *_quantile_aggs(qs, score)).select(
        *_rank_finals(),
        dround(F.col("_sp") / F.col("_sc"), 4).alias("default_rate_actual"),
        dround(F.col("_spc") / F.col("_sc"), 4).alias("default_rate_predicted"),
        *_quantile_finals(qs)).first().asDict()
    edges = [float(e) for e in (one.pop(f"q{i}") for i in range(len(qs))) if e is not None]
    ce = calibration_error(calibration_table(lad, edges, score)).first().asDict()
    lad.unpersist()
    d.unpersist()
    return scored.sparkSession.createDataFrame([{**one, **ce}], METRIC_SCHEMA)


METRIC_SCHEMA = (
    "gini double, ks double, auc double, calibration_error double, "
    "default_rate_actual double, default_rate_predicted double, positives long, negatives long")


def segment_gini(scored: DataFrame, segment: F.Column, score: str = "p", label: str = "y",
                 min_rows: int = SEGMENT_MIN_ROWS, buckets: int | None = DEFAULT_BUCKETS) -> DataFrame:
    """Gini (3 decimals) per segment with > min_rows rows and both classes."""
    s = scored.withColumn("segment", segment).where(F.col("segment").isNotNull())
    lad = score_ladder(s, score, label, by=["segment"], buckets=buckets)
    rm = rank_metrics(lad, by=["segment"], gini_digits=3)
    rows = F.col("positives") + F.col("negatives")
    return (rm.where((rows > min_rows) & (F.col("positives") > 0) & (F.col("negatives") > 0))
            .select("segment", F.concat(F.lit("gini_"), metric_safe("segment")).alias("metric_name"),
                    rows.alias("rows"), "gini"))


def segment_spread(seg: DataFrame) -> DataFrame:
    """Max - min segment Gini."""
    return seg.agg(F.count(F.lit(1)).alias("segments"),
                   F.max("gini").alias("max_gini"), F.min("gini").alias("min_gini"),
                   dround(F.max("gini") - F.min("gini"), 3).alias("spread"))


def income_band_gini(scored: DataFrame, income: str = "annual_inc", **kw) -> DataFrame:
    return segment_gini(scored, income_band(income), **kw)
