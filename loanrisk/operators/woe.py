"""Weight-of-evidence binning and information value.

Fit, all features at once:

1. ``unpivot`` the training frame to (feature, value, y);
2. exact quantile pre-bin edges per feature from the score ladder
   (``metrics.quantile_edges`` grouped by feature) - distributed;
3. pre-bin counts: ``groupBy(feature, prebin)`` -> at most
   (prebins + 1) rows per feature, whatever the row count;
4. ``optimal_bins``: of all ways to join neighbouring pre-bins into at most
   ``max_bins`` bins with the least share of rows and a monotone event rate, the
   one with the largest IV, by dynamic programming as a fold over one row a feature
   and direction. Missing values form their own bin.

Only final bins (features x at most ``max_bins`` rows) reach the driver. Transform
is one CASE expression per feature (narrow, codegen).

WoE = ln((good_i / GOOD) / (bad_i / BAD)), an empty cell counting 0.5,
IV = sum((good_i / GOOD - bad_i / BAD) * WoE_i). Higher WoE = safer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.functions.num import dround, iv_strength
from loanrisk.operators import metrics
from loanrisk.sources.io import staged

# --- fixed values -----------------------------------------------------------
MAX_BINS = 10
MIN_BIN_SIZE = 0.05
MIN_IV = 0.1
PREBINS = 20
EMPTY_CELL = 0.5
# Scorecard candidate features (origination + months 1-6 behaviour).
SCORECARD_FEATURES = [
    "loan_amnt", "int_rate", "term_months", "installment",
    "annual_inc", "dti", "revol_util", "revol_bal",
    "delinq_2yrs", "open_acc", "pub_rec", "total_acc",
    "emp_length_years", "loan_to_income", "payment_to_income",
    "avg_payment_ratio_m6", "min_payment_ratio_m6",
    "payment_volatility_m6", "active_months_m6",
    "payment_trend_m6", "first_month_ratio",
]
# ---------------------------------------------------------------------------

MISSING = -1


def unpivot(df: DataFrame, features: list[str], label: str = "default_flag") -> DataFrame:
    """(feature, value, y) rows, values as double."""
    d = df.select(F.col(label).alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    return d.unpivot("y", features, "feature", "value")


def prebin_edges(long: DataFrame, prebins: int = PREBINS) -> DataFrame:
    """Per feature: sorted distinct inner quantile edges (an array column), linear
    interpolated from the score ladder, as SQL ``quantile_cont`` computes them."""
    qs = [i / prebins for i in range(1, prebins)]
    lad = metrics.score_ladder(long.withColumn("y", F.col("y").cast("int")), "value", "y",
                               by=["feature"])
    e = metrics.quantile_edges(lad, qs, "value", by=["feature"])
    return e.select("feature", F.array_sort(F.array_distinct(
        F.array(*[F.col(f"q{i}") for i in range(len(qs))]))).alias("edges"))


def padded_edges(most: int) -> F.Column:
    """``edges`` (at most ``most``) filled up for the binary search with NaN, which is
    below nothing."""
    size = metrics.power_of_two(most + 1)
    return F.concat("edges", F.array_repeat(F.lit(float("nan")), F.lit(size) - F.size("edges")))


def with_prebin(d: DataFrame, most: int) -> DataFrame:
    """Adds ``prebin``, the number of sorted ``edges`` (at most ``most``) strictly below
    ``value``; MISSING for null. A binary search, as every value of every feature passes
    here, in ``_padded`` where ``d`` has it: the edges filled up before they were joined."""
    if "_padded" not in d.columns:
        d = d.withColumn("_padded", padded_edges(most))
    return (metrics.bucket_of(d, "value", F.col("_padded"), metrics.power_of_two(most + 1))
            .withColumn("prebin", F.when(F.col("value").isNull(), F.lit(MISSING)).otherwise(F.col("_bucket")))
            .drop("_padded", "_bucket"))


def prebin_counts(long: DataFrame, edges: DataFrame, prebins: int = PREBINS) -> DataFrame:
    """groupBy(feature, prebin): good / bad counts. Edges are one row per
    feature (bounded by the feature list), filled up there and broadcast."""
    edges = edges.select("feature", padded_edges(prebins - 1).alias("_padded"))
    b = with_prebin(long.join(F.broadcast(edges), "feature"), prebins - 1)
    return b.groupBy("feature", "prebin").agg(F.sum(F.lit(1) - F.col("y")).alias("good"), F.sum("y").alias("bad"))


@dataclass
class Bin:
    hi: float | None          # inclusive upper edge (None = +inf)
    good: int
    bad: int


@dataclass
class FeatureBins:
    feature: str
    bins: list[Bin]
    missing: Bin | None
    total_good: int
    total_bad: int
    missing_woe: float = 0.0
    woe: list[float] = field(default_factory=list)
    iv: float = 0.0


def _woe(g: int, b: int, G: int, B: int) -> float:
    """Only an empty cell is smoothed."""
    return math.log(((g or EMPTY_CELL) / G) / ((b or EMPTY_CELL) / B))


def _iv(bins: list[Bin], G: int, B: int) -> float:
    return sum((x.good / G - x.bad / B) * _woe(x.good, x.bad, G, B) for x in bins)


# ---------------------------------------------------------------- optimal bins

#: IV is compared in these units, as whole numbers: sums do not depend on rounding.
IV_UNITS = 10 ** 10


def _let(value: F.Column, then) -> F.Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def interval_cells(pre: F.Column, G: F.Column, B: F.Column, min_rows: F.Column) -> F.Column:
    """For each end j = 1..m and start i = 0..j-1 the interval of pre-bins i+1..j:
    its event rate, and its IV in units (null where it has too few rows)."""
    def upto(name):
        return F.aggregate(pre, F.array(F.lit(0).cast("long")), lambda acc, p: F.concat(
            acc, F.array(F.element_at(acc, -1) + p[name])))

    def cell(good, bad, whole):
        term = (good / G - bad / B) * woe_expr(good, bad, G, B)
        return F.struct(
            (bad / (good + bad)).alias("rate"),
            F.when(whole | (good + bad >= min_rows), F.round(term * IV_UNITS).cast("long")).alias("units"))

    m = F.size(pre)
    return _let(F.struct(upto("good").alias("g"), upto("bad").alias("b")), lambda s: F.transform(
        F.sequence(F.lit(1), m), lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: cell(
            F.get(s["g"], j) - F.get(s["g"], i), F.get(s["b"], j) - F.get(s["b"], i), (i == 0) & (j == m)))))


def best_cuts(cells: F.Column, direction: F.Column, max_bins: int) -> F.Column:
    """The best ends of bins as ``(units, cuts)``, by dynamic programming.

    A state is the last bin (its start i and end j) at a number of bins, and holds
    the best (units, cuts) that reach it with event rates rising in ``direction``.
    A fold over the number of bins makes each layer of states from the one before:
    a bin i..j follows any bin that ends at i and whose rate is no larger. Ties: fewer
    bins, then the later cuts."""
    state = "struct<units: bigint, cuts: array<int>, rate: double>"

    def first(row, j):
        return F.transform(row, lambda c, i: F.when((i == 0) & c["units"].isNotNull(), F.struct(
            c["units"].alias("units"), F.array(j + 1).alias("cuts"), (c["rate"] * direction).alias("rate"))).cast(state))

    def following(layer, c, i, j):
        before = F.filter(F.get(layer, i - 1), lambda s: s.isNotNull() & (s["rate"] <= c["rate"] * direction))
        return F.when((i > 0) & c["units"].isNotNull(), _let(F.array_max(before), lambda s: F.when(s.isNotNull(), F.struct(
            (s["units"] + c["units"]).alias("units"), F.concat(s["cuts"], F.array(j + 1)).alias("cuts"),
            (c["rate"] * direction).alias("rate"))).cast(state)))

    def whole(layer):
        return F.array_max(F.filter(F.element_at(layer, -1), lambda s: s.isNotNull()))

    def step(acc, _):
        layer = F.transform(cells, lambda row, j: F.transform(row, lambda c, i: following(acc["layer"], c, i, j)))
        return _let(layer, lambda new: F.struct(new.alias("layer"), _let(whole(new), lambda s: F.when(
            s.isNotNull() & (acc["best"].isNull() | (s["units"] > acc["best"]["units"])), s).otherwise(acc["best"])).alias("best")))

    start = _let(F.transform(cells, first), lambda layer: F.struct(layer.alias("layer"), whole(layer).alias("best")))
    if max_bins == 1:
        return start["best"]
    return F.aggregate(F.sequence(F.lit(2), F.lit(max_bins)), start, step, lambda acc: acc["best"])


def optimal_bins(counts: DataFrame, max_bins: int = MAX_BINS, min_bin_size: float = MIN_BIN_SIZE) -> DataFrame:
    """From pre-bin counts (feature, prebin, good, bad): ``feature, bin, last_prebin,
    good, bad, G, B`` of the bins with the largest IV.

    Every bin but one that holds all pre-bins has ``min_bin_size`` of all rows
    (missing ones included); event rates are monotone, rising or falling (equal
    rates may follow each other); of two directions with equal IV the one with fewer
    bins, then the rising one. Rows of missing values (prebin -1) come back as bin -1.
    """
    some = F.col("prebin") >= 0
    whole = counts.groupBy("feature").agg(
        F.greatest(F.sum("good"), F.lit(1)).alias("G"), F.greatest(F.sum("bad"), F.lit(1)).alias("B"),
        # at most one entry a pre-bin
        F.array_sort(F.collect_list(F.when(some, F.struct("prebin", "good", "bad")))).alias("pre"))
    both = (whole.where(F.size("pre") > 0)
            .withColumn("cells", interval_cells(F.col("pre"), F.col("G"), F.col("B"), F.lit(min_bin_size) * (F.col("G") + F.col("B"))))
            .withColumn("direction", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))))
    each = both.select("feature", "G", "B", "pre", "direction", best_cuts(F.col("cells"), F.col("direction"), max_bins).alias("best"))
    chosen = each.groupBy("feature").agg(F.max_by(F.struct("G", "B", "pre", "best"), F.struct(
        F.col("best.units"), -F.size("best.cuts"), "direction")).alias("c")).select("feature", "c.*")
    # the pre-bins between two cuts, joined
    ends = chosen.select("feature", "G", "B", "pre", "best.cuts", F.posexplode("best.cuts").alias("bin", "end"))
    part = F.slice("pre", F.coalesce(F.get("cuts", F.col("bin") - 1), F.lit(0)) + 1,
                   F.col("end") - F.coalesce(F.get("cuts", F.col("bin") - 1), F.lit(0)))
    total = lambda name: F.aggregate(part, F.lit(0).cast("long"), lambda acc, p: acc + p[name])
    bins = ends.select("feature", "bin", F.element_at(part, -1)["prebin"].alias("last_prebin"), total("good").alias("good"),
                       total("bad").alias("bad"), "G", "B")
    missing = (counts.where(~some).join(whole.select("feature", "G", "B"), "feature")
               .select("feature", F.lit(MISSING).alias("bin"), F.lit(MISSING).alias("last_prebin"), "good", "bad", "G", "B"))
    return bins.unionByName(missing)


def fit(train: DataFrame, features: list[str], label: str = "default_flag",
        max_bins: int = MAX_BINS, min_bin_size: float = MIN_BIN_SIZE,
        prebins: int = PREBINS, missing_woe: float = 0.0) -> dict[str, FeatureBins]:
    """M1 + M2: bins and IV for every feature.

    Edges (features x prebins numbers) and the bins that were chosen (features x at
    most ``max_bins`` + 1 rows) reach the driver.
    """
    long = unpivot(train, features, label)
    edges = staged(prebin_edges(long, prebins), "woe-edges")
    counts = staged(prebin_counts(long, edges, prebins), "woe-counts")
    return merged(counts, {r["feature"]: [float(x) for x in r["edges"]] for r in edges.collect()}, features,
                  max_bins, min_bin_size, missing_woe)


def merged(counts: DataFrame, edges: dict[str, list[float]], features: list[str], max_bins: int = MAX_BINS,
           min_bin_size: float = MIN_BIN_SIZE, missing_woe: float = 0.0) -> dict[str, FeatureBins]:
    """The optimal bins of the features, with their upper edges and WoE."""
    rows = [r.asDict() for r in optimal_bins(counts, max_bins, min_bin_size).orderBy("feature", "bin").collect()]
    return {f: _feature_bins(f, [r for r in rows if r["feature"] == f], edges.get(f, []), missing_woe) for f in features}


def _feature_bins(feature: str, rows: list[dict], cuts: list[float], missing_woe: float) -> FeatureBins:
    """From rows (last_prebin, good, bad) in order. An empty pre-bin extends the
    range of the bin on its right."""
    G = sum(int(r["good"]) for r in rows) or 1
    B = sum(int(r["bad"]) for r in rows) or 1
    at = [(r["last_prebin"], int(r["good"]), int(r["bad"])) for r in rows]
    bins = [Bin(cuts[p] if p < len(cuts) else None, g, b) for p, g, b in at if p != MISSING]
    missing = [Bin(None, g, b) for p, g, b in at if p == MISSING]
    fb = FeatureBins(feature, bins, missing[0] if missing else None, G, B, missing_woe)
    fb.woe = [_woe(x.good, x.bad, G, B) for x in bins]
    fb.iv = _iv(bins + missing, G, B)
    return fb


def iv_summary(spark, fitted: dict[str, FeatureBins]) -> DataFrame:
    """M3: feature, iv, strength, sorted by iv descending (ties by name)."""
    rows = [(f, float(b.iv)) for f, b in fitted.items()]
    df = spark.createDataFrame(rows, "feature string, iv double")
    return (df.withColumn("strength", iv_strength("iv"))
            .orderBy(F.desc("iv"), "feature"))


def selected_features(fitted: dict[str, FeatureBins], min_iv: float = MIN_IV) -> list[str]:
    """M4: IV >= min_iv, in the original feature order."""
    return [f for f, b in fitted.items() if b.iv >= min_iv]


def woe_column(fb: FeatureBins) -> F.Column:
    """One CASE per feature: null -> missing WoE, else the first bin whose upper edge holds."""
    v = F.col(fb.feature).cast("double")
    if not fb.bins:
        return F.lit(fb.missing_woe)
    expr = F.when(v.isNull(), F.lit(fb.missing_woe))
    for b, w in zip(fb.bins, fb.woe):
        expr = expr.when(v <= F.lit(b.hi), F.lit(w)) if b.hi is not None else expr.otherwise(F.lit(w))
    if fb.bins[-1].hi is not None:
        expr = expr.otherwise(F.lit(fb.woe[-1]))
    return expr


def transform(df: DataFrame, fitted: dict[str, FeatureBins], features: list[str] | None = None,
              keep: list[str] | None = None) -> DataFrame:
    """M5: ``<feature>_woe`` columns; unknown features raise."""
    features = features or list(fitted)
    for f in features:
        if f not in fitted:
            raise ValueError(f"no bins were fitted for {f!r}")
    return df.select(*(keep or []), *[woe_column(fitted[f]).alias(f"{f}_woe") for f in features])


def from_counts(rows: list[dict], edges: dict[str, list[float]], missing_woe: float = 0.0) -> dict[str, FeatureBins]:
    """Bins as counted, without merging: rows (feature, prebin, good, bad)."""
    return {f: _feature_bins(f, sorted(({**r, "last_prebin": r["prebin"]} for r in rows if r["feature"] == f),
                                       key=lambda r: r["prebin"]), cuts, missing_woe)
            for f, cuts in edges.items()}


def to_spec(fitted: dict[str, FeatureBins]) -> list[dict]:
    """Plain values that ``from_spec`` turns back into the same bins."""
    return [{"feature": f, "bins": [[b.hi, b.good, b.bad] for b in fb.bins], "woe": fb.woe, "iv": fb.iv,
             "missing": [fb.missing.good, fb.missing.bad] if fb.missing else None,
             "total_good": fb.total_good, "total_bad": fb.total_bad, "missing_woe": fb.missing_woe}
            for f, fb in fitted.items()]


def from_spec(spec: list[dict]) -> dict[str, FeatureBins]:
    return {s["feature"]: FeatureBins(s["feature"], [Bin(*b) for b in s["bins"]],
                                      Bin(None, *s["missing"]) if s["missing"] else None, s["total_good"],
                                      s["total_bad"], s["missing_woe"], s["woe"], s["iv"]) for s in spec}


def bin_table(spark, fitted: dict[str, FeatureBins]) -> DataFrame:
    """The fitted bins as a table (feature, bin, upper edge, counts, woe)."""
    rows = []
    for f, fb in fitted.items():
        for i, (b, w) in enumerate(zip(fb.bins, fb.woe)):
            rows.append((f, i, b.hi, b.good, b.bad, float(w)))
        if fb.missing:
            rows.append((f, MISSING, None, fb.missing.good, fb.missing.bad, float(fb.missing_woe)))
    return spark.createDataFrame(
        rows, "feature string, bin int, upper double, good long, bad long, woe double")


# ---------------------------------------------------------------- fixed bins


def woe_expr(good: F.Column, bad: F.Column, G: float, B: float) -> F.Column:
    cell = lambda n: F.when(n == 0, F.lit(EMPTY_CELL)).otherwise(n)
    return F.log((cell(good) / G) / (cell(bad) / B))


def fixed_bins(train: DataFrame, features: list[str], label: str = "default_flag",
               n_bins: int = 10) -> dict[str, FeatureBins]:
    """Exact quantile bins without merging, for the transform: features x bins
    rows reach the driver."""
    long = unpivot(train, features, label)
    edges = prebin_edges(long, n_bins).cache()
    counts = [r.asDict() for r in prebin_counts(long, edges, n_bins).collect()]
    cuts = {r["feature"]: [float(x) for x in r["edges"]] for r in edges.collect()}
    edges.unpersist()
    return from_counts(counts, {f: cuts.get(f, []) for f in features})


def fixed_bin_iv(train: DataFrame, features: list[str], label: str = "default_flag",
                 n_bins: int = 10) -> DataFrame:
    """Fixed quantile bins (no merging) -> WoE per bin -> IV per feature.

    Fully distributed and reproducible in SQL: the oracle-checked core of M1/M2.
    """
    long = unpivot(train, features, label)
    edges = prebin_edges(long, n_bins)
    c = prebin_counts(long, edges, n_bins)
    tot = train.agg(F.sum(F.lit(1) - F.col(label)).alias("G"), F.sum(label).alias("B"))
    # Totals are one row: gather the two numbers (bounded) instead of a cross join.
    t = tot.first()
    G, B = float(t["G"]), float(t["B"])
    woe = woe_expr(F.col("good"), F.col("bad"), G, B)
    term = (F.col("good") / G - F.col("bad") / B) * woe
    return (c.groupBy("feature").agg(dround(F.sum(term), 6).alias("iv"),
                                     F.count(F.lit(1)).alias("bins"))
            .withColumn("strength", iv_strength("iv"))
            .orderBy(F.desc("iv"), "feature"))
