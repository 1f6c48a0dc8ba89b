"""Evaluation, split, scoring and modelling queries.

Metric queries score the hold-out loans with a fixed closed-form score
(no model needed, many ties): p = round(((k * 7919) % 2000) / 2000, 3),
k = loan id. Model queries (scorecard, boosted trees, neural net) train on
the mature vintages and report hold-out metrics; they have no SQL twin. What a
model is made of has one where it can: bins without merging, WoE columns, fill and
scaling statistics, oversampling, isotonic knots, and scores from given ones.

The metric, split and WoE builders start jobs of their own (range splits, bin
counts, class cuts) before they return a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.functions.num import (FACTOR, OFFSET, dround, integer_points,
                                    log_odds_to_points, points_to_pd, points_to_pd_consistent,
                                    sigmoid)
import os

from loanrisk.operators import importance, metrics, models, split, woe
from loanrisk.operators.calibration import isotonic
from loanrisk.plans.registry import register, sql_over
from loanrisk.plans.tables import MATERIALIZE_LOCK
from loanrisk.session import session_key
from loanrisk.sources import io

# ------------------------------------------------------------ scored frame


def fixture_score(key: str = "loan_id") -> F.Column:
    k = F.col(key).cast("long")
    return dround(((k * 7919) % 2000) / F.lit(2000.0), 3)


def split_cuts(t) -> dict:
    """The class cuts, found once per table set."""
    with MATERIALIZE_LOCK:
        if "split_cuts" not in t.__dict__:
            t.__dict__["split_cuts"] = split.stratified_cuts(split.mature(t.model_features))
    return t.__dict__["split_cuts"]


def split_rows(t, which: str) -> DataFrame:
    """Mature loans of one split."""
    return split.with_split(split.mature(t.model_features), split_cuts(t)).where(F.col("split") == which)


def scored_holdout(t) -> DataFrame:
    """Mature hold-out loans with label y, fixture score p and income."""
    return split_rows(t, "test").select("loan_id", F.col("default_flag").alias("y"),
                    fixture_score().alias("p"), "annual_inc")


_SCORED = ("""
SELECT loan_id, default_flag AS y,
       round(((CAST(loan_id AS BIGINT) * 7919) % 2000) / 2000.0::DOUBLE, 3) AS p, annual_inc
FROM split_features WHERE split = 'test'""", ["split_features"])

# Exact shares per class: the first 20% by hash are test, 15% of the rest cal.
_SPLIT = ("""
SELECT * EXCLUDE (place, n_test, n_class),
  CASE WHEN place <= n_test THEN 'test'
       WHEN place <= n_test + ((n_class - n_test) * 15 + 50) // 100 THEN 'cal' ELSE 'train' END AS split
FROM (SELECT *, (n_class * 20 + 50) // 100 AS n_test
      FROM (SELECT *, row_number() OVER (PARTITION BY default_flag ORDER BY md5(loan_id || '42')) AS place,
                   count(*) OVER (PARTITION BY default_flag) AS n_class
            FROM model_features WHERE issue_year <= 2016) a) b""", ["model_features"])

_LAD = ("""
SELECT p, pos, neg,
  COALESCE(sum(pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_lt,
  COALESCE(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt,
  sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p) d""", ["scored"])

_EXTRA = {"split_features": _SPLIT, "scored": _SCORED, "lad": _LAD}


def _sql(select: str, ctes: list[str] | None = None) -> str:
    return sql_over(ctes or ["lad"], select, _EXTRA)


@register("scored_holdout", _sql("SELECT * FROM scored", ["scored"]))
def scored_holdout_q(t):
    """P10 + M6 (test split) + fixture score."""
    return scored_holdout(t)


@register("rank_metrics", _sql("""
SELECT CAST(n_pos AS BIGINT) AS positives, CAST(n_neg AS BIGINT) AS negatives,
       round(auc, 4) AS auc, round(auc * 2 - 1, 4) AS gini, round(greatest(ks, 0.0), 4) AS ks
FROM (SELECT max(n_pos) AS n_pos, max(n_neg) AS n_neg,
             CAST(sum(CAST(pos AS HUGEINT) * (2 * neg_lt + neg)) AS DOUBLE)
               / (CAST(max(n_pos) AS DOUBLE) * CAST(max(n_neg) AS DOUBLE) * 2.0) AS auc,
             max((n_pos - pos_lt) / n_pos - (n_neg - neg_lt) / n_neg) AS ks
      FROM lad) a"""))
def rank_metrics_q(t):
    """M12 (AUC, Gini), M13 (KS), A16 class counts."""
    lad = metrics.score_ladder(scored_holdout(t))
    return metrics.rank_metrics(lad)


_QS = [i / 10 for i in range(1, 10)]


@register("quantile_edges", _sql(
    "SELECT " + ", ".join(f"round(quantile_cont(p, {q}), 10) AS q{i}" for i, q in enumerate(_QS))
    + " FROM scored", ["scored"]))
def quantile_edges_q(t):
    """Exact deciles of the score (reported to 10 decimals: engines
    differ in the last bit of the interpolation)."""
    lad = metrics.score_ladder(scored_holdout(t))
    e = metrics.quantile_edges(lad, _QS)
    return e.select(*[dround(c, 10).alias(c) for c in e.columns])


_CAL_SQL = """
SELECT bin, CAST(sum(pos + neg) AS BIGINT) AS rows,
       sum(p * (pos + neg)) / sum(pos + neg) AS mean_predicted,
       sum(pos) / sum(pos + neg) AS observed_rate
FROM (SELECT lad.*, """ + " + ".join(
    f"CASE WHEN p > e.q{i} THEN 1 ELSE 0 END" for i in range(9)) + """ AS bin
      FROM lad, (SELECT """ + ", ".join(f"quantile_cont(p, {q}) AS q{i}" for i, q in enumerate(_QS)) + """
                 FROM scored) e) b
GROUP BY bin"""


@register("calibration_curve", _sql(
    "SELECT bin, rows, round(mean_predicted, 6) AS mean_predicted, round(observed_rate, 6) AS observed_rate"
    " FROM (" + _CAL_SQL + ") c ORDER BY bin", ["lad", "scored"]))
def calibration_curve_q(t):
    """M14 curve table (A18 edges, bins, observed vs predicted)."""
    lad = metrics.score_ladder(scored_holdout(t))
    edges = metrics.inner_calibration_edges(lad)
    return metrics.calibration_curve(metrics.calibration_table(lad, edges)).orderBy("bin")


@register("calibration_error", _sql(
    "SELECT round(avg(abs(observed_rate - mean_predicted)), 4) AS calibration_error FROM ("
    + _CAL_SQL + ") c", ["lad", "scored"]))
def calibration_error_q(t):
    """Calibration error."""
    lad = metrics.score_ladder(scored_holdout(t))
    edges = metrics.inner_calibration_edges(lad)
    return metrics.calibration_error(metrics.calibration_table(lad, edges))


@register("ks_curve", _sql("""
SELECT CAST(g.j AS INTEGER) AS j, g.j * (1.0::DOUBLE / 199.0::DOUBLE) AS threshold,
       round(COALESCE(sum(l.neg), 0) / (SELECT sum(neg) FROM lad), 6) AS cdf_non_default,
       round(COALESCE(sum(l.pos), 0) / (SELECT sum(pos) FROM lad), 6) AS cdf_default
FROM range(200) g(j) LEFT JOIN lad l ON l.p <= g.j * (1.0::DOUBLE / 199.0::DOUBLE)
GROUP BY g.j ORDER BY g.j"""))
def ks_curve_q(t):
    """Class CDFs on 200 thresholds (one grouped pass, no rescans)."""
    lad = metrics.score_ladder(scored_holdout(t))
    return metrics.ks_curve(lad).orderBy("j")


@register("evaluation_suite", _sql("""
SELECT r.gini, r.ks, r.auc, c.calibration_error, a.default_rate_actual, a.default_rate_predicted,
       r.positives, r.negatives
FROM (SELECT CAST(n_pos AS BIGINT) AS positives, CAST(n_neg AS BIGINT) AS negatives,
             round(auc, 4) AS auc, round(auc * 2 - 1, 4) AS gini, round(greatest(ks, 0.0), 4) AS ks
      FROM (SELECT max(n_pos) AS n_pos, max(n_neg) AS n_neg,
                   CAST(sum(CAST(pos AS HUGEINT) * (2 * neg_lt + neg)) AS DOUBLE)
                     / (CAST(max(n_pos) AS DOUBLE) * CAST(max(n_neg) AS DOUBLE) * 2.0) AS auc,
                   max((n_pos - pos_lt) / n_pos - (n_neg - neg_lt) / n_neg) AS ks FROM lad) x) r,
     (SELECT round(avg(abs(observed_rate - mean_predicted)), 4) AS calibration_error
      FROM (""" + _CAL_SQL + """) c0) c,
     (SELECT round(sum(pos) / sum(pos + neg), 4) AS default_rate_actual,
             round(sum(p * (pos + neg)) / sum(pos + neg), 4) AS default_rate_predicted FROM lad) a""",
    ["lad", "scored"]))
def evaluation_suite_q(t):
    """The full evaluation row."""
    return metrics.evaluate(scored_holdout(t))


_SEG_SQL = """
SELECT segment, 'gini_' || replace(replace(replace(segment, '<', 'lt'), '>', 'gt'), '-', '_') AS metric_name,
       CAST(n_pos + n_neg AS BIGINT) AS rows, round(auc * 2 - 1, 3) AS gini
FROM (SELECT segment, max(n_pos) AS n_pos, max(n_neg) AS n_neg,
             CAST(sum(CAST(pos AS HUGEINT) * (2 * neg_lt + neg)) AS DOUBLE)
               / (CAST(max(n_pos) AS DOUBLE) * CAST(max(n_neg) AS DOUBLE) * 2.0) AS auc
      FROM (SELECT segment, p, pos, neg,
              COALESCE(sum(neg) OVER (PARTITION BY segment ORDER BY p
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt,
              sum(pos) OVER (PARTITION BY segment) AS n_pos, sum(neg) OVER (PARTITION BY segment) AS n_neg
            FROM (SELECT segment, p, sum(y) AS pos, sum(1 - y) AS neg
                  FROM (SELECT *, CASE WHEN annual_inc > 0 AND annual_inc <= 40000 THEN '<40k'
                                       WHEN annual_inc > 40000 AND annual_inc <= 70000 THEN '40-70k'
                                       WHEN annual_inc > 70000 AND annual_inc <= 100000 THEN '70-100k'
                                       WHEN annual_inc > 100000 THEN '>100k' END AS segment
                        FROM scored) s
                  WHERE segment IS NOT NULL GROUP BY segment, p) d) c
      GROUP BY segment) a
WHERE n_pos + n_neg > 50 AND n_pos > 0 AND n_neg > 0"""


@register("segment_gini", _sql(_SEG_SQL, ["scored"]))
def segment_gini_q(t):
    """M15 with F31 right-closed income bands and F32 metric names."""
    return metrics.income_band_gini(scored_holdout(t))


@register("segment_spread", _sql("""
SELECT count(*) AS segments, max(gini) AS max_gini, min(gini) AS min_gini,
       round(max(gini) - min(gini), 3) AS spread FROM (""" + _SEG_SQL + ") s", ["scored"]))
def segment_spread_q(t):
    """Gini spread across income bands."""
    return metrics.segment_spread(metrics.income_band_gini(scored_holdout(t)))


# ------------------------------------------------------------ split, weights


@register("split_audit", sql_over(["split_features", "model_features"], """
SELECT split, count(*) AS loans, CAST(sum(default_flag) AS BIGINT) AS defaults,
       round(avg(default_flag), 4) AS default_rate
FROM (SELECT default_flag, split FROM split_features
      UNION ALL SELECT default_flag, 'held_out' FROM model_features WHERE issue_year > 2016) s
GROUP BY split ORDER BY split""", _EXTRA))
def split_audit_q(t):
    """R11 (M6, P10)."""
    return split.split_audit(t.model_features, split_cuts(t))


@register("class_weights", sql_over(["split_features"], """
SELECT default_flag, n_class, n / (n_class * 2.0) AS class_weight,
       sum(CASE WHEN default_flag = 0 THEN n_class END) OVER ()
         / sum(CASE WHEN default_flag = 1 THEN n_class END) OVER () AS scale_pos_weight
FROM (SELECT default_flag, count(*) AS n_class, sum(count(*)) OVER () AS n
      FROM split_features WHERE split = 'train' GROUP BY default_flag) c""", _EXTRA))
def class_weights_q(t):
    """M7: balanced class weights and the neg/pos ratio on the training split."""
    return split.class_weights(split_rows(t, "train"))


# ------------------------------------------------------------ scorecard points

_F = repr(FACTOR)
_O = repr(OFFSET)


@register("score_points", sql_over(["model_features"], f"""
SELECT loan_id, x AS log_odds, pts AS points,
  round(1.0 / (1.0 + exp((pts - CAST('{_O}' AS DOUBLE)) / CAST('{_F}' AS DOUBLE))), 6) AS pd_published,
  round(1.0 / (1.0 + exp(-(pts - CAST('{_O}' AS DOUBLE)) / CAST('{_F}' AS DOUBLE))), 6) AS pd_consistent,
  round(1.0 / (1.0 + exp(-x)), 6) AS pd_from_log_odds
FROM (SELECT loan_id, x,
        CAST(round_even(CAST('{_O}' AS DOUBLE) + CAST('{_F}' AS DOUBLE) * x, 0) AS INTEGER) AS pts
      FROM (SELECT loan_id, (int_rate - 15.0) / 5.0 AS x FROM model_features) a) b"""))
def score_points_q(t):
    """Log-odds -> integer points -> PD (published and consistent)."""
    x = (F.col("int_rate") - F.lit(15.0)) / F.lit(5.0)
    s = t.model_features.select("loan_id", x.alias("log_odds"))
    s = s.withColumn("points", integer_points(log_odds_to_points("log_odds")))
    return s.select("loan_id", "log_odds", "points",
                    dround(points_to_pd("points"), 6).alias("pd_published"),
                    dround(points_to_pd_consistent("points"), 6).alias("pd_consistent"),
                    dround(sigmoid("log_odds"), 6).alias("pd_from_log_odds"))



# ------------------------------------------------------------ WoE / IV

_WOE: dict[tuple, dict] = {}

SCORECARD_FEATURES = woe.SCORECARD_FEATURES


def _long_sql(features: list[str], source: str, keep: str) -> str:
    return "\n  UNION ALL ".join(f"SELECT {keep}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}"
                                 for f in features)


_WOE_CELL = "ln((CASE WHEN good = 0 THEN 0.5 ELSE good END / G) / (CASE WHEN bad = 0 THEN 0.5 ELSE bad END / B))"

# A bin for each pre-bin that holds rows.
_UNMERGED = ("""
SELECT feature, CASE WHEN prebin < 0 THEN -1 ELSE row_number() OVER (PARTITION BY feature, prebin < 0 ORDER BY prebin) - 1 END AS bin,
       prebin AS last_prebin, good, bad, G, B FROM counts JOIN totals USING (feature)""", ["counts", "totals"])

# The joined pre-bins of largest IV: states are the last bin at a number of bins, and
# each round puts one bin behind all states that end where it begins.
_OPTIMAL = {
    "placed": ("""
SELECT feature, prebin, good, bad, row_number() OVER (PARTITION BY feature ORDER BY prebin) AS p,
       count(*) OVER (PARTITION BY feature) AS m FROM counts WHERE prebin >= 0""", ["counts"]),
    "spans": ("""
SELECT a.feature, a.p - 1 AS i, z.p AS j, a.m, z.prebin AS last_prebin, CAST(sum(c.good) AS BIGINT) AS good, CAST(sum(c.bad) AS BIGINT) AS bad
FROM placed a JOIN placed z ON z.feature = a.feature AND z.p >= a.p JOIN placed c ON c.feature = a.feature AND c.p BETWEEN a.p AND z.p
GROUP BY a.feature, a.p, z.p, a.m, z.prebin""", ["placed"]),
    "cells": (f"""
SELECT s.*, G, B, bad / CAST(good + bad AS DOUBLE) AS rate, CAST(round((good / G - bad / B) * {_WOE_CELL} * {woe.IV_UNITS}) AS BIGINT) AS units
FROM spans s JOIN totals USING (feature) WHERE (i = 0 AND j = m) OR good + bad >= {woe.MIN_BIN_SIZE} * (G + B)""", ["spans", "totals"]),
    "paths": (f"""
WITH RECURSIVE paths AS (
  SELECT 1 AS k, feature, dir, j, m, rate * dir AS rate, {{'units': units, 'cuts': [j]}} AS best
  FROM cells, (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) d(dir) WHERE i = 0
  UNION ALL
  SELECT s.k + 1, s.feature, s.dir, c.j, c.m, c.rate * s.dir, max({{'units': s.best.units + c.units, 'cuts': list_append(s.best.cuts, c.j)}})
  FROM paths s JOIN cells c ON c.feature = s.feature AND c.i = s.j AND s.rate <= c.rate * s.dir
  WHERE s.k < {woe.MAX_BINS} GROUP BY s.k, s.feature, s.dir, c.i, c.j, c.m, c.rate)
SELECT feature, arg_max(best.cuts, {{'units': best.units, 'bins': -k, 'dir': dir}}) AS cuts FROM paths WHERE j = m GROUP BY feature""", ["cells"]),
    "joined": ("""
SELECT c.feature, list_position(cuts, c.j) - 1 AS bin, last_prebin, good, bad, G, B
FROM paths JOIN cells c USING (feature)
WHERE list_contains(cuts, c.j) AND c.i = CASE WHEN list_position(cuts, c.j) = 1 THEN 0 ELSE cuts[list_position(cuts, c.j) - 1] END
UNION ALL SELECT feature, -1, -1, good, bad, G, B FROM counts JOIN totals USING (feature) WHERE prebin = -1""",
               ["paths", "cells", "counts", "totals"]),
}


def _bin_ctes(features: list[str], n: int, joined: dict) -> dict:
    """``n`` exact quantile bins per feature on the training split, joined by
    ``joined``, with WoE and bounds; and the WoE of every mature loan."""
    cuts = ", ".join(f"quantile_cont(value, {i / n})" for i in range(1, n))
    return {
        **_EXTRA,
        "train": ("SELECT * FROM split_features WHERE split = 'train'", ["split_features"]),
        "long": (_long_sql(features, "train", "default_flag AS y"), ["train"]),
        "edges": (f"SELECT feature, list_sort(list_distinct([{cuts}])) AS edges FROM long WHERE value IS NOT NULL GROUP BY feature", ["long"]),
        "counts": ("""SELECT feature, prebin, CAST(sum(1 - y) AS BIGINT) AS good, CAST(sum(y) AS BIGINT) AS bad
FROM (SELECT l.feature, l.y, CASE WHEN l.value IS NULL THEN -1 ELSE len(list_filter(e.edges, lambda x: x < l.value)) END AS prebin
      FROM long l JOIN edges e USING (feature)) b GROUP BY feature, prebin""", ["long", "edges"]),
        "totals": ("""SELECT feature, CAST(greatest(sum(good), 1) AS DOUBLE) AS G, CAST(greatest(sum(bad), 1) AS DOUBLE) AS B
FROM counts GROUP BY feature""", ["counts"]),
        **joined,
        "bins": (f"""SELECT j.*, {_WOE_CELL} AS woe, (good / G - bad / B) * {_WOE_CELL} AS term, upper,
  lag(upper) OVER (PARTITION BY feature, bin < 0 ORDER BY bin) AS lower, bin = max(bin) OVER (PARTITION BY feature) AS is_last
FROM (SELECT j.*, CASE WHEN bin >= 0 THEN e.edges[last_prebin + 1] END AS upper FROM joined j JOIN edges e USING (feature)) j""",
                 ["joined", "edges"]),
        "ivs": ("""SELECT feature, round(iv, 6) AS iv, bins,
       CASE WHEN round(iv, 6) > 0.3 THEN 'strong' WHEN round(iv, 6) > 0.1 THEN 'medium'
            WHEN round(iv, 6) > 0.02 THEN 'weak' ELSE 'useless' END AS strength
FROM (SELECT feature, sum(term) AS iv, count(*) AS bins FROM bins GROUP BY feature) s""", ["bins"]),
        "mature_long": (_long_sql(features, "(SELECT * FROM model_features WHERE issue_year <= 2016)", "loan_id, default_flag"),
                        ["model_features"]),
        # a value beyond the last edge belongs to the last bin
        "loan_woe": ("""SELECT l.loan_id, l.default_flag, l.feature, CASE WHEN l.value IS NULL THEN 0.0 ELSE b.woe END AS woe
FROM mature_long l LEFT JOIN bins b ON b.feature = l.feature AND b.bin >= 0
  AND (b.lower IS NULL OR l.value > b.lower) AND (b.is_last OR l.value <= b.upper)""", ["mature_long", "bins"]),
    }


_FIXED = _bin_ctes(SCORECARD_FEATURES, 10, {"joined": _UNMERGED})
_MERGED = _bin_ctes(SCORECARD_FEATURES, woe.PREBINS, _OPTIMAL)
_IV_SQL = "SELECT feature, iv, strength FROM ivs ORDER BY iv DESC, feature"
_BINS_SQL = """
SELECT feature, CAST(bin AS INTEGER) AS bin, round(upper, 9) AS upper, good, bad, CASE WHEN bin < 0 THEN 0.0 ELSE round(woe, 9) END AS woe FROM bins"""
_SELECTED_SQL = "SELECT CAST(CASE feature " + " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(
    SCORECARD_FEATURES)) + " END AS INTEGER) AS position, feature, iv FROM ivs WHERE iv >= 0.1"
_TRANSFORM_SQL = "SELECT loan_id, default_flag, " + ", ".join(
    f"round(max(CASE WHEN feature = '{f}' THEN woe END), 9) AS {f}_woe" for f in SCORECARD_FEATURES) + " FROM loan_woe GROUP BY loan_id, default_flag"


def _bin_frame(t, fitted: dict) -> DataFrame:
    b = woe.bin_table(t.spark, fitted)
    return b.select("feature", "bin", dround("upper", 9).alias("upper"), "good", "bad", dround("woe", 9).alias("woe"))


def _selected_frame(t, fitted: dict) -> DataFrame:
    chosen = set(woe.selected_features(fitted))
    rows = [(i, f, float(b.iv)) for i, (f, b) in enumerate(fitted.items()) if f in chosen]
    return t.spark.createDataFrame(rows, "position int, feature string, iv double").withColumn("iv", dround("iv", 6))


def _woe_frame(t, fitted: dict) -> DataFrame:
    w = woe.transform(split.mature(t.model_features), fitted, SCORECARD_FEATURES, keep=["loan_id", "default_flag"])
    return w.select("loan_id", "default_flag", *[dround(f"{f}_woe", 9).alias(f"{f}_woe") for f in SCORECARD_FEATURES])


@register("woe_fixed_bin_iv", sql_over(["ivs"], "SELECT * FROM ivs ORDER BY iv DESC, feature", _FIXED))
def woe_fixed_bin_iv(t):
    """M1 (fixed decile bins, missing apart), M2, M3 strength, O2 ordering."""
    return woe.fixed_bin_iv(split_rows(t, "train"), SCORECARD_FEATURES)


def fixed_bins(t) -> dict:
    """Unmerged decile bins of the scorecard candidates, fit once."""
    key = (session_key(t.spark), t.sf_dir, "fixed")
    with MATERIALIZE_LOCK:
        if key not in _WOE:
            _WOE[key] = woe.fixed_bins(split_rows(t, "train"), SCORECARD_FEATURES)
    return _WOE[key]


def fitted_woe(t) -> dict:
    """Optimal WoE bins of the scorecard candidates on the training split, fit once."""
    key = (session_key(t.spark), t.sf_dir, "optimal")
    with MATERIALIZE_LOCK:
        if key not in _WOE:
            _WOE[key] = woe.fit(split_rows(t, "train"), SCORECARD_FEATURES)
    return _WOE[key]


@register("woe_fixed_bins", sql_over(["bins"], _BINS_SQL, _FIXED))
def woe_fixed_bins(t):
    """M1 bin table of the unmerged bins."""
    return _bin_frame(t, fixed_bins(t))


@register("woe_fixed_selected", sql_over(["ivs"], _SELECTED_SQL, _FIXED))
def woe_fixed_selected(t):
    """M4 on the unmerged bins."""
    return _selected_frame(t, fixed_bins(t))


@register("woe_fixed_transform", sql_over(["loan_woe"], _TRANSFORM_SQL, _FIXED))
def woe_fixed_transform(t):
    """WoE columns of the unmerged bins, of which some are empty, for every mature loan."""
    return _woe_frame(t, fixed_bins(t))


@register("woe_iv_summary", sql_over(["ivs"], _IV_SQL, _MERGED))
def woe_iv_summary(t):
    """M1 (optimal monotone bins), M2, M3, O2: IV per scorecard candidate."""
    return woe.iv_summary(t.spark, fitted_woe(t)).withColumn("iv", dround("iv", 6))


@register("woe_bins", sql_over(["bins"], _BINS_SQL, _MERGED))
def woe_bins(t):
    """M1: the fitted bins (upper edge, counts, WoE) per feature; missing apart."""
    return _bin_frame(t, fitted_woe(t))


@register("woe_selected_features", sql_over(["ivs"], _SELECTED_SQL, _MERGED))
def woe_selected_features(t):
    """M4: features with IV >= 0.1, in the original order."""
    return _selected_frame(t, fitted_woe(t))


@register("woe_transform", sql_over(["loan_woe"], _TRANSFORM_SQL, _MERGED))
def woe_transform(t):
    """WoE columns of all scorecard candidates for every mature loan."""
    return _woe_frame(t, fitted_woe(t))


# ------------------------------------------------------------ given parameters
# --- fixed values -----------------------------------------------------------
GIVEN_COEFFICIENTS = {"int_rate": -0.9, "term_months": -0.4, "annual_inc": -0.3, "dti": -0.2}
GIVEN_INTERCEPT = 0.1
# ---------------------------------------------------------------------------


# M9 by the min-max formula: the fit at a score is the largest, over lower scores a,
# of the smallest mean label between a and any score b from there up.
_KNOTS = {
    "places": ("""SELECT x, y, n, row_number() OVER (ORDER BY x) AS i, sum(y) OVER (ORDER BY x) AS ys, sum(n) OVER (ORDER BY x) AS ns
FROM cal_scores""", ["cal_scores"]),
    "least_means": ("""SELECT a.i AS a, b.i AS i, b.x, min(CAST(b.ys - a.ys + a.y AS DOUBLE) / CAST(b.ns - a.ns + a.n AS DOUBLE)) OVER (
  PARTITION BY a.i ORDER BY b.i DESC) AS least FROM places a JOIN places b ON b.i >= a.i""", ["places"]),
    "knots": ("SELECT x, max(least) AS p FROM least_means GROUP BY x", ["least_means"]),
}


_GIVEN_MARGIN = " + ".join([f"CAST({GIVEN_INTERCEPT} AS DOUBLE)"] + [
    f"CAST({c} AS DOUBLE) * max(CASE WHEN feature = '{f}' THEN woe END)" for f, c in GIVEN_COEFFICIENTS.items()])
_GIVEN = {
    **_FIXED,
    "margins": (f"SELECT loan_id, {_GIVEN_MARGIN} AS margin FROM loan_woe GROUP BY loan_id", ["loan_woe"]),
    "cal_scores": ("""SELECT margin AS x, sum(s.default_flag) AS y, count(*) AS n
FROM split_features s JOIN margins USING (loan_id) WHERE split = 'cal' GROUP BY margin""", ["split_features", "margins"]),
    **_KNOTS,
}


def given_scorer(t) -> models.Scorer:
    """A scorecard from given coefficients and unmerged bins, calibrated on its margins."""
    names = list(GIVEN_COEFFICIENTS)
    s = models.Scorer("scorecard", names, None, {f: fixed_bins(t)[f] for f in names}, list(GIVEN_COEFFICIENTS.values()), GIVEN_INTERCEPT)
    s.knots = isotonic(s.raw(split_rows(t, "cal")), "_raw")
    return s


@register("isotonic_fit", sql_over(["knots"], "SELECT round(x, 9) AS x, round(p, 9) AS p FROM knots", _GIVEN))
def isotonic_fit(t):
    """M9: the isotonic fit at every calibration margin."""
    s = given_scorer(t)
    x = s.raw(split_rows(t, "cal")).select(F.col("_raw").alias("x")).distinct()
    return s.knots.apply(x, "x", "p").select(dround("x", 9).alias("x"), dround("p", 9).alias("p"))


@register("scored_book", sql_over(["margins", "knots"], f"""
SELECT m.loan_id, round(m.margin, 9) AS margin,
  CAST(round_even(CAST('{_O}' AS DOUBLE) + CAST('{_F}' AS DOUBLE) * m.margin, 0) AS INTEGER) AS points,
  round(CASE WHEN lo.x IS NULL THEN (SELECT min(p) FROM knots) WHEN lo.next_x IS NULL THEN lo.p
             ELSE lo.p + (m.margin - lo.x) / (lo.next_x - lo.x) * (lo.next_p - lo.p) END, 7) AS p
FROM margins m ASOF LEFT JOIN (
  SELECT x, p, lead(x) OVER (ORDER BY x) AS next_x, lead(p) OVER (ORDER BY x) AS next_p FROM knots) lo ON m.margin >= lo.x""", _GIVEN))
def scored_book(t):
    """A scorer applied to every mature loan (given
    coefficients, fitted bins and isotonic knots)."""
    s = given_scorer(t).score(split.mature(t.model_features))
    return s.select("loan_id", dround("margin", 9).alias("margin"), "points", dround("p", 7).alias("p"))


# ------------------------------------------------------------ importance
# --- fixed values -----------------------------------------------------------
# A coefficient for every candidate, by its place in the list.
IMPORTANCE_COEFFICIENTS = {f: -(1 + k % 5) / 10 for k, f in enumerate(SCORECARD_FEATURES)}
# ---------------------------------------------------------------------------

_PIVOT = ", ".join(f"max(CASE WHEN feature = '{f}' THEN woe END) AS {f}" for f in IMPORTANCE_COEFFICIENTS)
_SHUFFLED_MARGIN = " + ".join(["CAST(0.0 AS DOUBLE)"] + [
    f"CAST({c} AS DOUBLE) * CASE WHEN s.feature = '{f}' THEN s.woe ELSE p.{f} END" for f, c in IMPORTANCE_COEFFICIENTS.items()])
_IMPORTANCE = {
    **_FIXED,
    "test_woe": ("SELECT w.* FROM loan_woe w JOIN split_features s USING (loan_id) WHERE s.split = 'test'", ["loan_woe", "split_features"]),
    "pivoted": (f"SELECT loan_id, default_flag, {_PIVOT} FROM test_woe GROUP BY loan_id, default_flag", ["test_woe"]),
    # a feature's WoE is a function of its value: shuffling one shuffles the other
    "shuffled": (f"""
SELECT r.loan_id, r.feature, v.woe
FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5(loan_id || ':' || feature || ':{importance.SEED}:row')) AS k FROM test_woe) r
JOIN (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5(loan_id || ':' || feature || ':{importance.SEED}:value')) AS k FROM test_woe) v
  ON r.feature = v.feature AND r.k = v.k
UNION ALL SELECT loan_id, '', NULL FROM pivoted""", ["test_woe", "pivoted"]),
    "shuffled_scores": (f"""
SELECT s.feature, {_SHUFFLED_MARGIN} AS x, sum(p.default_flag) AS pos, sum(1 - p.default_flag) AS neg
FROM shuffled s JOIN pivoted p USING (loan_id) GROUP BY 1, 2""", ["shuffled", "pivoted"]),
    "aucs": ("""
SELECT feature, round(CAST(sum(CAST(pos AS HUGEINT) * (2 * below + neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2.0), 6) AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM shuffled_scores) l GROUP BY feature""", ["shuffled_scores"]),
    "importances": ("""
SELECT a.feature, a.auc, round(w.auc - a.auc, 6) AS auc_drop, row_number() OVER (ORDER BY round(w.auc - a.auc, 6) DESC, a.feature) AS place
FROM aucs a, aucs w WHERE a.feature <> '' AND w.feature = ''""", ["aucs"]),
}


def given_importance(t) -> DataFrame:
    """Permutation importance of the scorer with given coefficients, computed once."""
    if "given_importance" not in t.__dict__:
        scorer = models.Scorer("scorecard", list(IMPORTANCE_COEFFICIENTS), None, fixed_bins(t), list(IMPORTANCE_COEFFICIENTS.values()), 0.0)
        t.__dict__["given_importance"] = importance.permutation_importance(scorer, split_rows(t, "test"), SCORECARD_FEATURES)
    return t.__dict__["given_importance"]


@register("permutation_importance", sql_over(["importances"], f"""
SELECT CAST(place AS INTEGER) AS rank, feature, auc, auc_drop FROM importances WHERE place <= {models.IMPORTANCE_TOP}""", _IMPORTANCE))
def permutation_importance(t):
    """The features whose shuffling costs a given scorer most AUC on the hold-out."""
    return importance.top(given_importance(t), models.IMPORTANCE_TOP)


@register("iv_permutation_agreement", sql_over(["importances", "ivs"], """
SELECT feature, coalesce(i.feature IS NOT NULL, false) AS in_iv_top, coalesce(p.feature IS NOT NULL, false) AS in_importance_top
FROM (SELECT feature FROM ivs ORDER BY iv DESC, feature LIMIT 5) i
FULL JOIN (SELECT feature FROM importances WHERE place <= 5) p USING (feature)""", _IMPORTANCE))
def iv_permutation_agreement(t, k: int = 5):
    """Features in the first k by IV and in the first k by permutation importance."""
    iv = woe.iv_summary(t.spark, fixed_bins(t)).withColumn("iv", dround("iv", 6)).orderBy(F.desc("iv"), "feature").limit(k)
    first = importance.top(given_importance(t), k)
    return (iv.select("feature", F.lit(True).alias("a")).join(first.select("feature", F.lit(True).alias("b")), "feature", "full")
            .select("feature", F.coalesce("a", F.lit(False)).alias("in_iv_top"), F.coalesce("b", F.lit(False)).alias("in_importance_top")))


@register("scaling_stats", sql_over(["filled"], """
SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM filled GROUP BY feature""",
    {**_EXTRA, "train": ("SELECT * FROM split_features WHERE split = 'train'", ["split_features"]),
     "filled": ("\n  UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce(CAST({f} AS DOUBLE), 0.0) AS value FROM train"
                                      for f in models.CHALLENGER_FEATURES), ["train"])}))
def scaling_stats(t):
    """Mean and deviation of the filled training features."""
    s = models.scaling_stats(split_rows(t, "train"), models.CHALLENGER_FEATURES)
    return s.select("feature", dround("mean", 6).alias("mean"), dround("std", 6).alias("std"))


@register("oversampled_rows", sql_over(["split_features"], """
SELECT default_flag, count(*) AS loans, CAST(sum(copies) AS BIGINT) AS rows
FROM (SELECT default_flag, CASE WHEN default_flag = 1 THEN
        floor(ratio) + CASE WHEN CAST('0x' || substr(md5(loan_id || 'os'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
                                 < ratio - floor(ratio) THEN 1 ELSE 0 END ELSE 1 END AS copies
      FROM (SELECT *, count(*) FILTER (WHERE default_flag = 0) OVER ()
                      / CAST(count(*) FILTER (WHERE default_flag = 1) OVER () AS DOUBLE) AS ratio
            FROM split_features WHERE split = 'train') a) b
GROUP BY default_flag""", _EXTRA))
def oversampled_rows(t):
    """Training rows before and after the positives are replicated."""
    train = split_rows(t, "train")
    ratio = split.class_weights(train).select(F.col("scale_pos_weight").alias("ratio")).first()["ratio"]
    return (train.withColumn("_copies", models.oversample_copies(ratio)).groupBy("default_flag")
            .agg(F.count(F.lit(1)).alias("loans"), F.sum("_copies").cast("long").alias("rows")))


# ------------------------------------------------------------ trained models
# Models are trained once per session and source folder, then shared by the
# queries that report on them (metrics, scores, importance, run log).


_TRAINED: dict[tuple[str, str, str], models.Trained] = {}
_LOGS: dict[tuple[str, str], models.RunLog] = {}


def trained(t, name: str) -> models.Trained:
    key = (session_key(t.spark), t.sf_dir, name)
    with MATERIALIZE_LOCK:
        if key not in _TRAINED:
            log = _LOGS.setdefault(key[:2], models.RunLog())
            kw = {"fitted": fitted_woe(t)} if name == "scorecard" else {}
            _TRAINED[key] = models.train(name, t.model_features, log=log, cuts=split_cuts(t), **kw)
    return _TRAINED[key]


def run_log(t, names=("scorecard", "boosted_trees", "neural_net")) -> DataFrame:
    """The three runs' log, written to the session's table folder and read back."""
    for n in names:
        trained(t, n)
    return stored_log(t, _LOGS[(session_key(t.spark), t.sf_dir)], "run_log")


def stored_log(t, log: models.RunLog, name: str) -> DataFrame:
    path = os.path.join(io.table_root(t.spark, t.tag), name)
    with MATERIALIZE_LOCK:
        if not hasattr(log, "stored"):
            log.append_to(t.spark, path)
            log.stored = path
    return models.read_log(t.spark, log.stored)


def _metrics_row(t, name: str) -> DataFrame:
    tr = trained(t, name)
    return t.spark.createDataFrame([tr.metrics], metrics.METRIC_SCHEMA)


@register("scorecard_gradient", sql_over(["ivs"], """
SELECT feature, 0.0 AS gradient FROM ivs WHERE iv >= 0.1 UNION ALL SELECT 'intercept', 0.0""", _MERGED))
def scorecard_gradient(t):
    """M4, M8: the fitted scorecard is where the loss is least: a zero gradient for every
    selected feature and the intercept."""
    g = models.scorecard_gradient(trained(t, "scorecard").scorer, split_rows(t, "train"))
    return g.select("feature", F.abs(dround("gradient", 4)).alias("gradient"))


@register("scorecard_holdout")
def scorecard_holdout(t):
    """Champion scorecard hold-out metrics."""
    return _metrics_row(t, "scorecard")


@register("scorecard_scores")
def scorecard_scores(t):
    """Calibrated PD, margin and integer points per hold-out loan."""
    return trained(t, "scorecard").scored


@register("boosted_trees_holdout")
def boosted_trees_holdout(t):
    """M17 + M9 + M16: boosted-tree challenger hold-out metrics."""
    return _metrics_row(t, "boosted_trees")


@register("boosted_trees_importance")
def boosted_trees_importance(t):
    """Top-15 features by importance."""
    return models.importance_frame(t.spark, trained(t, "boosted_trees").extra["importance"])


@register("boosted_trees_permutation")
def boosted_trees_permutation(t):
    """The challenger's top-15 features by permutation importance on the hold-out."""
    scorer = trained(t, "boosted_trees").scorer
    return importance.top(importance.permutation_importance(scorer, split_rows(t, "test"), scorer.features), models.IMPORTANCE_TOP)


@register("boosted_trees_segment_gini")
def boosted_trees_segment_gini(t):
    """M15 on the challenger's calibrated hold-out scores."""
    return metrics.income_band_gini(trained(t, "boosted_trees").scored)


@register("neural_net_holdout")
def neural_net_holdout(t):
    """M20, M21 (+ M9, M16): perceptron challenger hold-out metrics."""
    return _metrics_row(t, "neural_net")


@register("neural_net_loss_history")
def neural_net_loss_history(t):
    """Training objective per iteration."""
    h = trained(t, "neural_net").extra["loss_history"]
    return t.spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(h)],
                                   "iteration int, loss double")


@register("run_log")
def run_log_q(t):
    """Params, tags and metrics of the three runs."""
    return run_log(t)


@register("model_comparison")
def model_comparison(t):
    """Runs side by side with the delta vs the champion."""
    return models.comparison(run_log(t))


@register("promotion_decision")
def promotion_decision(t):
    """Challenger eligible when Gini > champion Gini + 0.02."""
    return models.promotion(run_log(t))


@register("iv_importance_agreement")
def iv_importance_agreement(t, k: int = 5):
    """Features shared by the top-k IV ranking and the top-k importance ranking."""
    sc = trained(t, "scorecard").extra["fitted"]
    iv_top = [f for f, _ in sorted(((f, b.iv) for f, b in sc.items()), key=lambda x: (-x[1], x[0]))[:k]]
    imp_top = [f for f, _ in trained(t, "boosted_trees").extra["importance"][:k]]
    rows = [(f, f in iv_top, f in imp_top) for f in sorted(set(iv_top) | set(imp_top))]
    return t.spark.createDataFrame(rows, "feature string, in_iv_top boolean, in_importance_top boolean")


# ------------------------------------------------------------ scorer runs
# Closed-form scorers evaluated on the hold-out and logged like model runs,
# so comparison (R15) and promotion (M19) have an exact SQL twin.

# --- fixed values -----------------------------------------------------------
SCORERS = [  # (run, Spark score, SQL score, champion); a run name used again replaces the earlier run
    ("grade_rule", "dti", None, False),
    ("rate_rule", None, "round(((CAST(loan_id AS BIGINT) * 7919) % 2000) / 2000.0::DOUBLE, 3)", True),
    ("grade_rule", "grade", "COALESCE(grade_numeric, 0.0) / 8.0", False),
    ("dti_rule", "dti", "dti / 45.0", True),   # the champion: the latest run tagged so
]
# ---------------------------------------------------------------------------


def _scorer_col(kind):
    if kind is None:
        return fixture_score()
    if kind == "grade":
        return F.coalesce(F.col("grade_numeric"), F.lit(0.0)) / F.lit(8.0)
    return F.col("dti") / F.lit(45.0)


_SCORER_LOGS: dict[tuple[str, str], models.RunLog] = {}


def scorer_run_log(t) -> DataFrame:
    """S12 rows for the closed-form scorers (tags + evaluation metrics),
    evaluated once per session and data folder."""
    key = (session_key(t.spark), t.sf_dir)
    with MATERIALIZE_LOCK:
        if key not in _SCORER_LOGS:
            _SCORER_LOGS[key] = _scorer_log(t)
    return stored_log(t, _SCORER_LOGS[key], "scorer_log")


def _scorer_log(t) -> models.RunLog:
    test = split_rows(t, "test")
    log = models.RunLog()
    for k, (run, kind, _sql_expr, champ) in enumerate(SCORERS):
        scored = test.select(F.col("default_flag").alias("y"), _scorer_col(kind).alias("p"))
        log.start(run, at=float(k))
        log.log(run, "tag", "champion", "true" if champ else "false")
        row = metrics.evaluate(scored).first().asDict()
        log.metrics(run, {k: row[k] for k in ("gini", "ks", "auc", "calibration_error")})
    return log


def _scorer_eval_sql(run: str, expr: str, champ: bool, at: int) -> str:
    lad = f"""(SELECT p, pos, neg,
  COALESCE(sum(pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_lt,
  COALESCE(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_lt,
  sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg
        FROM (SELECT default_flag AS y, {expr} AS p FROM scorer_base) b
        WHERE p IS NOT NULL GROUP BY p) d)"""
    qs = ", ".join(f"quantile_cont(p, {q}) AS q{i}" for i, q in enumerate(_QS))
    bins = " + ".join(f"CASE WHEN p > e.q{i} THEN 1 ELSE 0 END" for i in range(9))
    return f"""
SELECT '{run}' AS run, {at if champ else 'CAST(NULL AS INTEGER)'} AS champion_at,
  round(r.auc * 2 - 1, 4) AS gini, round(greatest(r.ks, 0.0), 4) AS ks, round(r.auc, 4) AS auc,
  c.calibration_error
FROM (SELECT CAST(sum(CAST(pos AS HUGEINT) * (2 * neg_lt + neg)) AS DOUBLE)
               / (CAST(max(n_pos) AS DOUBLE) * CAST(max(n_neg) AS DOUBLE) * 2.0) AS auc,
             max((n_pos - pos_lt) / n_pos - (n_neg - neg_lt) / n_neg) AS ks
      FROM {lad} l) r,
     (SELECT round(avg(abs(observed_rate - mean_predicted)), 4) AS calibration_error
      FROM (SELECT bin, sum(p * (pos + neg)) / sum(pos + neg) AS mean_predicted,
                   sum(pos) / sum(pos + neg) AS observed_rate
            FROM (SELECT l.*, {bins} AS bin
                  FROM {lad} l,
                       (SELECT {qs} FROM (SELECT {expr} AS p FROM scorer_base) x
                        WHERE p IS NOT NULL) e) bb
            GROUP BY bin) cc) c"""


_SCORER_BASE = ("SELECT * FROM split_features WHERE split = 'test'", ["split_features"])
_SCORER_EVALS = (" UNION ALL ".join(_scorer_eval_sql(r, e, c, k) for k, (r, _k, e, c) in enumerate(SCORERS) if e),
                 ["scorer_base"])
_SCORER_RUNS = ("SELECT *, coalesce(champion_at = max(champion_at) OVER (), false) AS is_champion FROM scorer_evals", ["scorer_evals"])
_SCORER_CTES = {"split_features": _SPLIT, "scorer_base": _SCORER_BASE, "scorer_evals": _SCORER_EVALS, "scorer_runs": _SCORER_RUNS}


@register("scorer_comparison", sql_over(["scorer_runs"], """
SELECT run, is_champion, gini, ks, auc, calibration_error,
       round(gini - max(CASE WHEN is_champion THEN gini END) OVER (), 4) AS delta_vs_champion
FROM scorer_runs ORDER BY gini DESC, run""", _SCORER_CTES))
def scorer_comparison(t):
    """R15 over logged scorer runs (S12 -> comparison), exact SQL twin."""
    return models.comparison(scorer_run_log(t))


@register("scorer_promotion", sql_over(["scorer_runs"], """
SELECT run AS challenger, gini AS challenger_gini, champion, champion_gini,
       champion_gini + 0.02 AS threshold, gini > champion_gini + 0.02 AS promotion_eligible,
       round(gini - champion_gini, 4) AS delta
FROM (SELECT *, max(CASE WHEN is_champion THEN run END) OVER () AS champion,
             max(CASE WHEN is_champion THEN gini END) OVER () AS champion_gini
      FROM scorer_runs) s
WHERE NOT is_champion AND gini IS NOT NULL""", _SCORER_CTES))
def scorer_promotion(t):
    """M19 over logged scorer runs, exact SQL twin."""
    return models.promotion(scorer_run_log(t))
