"""The query catalog: tables, panel, feature views and report queries.

Importing this module fills ``loanrisk.plans.registry.REGISTRY``.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from loanrisk.operators import clean, features, panel
from loanrisk.plans import reports
from loanrisk.plans.registry import register, sql_over
from loanrisk.sources import io
from loanrisk.sources.io import sample_exact

# ---------------------------------------------------------------- tables


@register("labelled_rate_by_year", sql_over(["loans", "outcomes"], """
SELECT CAST(year(strptime(issue_date, '%b-%Y')) AS INTEGER) AS issue_year,
       count(*) AS loans, CAST(sum(default_flag) AS BIGINT) AS defaults,
       round(avg(default_flag) * 100, 2) AS default_rate_pct
FROM loans JOIN outcomes USING (loan_id) GROUP BY 1 ORDER BY 1"""))
def labelled_rate_by_year(t):
    """Minimum slice."""
    return reports.labelled_rate_by_year(t.loans, t.outcomes)


@register("loans_table", sql_over(["loans"], "SELECT * FROM loans"))
def loans_table(t):
    """The loans table."""
    return t.loans


@register("borrowers_table", sql_over(["borrowers"], "SELECT * FROM borrowers"))
def borrowers_table(t):
    """P1, P2, F3, F5, null tokens: the borrowers table."""
    return t.borrowers


@register("outcomes_table", sql_over(["outcomes"], "SELECT * FROM outcomes"))
def outcomes_table(t):
    """The outcomes table with its label."""
    return t.outcomes


@register("ingest_audit", sql_over(["raw"], """
SELECT count(*) AS rows_read,
  CAST(sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped_null_id,
  CAST(sum(CASE WHEN id IS NOT NULL AND lbl IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped_status,
  CAST(sum(CASE WHEN id IS NOT NULL AND lbl IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS rows_kept,
  CAST(sum(CASE WHEN id IS NOT NULL AND lbl IS NOT NULL THEN lbl END) AS BIGINT) AS defaults,
  round(sum(CASE WHEN id IS NOT NULL AND lbl IS NOT NULL THEN lbl END)
        / sum(CASE WHEN id IS NOT NULL AND lbl IS NOT NULL THEN 1 ELSE 0 END), 4) AS default_rate
FROM (SELECT id, CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1
                      WHEN loan_status IN ('Fully Paid', 'Current', 'In Grace Period') THEN 0 END AS lbl
      FROM raw) r"""))
def ingest_audit(t):
    """Ingestion audit."""
    return t.ingest_audit


@register("raw_sample", sql_over(["raw"], """
SELECT id, loan_status, issue_d FROM raw
ORDER BY md5(coalesce(id, '') || '42'), id LIMIT 50000"""))
def raw_sample(t):
    """S3: exact-size seeded sample (default 50,000 rows) of the raw records."""
    return sample_exact(t.raw, 50000).select("id", "loan_status", "issue_d")


@register("raw_sample_5000", sql_over(["raw"], """
SELECT id, loan_status, issue_d FROM raw
ORDER BY md5(coalesce(id, '') || '42'), id LIMIT 5000"""))
def raw_sample_5000(t):
    """S3 with a size below the row count: the cut falls inside a hash prefix."""
    return sample_exact(t.raw, 5000).select("id", "loan_status", "issue_d")


@register("table_profile", sql_over(["loans", "borrowers", "outcomes"], """
SELECT 'loans' AS table_name, count(*) AS row_count, 15 AS column_count FROM loans
UNION ALL SELECT 'borrowers', count(*), 17 FROM borrowers
UNION ALL SELECT 'outcomes', count(*), 13 FROM outcomes"""))
def table_profile(t):
    """Rows and columns per table."""
    return reports.table_profile({"loans": t.loans, "borrowers": t.borrowers,
                                  "outcomes": t.outcomes})


# ---------------------------------------------------------------- panel


@register("monthly_panel", sql_over(["panel"], "SELECT * FROM panel"))
def monthly_panel(t):
    """U1 with F7-F15, P5, J1: every loan month."""
    return t.panel


@register("panel_profile", sql_over(["panel"], """
SELECT count(*) AS panel_rows, count(DISTINCT loan_id) AS loans,
       round(count(*) / count(DISTINCT loan_id), 1) AS months_per_loan,
       round(avg(is_active), 3) AS active_share
FROM panel"""))
def panel_profile(t):
    """R9 (A2, A3), from the loans' runs: the months' rows are neither made nor read."""
    return panel.runs_profile(t.runs)


@register("early_payment_by_label", sql_over(["panel"], """
SELECT default_flag, round(avg(payment_ratio), 3) AS avg_payment_ratio,
       round(avg(is_active), 3) AS avg_active_rate, count(DISTINCT loan_id) AS loan_count
FROM panel WHERE month_number <= 6 GROUP BY default_flag ORDER BY default_flag"""))
def early_payment_by_label(t):
    """R2 (P7, A3, A5, A12), from the loans' runs."""
    return panel.runs_by_label(t.runs)


@register("payment_runs", sql_over(["panel"], """
SELECT loan_id, default_flag, is_active, min(month_number) AS first_month, max(month_number) AS last_month,
       max(expected_payment) AS expected_payment, max(estimated_payment) AS estimated_payment, max(payment_ratio) AS payment_ratio
FROM panel GROUP BY loan_id, default_flag, is_active"""))
def payment_runs(t):
    """U1 run-length encoded: at most two runs a loan."""
    r = t.runs.withColumn("r", F.explode("runs"))
    return r.select("loan_id", "default_flag", "r.is_active", F.col("r.first").alias("first_month"), F.col("r.last").alias("last_month"),
                    "expected_payment", "r.estimated_payment", "r.payment_ratio")


# ---------------------------------------------------------------- views


@register("origination_features", sql_over(["origination_features"],
                                           "SELECT * FROM origination_features"))
def origination_features(t):
    """View 1: J2, P6, F19-F24."""
    return t.origination


@register("payment_features", sql_over(["payment_features"], "SELECT * FROM payment_features"))
def payment_features(t):
    """View 2: P7, P8, W1, A4-A11, F17, F18, F25, J3 (folded)."""
    return t.payment


@register("payment_features_stored_panel", sql_over(["payment_features"],
                                                    "SELECT * FROM payment_features"))
def payment_features_stored_panel(t):
    """View 2 over the stored monthly_payments table (month <= 6 pushed to its scan)."""
    return features.payment_features(t.panel)


@register("vintage_features", sql_over(["vintage_features"], "SELECT * FROM vintage_features"))
def vintage_features(t):
    """View 3: J5 broadcast of the bounded quarter aggregate, F9, F10."""
    return t.vintage


@register("model_features", sql_over(["model_features"], "SELECT * FROM model_features"))
def model_features(t):
    """The 48-column model table."""
    return t.model_features


# ---------------------------------------------------------------- reports

@register("model_features_sql", sql_over(["model_features"], "SELECT * FROM model_features"))
def model_features_sql(t):
    """The four views from SQL scripts on shared storage."""
    root = os.path.join(io.table_root(t.spark, t.tag), "scripts")
    io.store_scripts(t.spark, root)
    frames = {"loans": t.loans, "borrowers": t.borrowers, "outcomes": t.outcomes, "monthly_payments": t.panel}
    return io.run_feature_scripts(t.spark, root, frames)


_MF = ["model_features"]


@register("portfolio_check", sql_over(["loans", "borrowers", "outcomes"], """
SELECT count(*) AS total_loans, CAST(sum(o.default_flag) AS BIGINT) AS total_defaults,
       round(avg(o.default_flag) * 100, 2) AS default_rate_pct,
       round(avg(b.dti), 2) AS avg_dti, round(avg(l.loan_amnt), 0) AS avg_loan_amount
FROM loans l JOIN borrowers b USING (loan_id) JOIN outcomes o USING (loan_id)"""))
def portfolio_check(t):
    """R1 (A1, A2, A4, A5, A14, J2)."""
    return reports.portfolio_check(t.loans, t.borrowers, t.outcomes)


@register("feature_spot_check", sql_over(_MF, """
SELECT count(*) AS loans, round(avg(default_flag) * 100, 2) AS default_rate_pct,
       round(avg(avg_payment_ratio_m6), 3) AS avg_pay_ratio,
       round(avg(missed_payment_flag) * 100, 1) AS pct_missed_payment
FROM model_features"""))
def feature_spot_check(t):
    """R3."""
    return reports.feature_spot_check(t.model_features)


@register("payment_by_label", sql_over(_MF, """
SELECT default_flag, round(avg(avg_payment_ratio_m6), 3) AS avg_pay_ratio,
       round(avg(payment_volatility_m6), 3) AS avg_volatility,
       round(avg(missed_payment_flag), 3) AS pct_missed,
       round(avg(deteriorating_flag), 3) AS pct_deteriorating, count(*) AS loans
FROM model_features GROUP BY default_flag ORDER BY default_flag"""))
def payment_by_label(t):
    """R4."""
    return reports.payment_by_label(t.model_features)


@register("default_rate_by_year", sql_over(_MF, """
SELECT issue_year, count(*) AS loans, round(avg(default_flag) * 100, 2) AS default_rate_pct
FROM model_features GROUP BY issue_year ORDER BY issue_year"""))
def default_rate_by_year(t):
    """R5."""
    return reports.default_rate_by_year(t.model_features)


@register("dual_stress", sql_over(_MF, """
SELECT dual_stress_flag, count(*) AS loans, round(avg(default_flag) * 100, 2) AS default_rate_pct
FROM model_features GROUP BY dual_stress_flag ORDER BY dual_stress_flag"""))
def dual_stress(t):
    """R6."""
    return reports.dual_stress(t.model_features)


@register("payment_separation", sql_over(_MF, """
SELECT default_flag, round(avg(avg_payment_ratio_m6), 3) AS avg_pay_ratio,
       round(avg(missed_payment_flag), 3) AS pct_missed,
       round(avg(deteriorating_flag), 3) AS pct_deteriorating, count(*) AS loans
FROM model_features GROUP BY default_flag ORDER BY default_flag"""))
def payment_separation(t):
    """R7."""
    return reports.payment_separation(t.model_features)


@register("dti_util_interaction", sql_over(_MF, """
SELECT high_dti_flag, high_util_flag, count(*) AS loans,
       round(avg(default_flag) * 100, 2) AS default_rate_pct
FROM model_features GROUP BY high_dti_flag, high_util_flag ORDER BY high_dti_flag, high_util_flag"""))
def dti_util_interaction(t):
    """R8 (A13)."""
    return reports.dti_util_interaction(t.model_features)


@register("rate_by_period", sql_over(["loans", "outcomes"], """
SELECT period, count(*) AS loans, round(avg(default_flag) * 100, 2) AS default_rate_pct
FROM (SELECT default_flag,
        CASE WHEN y = 2007 THEN '2007' WHEN y BETWEEN 2012 AND 2016 THEN '2012-2016'
             WHEN y = 2017 THEN '2017' WHEN y = 2018 THEN '2018' ELSE 'other' END AS period
      FROM (SELECT default_flag, year(strptime(issue_date, '%b-%Y')) AS y
            FROM loans JOIN outcomes USING (loan_id)) a) b
GROUP BY period ORDER BY period"""))
def rate_by_period(t):
    """R12."""
    return reports.rate_by_period(t.loans, t.outcomes)


@register("stress_lift", sql_over(_MF, """
SELECT round(seg, 2) AS dual_stress_rate_pct, round(rest, 2) AS rest_rate_pct,
       round((seg / rest - 1) * 100, 1) AS relative_lift_pct,
       round(dti_only - base, 2) AS added_pts_high_dti,
       round(util_only - base, 2) AS added_pts_high_util,
       round(seg - base, 2) AS added_pts_both
FROM (SELECT
  avg(CASE WHEN high_dti_flag = 1 AND high_util_flag = 1 THEN default_flag END) * 100 AS seg,
  avg(CASE WHEN NOT (high_dti_flag = 1 AND high_util_flag = 1) THEN default_flag END) * 100 AS rest,
  avg(CASE WHEN high_dti_flag = 0 AND high_util_flag = 0 THEN default_flag END) * 100 AS base,
  avg(CASE WHEN high_dti_flag = 1 AND high_util_flag = 0 THEN default_flag END) * 100 AS dti_only,
  avg(CASE WHEN high_dti_flag = 0 AND high_util_flag = 1 THEN default_flag END) * 100 AS util_only
  FROM model_features) a"""))
def stress_lift(t):
    """R13."""
    return reports.stress_lift(t.model_features)


@register("expected_loss_baseline", sql_over(["loans", "outcomes"], """
SELECT loans, round(pd, 4) AS default_rate, round(avg_amt, 2) AS avg_loan_amount,
       0.6::DOUBLE AS lgd, round(pd * avg_amt * 0.6, 2) AS expected_loss_per_loan,
       round(pd * avg_amt * 0.6 * loans, 0) AS expected_loss_total
FROM (SELECT count(*) AS loans, avg(default_flag) AS pd, avg(loan_amnt) AS avg_amt
      FROM loans JOIN outcomes USING (loan_id)) a"""))
def expected_loss_baseline(t):
    """R14."""
    return reports.expected_loss_baseline(t.loans, t.outcomes)

