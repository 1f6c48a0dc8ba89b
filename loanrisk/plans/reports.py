"""Report queries over the tables and views.

Each is a small aggregate: partial aggregation runs map-side, so only a
handful of rows per task cross the exchange whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.functions.num import dround, month_date

# --- fixed values -----------------------------------------------------------
# Issue-year bands used for the published vintage default rates.
PERIOD_BANDS = [("2007", 2007, 2007), ("2012-2016", 2012, 2016),
                ("2017", 2017, 2017), ("2018", 2018, 2018)]
ASSUMED_LGD = 0.60     # loss given default for the expected-loss baseline
# ---------------------------------------------------------------------------


def rate_pct(c: str = "default_flag", k: int = 2) -> F.Column:
    """Mean of a 0/1 column as a percentage."""
    return dround(F.avg(c) * 100, k)


def portfolio_check(loans: DataFrame, borrowers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Loans, defaults, rate %, average dti and amount over the 3-way join."""
    j = (loans.select("loan_id", "loan_amnt").join(borrowers.select("loan_id", "dti"), "loan_id")
         .join(outcomes.select("loan_id", "default_flag"), "loan_id"))
    return j.agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.sum("default_flag").cast("long").alias("total_defaults"),
        rate_pct().alias("default_rate_pct"),
        dround(F.avg("dti"), 2).alias("avg_dti"),
        dround(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
    )


def feature_spot_check(mf: DataFrame) -> DataFrame:
    """Size, default rate, average ratio and missed-payment share."""
    return mf.agg(
        F.count(F.lit(1)).alias("loans"),
        rate_pct().alias("default_rate_pct"),
        dround(F.avg("avg_payment_ratio_m6"), 3).alias("avg_pay_ratio"),
        dround(F.avg("missed_payment_flag") * 100, 1).alias("pct_missed_payment"),
    )


def payment_by_label(mf: DataFrame) -> DataFrame:
    """Payment features by default flag."""
    return (mf.groupBy("default_flag")
            .agg(dround(F.avg("avg_payment_ratio_m6"), 3).alias("avg_pay_ratio"),
                 dround(F.avg("payment_volatility_m6"), 3).alias("avg_volatility"),
                 dround(F.avg("missed_payment_flag"), 3).alias("pct_missed"),
                 dround(F.avg("deteriorating_flag"), 3).alias("pct_deteriorating"),
                 F.count(F.lit(1)).alias("loans"))
            .orderBy("default_flag"))


def payment_separation(mf: DataFrame) -> DataFrame:
    """Payment separation by default flag (3 averages + count)."""
    return (mf.groupBy("default_flag")
            .agg(dround(F.avg("avg_payment_ratio_m6"), 3).alias("avg_pay_ratio"),
                 dround(F.avg("missed_payment_flag"), 3).alias("pct_missed"),
                 dround(F.avg("deteriorating_flag"), 3).alias("pct_deteriorating"),
                 F.count(F.lit(1)).alias("loans"))
            .orderBy("default_flag"))


def default_rate_by_year(mf: DataFrame) -> DataFrame:
    """Default rate by vintage year over model_features."""
    return (mf.groupBy("issue_year")
            .agg(F.count(F.lit(1)).alias("loans"), rate_pct().alias("default_rate_pct"))
            .orderBy("issue_year"))


def labelled_rate_by_year(loans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Minimum slice: default rate by issue year over all labelled loans."""
    j = loans.select("loan_id", "issue_date").join(outcomes.select("loan_id", "default_flag"), "loan_id")
    return (j.groupBy(F.year(month_date("issue_date")).alias("issue_year"))
            .agg(F.count(F.lit(1)).alias("loans"),
                 F.sum("default_flag").cast("long").alias("defaults"),
                 rate_pct().alias("default_rate_pct"))
            .orderBy("issue_year"))


def dual_stress(mf: DataFrame) -> DataFrame:
    """Dual-stress segment rate."""
    return (mf.groupBy("dual_stress_flag")
            .agg(F.count(F.lit(1)).alias("loans"), rate_pct().alias("default_rate_pct"))
            .orderBy("dual_stress_flag"))


def dti_util_interaction(mf: DataFrame) -> DataFrame:
    """R8 (A13): DTI x utilisation."""
    return (mf.groupBy("high_dti_flag", "high_util_flag")
            .agg(F.count(F.lit(1)).alias("loans"), rate_pct().alias("default_rate_pct"))
            .orderBy("high_dti_flag", "high_util_flag"))


def period_band_expr(year: F.Column) -> F.Column:
    out = F.lit("other")
    for label, lo, hi in reversed(PERIOD_BANDS):
        out = F.when((year >= lo) & (year <= hi), F.lit(label)).otherwise(out)
    return out


def rate_by_period(loans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Default rate by issue-year period band over labelled loans."""
    j = loans.select("loan_id", "issue_date").join(outcomes.select("loan_id", "default_flag"), "loan_id")
    band = period_band_expr(F.year(month_date("issue_date")))
    return (j.groupBy(band.alias("period"))
            .agg(F.count(F.lit(1)).alias("loans"), rate_pct().alias("default_rate_pct"))
            .orderBy("period"))


def stress_lift(mf: DataFrame) -> DataFrame:
    """Dual-stress lift vs the rest, and added points per stress factor.

    One pass: conditional sums for the four DTI x utilisation cells.
    """
    d, u, y = F.col("high_dti_flag"), F.col("high_util_flag"), F.col("default_flag")

    def rate(cond: F.Column) -> F.Column:
        return F.avg(F.when(cond, y)) * 100

    a = mf.agg(
        rate((d == 1) & (u == 1)).alias("seg"),
        rate(~((d == 1) & (u == 1))).alias("rest"),
        rate((d == 0) & (u == 0)).alias("base"),
        rate((d == 1) & (u == 0)).alias("dti_only"),
        rate((d == 0) & (u == 1)).alias("util_only"),
    )
    return a.select(
        dround("seg", 2).alias("dual_stress_rate_pct"),
        dround("rest", 2).alias("rest_rate_pct"),
        dround((F.col("seg") / F.col("rest") - 1) * 100, 1).alias("relative_lift_pct"),
        dround(F.col("dti_only") - F.col("base"), 2).alias("added_pts_high_dti"),
        dround(F.col("util_only") - F.col("base"), 2).alias("added_pts_high_util"),
        dround(F.col("seg") - F.col("base"), 2).alias("added_pts_both"),
    )


def expected_loss_baseline(loans: DataFrame, outcomes: DataFrame, lgd: float = ASSUMED_LGD) -> DataFrame:
    """Default rate x average amount x LGD (per loan and portfolio)."""
    j = loans.select("loan_id", "loan_amnt").join(outcomes.select("loan_id", "default_flag"), "loan_id")
    a = j.agg(F.count(F.lit(1)).alias("loans"), F.avg("default_flag").alias("pd"),
              F.avg("loan_amnt").alias("avg_amt"))
    return a.select(
        "loans",
        dround("pd", 4).alias("default_rate"),
        dround("avg_amt", 2).alias("avg_loan_amount"),
        F.lit(lgd).alias("lgd"),
        dround(F.col("pd") * F.col("avg_amt") * F.lit(lgd), 2).alias("expected_loss_per_loan"),
        dround(F.col("pd") * F.col("avg_amt") * F.lit(lgd) * F.col("loans"), 0).alias("expected_loss_total"),
    )


def table_profile(named: dict[str, DataFrame]) -> DataFrame:
    """One row per table: rows and columns (counts run as one union job)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count",
                     F.lit(len(df.columns)).alias("column_count"))
             for name, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
