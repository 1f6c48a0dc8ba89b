"""Feature views.

* ``origination_features``: loans x borrowers x outcomes, facts at issue.
* ``payment_features``: months 1-6 behaviour from a panel (lag + one groupBy).
* ``vintage_features``: cohort default rate and size by issue quarter.
* ``model_features``: the three joined on ``loan_id``.

Every join is on ``loan_id``; the only other grouping key is the issue
quarter, whose domain is bounded by the calendar (see ``vintage_stats``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanrisk.functions.num import (dround, emp_stability, flag, home_ownership_code,
                                    month_date)
from loanrisk.operators.panel import (OBSERVATION_MONTHS, eligible, explode_months, month_ratio,
                                      panel_source, with_schedule)

# --- fixed values -----------------------------------------------------------
HIGH_DTI = 28          # debt-to-income above this is "high"
HIGH_UTIL = 75         # revolving utilisation above this is "high"
UNDERPAYMENT = 0.95    # average ratio below this is underpayment
DETERIORATION = -0.1   # trend below this is deteriorating
# ---------------------------------------------------------------------------

PAYMENT_FEATURES = [
    "avg_payment_ratio_m6", "min_payment_ratio_m6", "payment_volatility_m6",
    "active_months_m6", "still_active_m6", "payment_trend_m6",
    "first_month_ratio", "last_month_ratio", "avg_monthly_change",
    "underpayment_flag", "missed_payment_flag", "deteriorating_flag",
    "early_dropout_flag",
]
VINTAGE_FEATURES = ["issue_quarter", "issue_year", "vintage_default_rate", "vintage_size"]


def _origination_columns() -> list[F.Column]:
    c = F.col
    inc_ok = c("annual_inc") > 0
    return [
        c("loan_id"), c("issue_date"), c("grade"), c("grade_numeric"), c("term_months"),
        c("int_rate"), c("loan_amnt"), c("installment"), c("purpose"),
        c("annual_inc"), c("dti"), c("revol_util"), c("revol_bal"),
        c("delinq_2yrs"), c("open_acc"), c("pub_rec"), c("total_acc"), c("mort_acc"),
        c("pub_rec_bankruptcies"),
        F.when(inc_ok, dround(c("loan_amnt") / c("annual_inc"), 4)).alias("loan_to_income"),
        F.when(inc_ok, dround(c("installment") * 12 / c("annual_inc"), 4)).alias("payment_to_income"),
        flag(c("dti") > HIGH_DTI).alias("high_dti_flag"),
        flag(c("revol_util") > HIGH_UTIL).alias("high_util_flag"),
        flag(c("delinq_2yrs") > 0).alias("prior_delinq_flag"),
        flag(c("pub_rec") > 0).alias("public_record_flag"),
        flag((c("dti") > HIGH_DTI) & (c("revol_util") > HIGH_UTIL)).alias("dual_stress_flag"),
        c("emp_length_years"),
        emp_stability("emp_length_years").alias("emp_stability"),
        c("home_ownership"),
        home_ownership_code("home_ownership").alias("home_ownership_enc"),
        c("default_flag"),
    ]


def origination_eligible() -> F.Column:
    """Positive amount and income, known debt-to-income."""
    return (F.col("loan_amnt") > 0) & (F.col("annual_inc") > 0) & F.col("dti").isNotNull()


def origination_features(loans: DataFrame, borrowers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """View 1 (31 columns): J2 three-way inner join, P6, F19-F24."""
    j = (loans.join(borrowers, "loan_id").join(outcomes.select("loan_id", "default_flag"), "loan_id"))
    return origination_of(j)


def origination_of(records: DataFrame) -> DataFrame:
    """View 1 from one row per loan (typed records): P6, F19-F24, no join."""
    return records.where(origination_eligible()).select(*_origination_columns())


def payment_aggregates(obs: DataFrame) -> DataFrame:
    """One groupBy over months <= 6, with the lagged change folded in.

    The lag (W1) is partitioned by ``loan_id`` like the aggregate, so window
    and aggregate share one clustering: a single exchange at most, and none
    when the panel inherits a ``loan_id`` partitioning.
    """
    m, r = F.col("month_number"), F.col("payment_ratio")
    prev = F.lag("payment_ratio").over(Window.partitionBy("loan_id").orderBy("month_number"))
    lagged = obs.withColumn("_prev", prev)
    change = F.when((m > 1) & F.col("_prev").isNotNull(), F.abs(r - F.col("_prev")))
    return lagged.groupBy("loan_id").agg(
        dround(F.avg(r), 4).alias("avg_payment_ratio_m6"),
        dround(F.min(r), 4).alias("min_payment_ratio_m6"),
        dround(F.stddev_samp(r), 4).alias("payment_volatility_m6"),
        F.sum("is_active").cast("long").alias("active_months_m6"),
        F.max(F.when(m == 6, F.col("is_active")).otherwise(F.lit(0))).alias("still_active_m6"),
        dround(F.avg(F.when(m >= 4, r)) - F.avg(F.when(m <= 3, r)), 4).alias("payment_trend_m6"),
        dround(F.avg(F.when(m == 1, r)), 4).alias("first_month_ratio"),
        dround(F.avg(F.when(m == 6, r)), 4).alias("last_month_ratio"),
        F.coalesce(dround(F.avg(change), 4), F.lit(0.0)).alias("avg_monthly_change"),
    )


def _squared_deviations(paid: F.Column, k: F.Column, n: F.Column) -> F.Column:
    """The sum of squared deviations of ``k`` times ``paid`` and then zeros, ``n`` in all,
    by the running update that the aggregate function uses. Equal values leave mean and
    sum as they are after the first, so that only months without payment are steps."""
    start = F.struct(paid.alias("mean"), (paid * (paid - paid)).alias("m2"))

    def step(acc, month):
        delta = F.lit(0.0) - acc["mean"]
        part = delta / month
        return F.struct((acc["mean"] + part).alias("mean"), (acc["m2"] + delta * (delta - part)).alias("m2"))
    return F.when((k > 0) & (k < n), F.aggregate(F.sequence(k + 1, n), start, step, lambda acc: acc["m2"])).otherwise(start["m2"])


def payment_columns_of(records: DataFrame) -> DataFrame:
    """Adds the view-2 columns to typed records (one row per loan).

    The first ``_n`` months of a loan are ``_k`` times the same ratio (0 where ``_k``
    is 0), then zeros, so there is no explode, window or grouping, and no array of
    months: plain arithmetic in methods that the JVM compiles. Up to five times a number,
    added up one after the other, is the rounded product. Loans that have no panel row
    (P5, or a term below one month) are dropped, as in the panel.
    """
    zero = F.lit(0.0)
    s = with_schedule(records.where(eligible())).where(F.col("_term") >= 1)
    # none of the three is null here; saying so makes the code shorter
    s = s.withColumns({"_n": F.coalesce(F.least(F.col("_term"), F.lit(OBSERVATION_MONTHS)), F.lit(1)),
                       "_paid": F.coalesce(month_ratio(F.col("installment"), F.col("_per_month")), zero)})
    s = s.withColumn("_k", F.coalesce(F.least(F.col("_active"), F.col("_n")), F.lit(0)))
    n, k, paid = F.col("_n"), F.col("_k"), F.col("_paid")
    # a fold is not compiled with the rest, and cuts its code in two
    s = s.withColumn("_m2", _squared_deviations(paid, k, n))
    full = n >= OBSERVATION_MONTHS
    total = F.when(k > 5, paid * 5 + paid).otherwise(paid * k)
    head = paid * F.least(k, F.lit(3)) / F.least(n, F.lit(3))
    tail = F.when(k > 3, paid * (k - 3)).otherwise(zero)
    # the one step down to 0; equal neighbours add nothing (NaN for an infinite ratio)
    change = F.when(k < n, F.abs(paid)).otherwise(zero) + F.when(k > 1, F.abs(paid - paid)).otherwise(zero)
    s = s.withColumns({
        "avg_payment_ratio_m6": dround(total / n, 4),
        "min_payment_ratio_m6": dround(F.when(k < n, F.least(paid, zero)).otherwise(paid), 4),
        "payment_volatility_m6": F.when(n > 1, dround(F.sqrt(F.col("_m2") / (n - 1)), 4)),
        "active_months_m6": k.cast("long"),
        "still_active_m6": F.when(full & (k == n), F.lit(1)).otherwise(F.lit(0)),
        "payment_trend_m6": F.when(n > 3, dround(tail / (n - 3) - head, 4)),
        "first_month_ratio": dround(paid, 4),
        "last_month_ratio": F.when(full, dround(F.when(k == n, paid).otherwise(zero), 4)),
        "avg_monthly_change": F.when(n > 1, dround(change / (n - 1), 4)).otherwise(zero),
    })
    return payment_flags(s)


def payment_flags(aggs: DataFrame) -> DataFrame:
    """flags on the rounded aggregates."""
    c = F.col
    return aggs.withColumns({
        "underpayment_flag": flag(c("avg_payment_ratio_m6") < UNDERPAYMENT),
        "missed_payment_flag": flag(c("min_payment_ratio_m6") == 0),
        "deteriorating_flag": flag(c("payment_trend_m6") < DETERIORATION),
        "early_dropout_flag": flag(c("still_active_m6") == 0),
    })


def payment_features(panel: DataFrame) -> DataFrame:
    """View 2 (14 columns) from a stored monthly panel (P7 pushed to the scan)."""
    obs = panel.where(F.col("month_number") <= OBSERVATION_MONTHS)
    return payment_flags(payment_aggregates(obs)).select("loan_id", *PAYMENT_FEATURES)


def payment_features_from_tables(loans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """View 2 without a stored panel: derive only months 1..6 (rewrite 4.2.4)."""
    sched = with_schedule(panel_source(loans, outcomes))
    obs = explode_months(sched, OBSERVATION_MONTHS)
    return payment_flags(payment_aggregates(obs)).select("loan_id", *PAYMENT_FEATURES)


def _quarter_year(df: DataFrame) -> DataFrame:
    # the schedule has parsed it
    issue = F.col("_issue") if "_issue" in df.columns else month_date("issue_date")
    return df.withColumns({
        "issue_quarter": F.trunc(issue, "quarter").cast("timestamp_ntz"),
        "issue_year": F.year(issue),
    })


def vintage_stats(loans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Default rate and size per issue quarter over all labelled loans.

    Partial aggregation before the exchange, so each task ships at most one
    row per quarter. The result has one row per calendar quarter: dates parse
    from 'MMM-yyyy' with a four-digit year, so there are at most 4 x 9,999
    rows of three small columns (< 1 MB) whatever the data size. That bound
    is what makes the broadcast in ``vintage_features`` safe.
    """
    return vintage_stats_of(loans.select("loan_id", "issue_date")
                            .join(outcomes.select("loan_id", "default_flag"), "loan_id"))


def vintage_stats_of(labelled: DataFrame) -> DataFrame:
    """The same from rows that hold issue date and label."""
    return (_quarter_year(labelled.select("issue_date", "default_flag")).groupBy("issue_quarter")
            .agg(dround(F.avg("default_flag"), 4).alias("vintage_default_rate"),
                 F.count(F.lit(1)).alias("vintage_size")))


def vintage_features(loans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """View 3 (6 columns): quarter statistic attached to each loan."""
    lo = (loans.select("loan_id", "issue_date")
          .join(outcomes.select("loan_id"), "loan_id"))
    return (_with_vintage(lo, vintage_stats(loans, outcomes))
            .select("loan_id", "issue_date", *VINTAGE_FEATURES))


def _with_vintage(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the quarter statistic (bounded by the calendar, so broadcast)."""
    stats = stats.withColumnRenamed("issue_quarter", "_quarter")
    q = _quarter_year(df)
    return q.join(F.broadcast(stats), q["issue_quarter"].eqNullSafe(stats["_quarter"]), "left").drop("_quarter")


def vintage_of(records: DataFrame) -> DataFrame:
    """View 3 from typed records: no join of loan tables."""
    return (_with_vintage(records.select("loan_id", "issue_date"), vintage_stats_of(records))
            .select("loan_id", "issue_date", *VINTAGE_FEATURES))


def model_features_of(records: DataFrame) -> DataFrame:
    """model_features (48 columns) from typed records, one row per loan: one scan
    for the columns and one for the quarter statistic, no join of loan tables, no
    exchange of loan rows. The filters on typed columns reach the scan."""
    rows = payment_columns_of(records.where(origination_eligible()))
    rows = _with_vintage(rows, vintage_stats_of(records))
    return rows.select(*_origination_columns(), *PAYMENT_FEATURES, *VINTAGE_FEATURES)


def model_features(loans: DataFrame, borrowers: DataFrame, outcomes: DataFrame,
                   panel: DataFrame | None = None) -> DataFrame:
    """model_features (48 columns) from separately stored tables: origination x
    payment x vintage on loan_id (J4).

    Without a stored ``panel`` the first six months are derived on the fly.
    """
    o = origination_features(loans, borrowers, outcomes)
    p = (payment_features(panel) if panel is not None
         else payment_features_from_tables(loans, outcomes))
    v = vintage_features(loans, outcomes).select("loan_id", *VINTAGE_FEATURES)
    return o.join(p, "loan_id").join(v, "loan_id")
