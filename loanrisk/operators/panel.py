"""Loan x month payment panel.

One row per loan per month of term, with the lifetime payment spread
uniformly over the months the borrower was active. Built with
``explode(sequence(1, term))``: a narrow generator, no shuffle. The output
keeps the partitioning of its input, so a loan's months stay in the task that
produced them and a later ``groupBy("loan_id")`` needs no exchange when the
input came out of a join on ``loan_id``.

A loan's months are at most two runs: months it was active, all with the same payment,
then months it was not. ``payment_runs`` is that run-length form, one row per loan;
aggregates over the panel are sums over runs weighted by their length, and
``expand_runs`` makes the months' rows where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.functions.num import dround, month_date, month_date_lenient, months_apart

PANEL_COLUMNS = [
    "loan_id", "month_number", "month_date", "expected_payment",
    "estimated_payment", "payment_ratio", "is_active", "default_flag",
]
# --- fixed values -----------------------------------------------------------
RATIO_CAP = 2.0          # payment ratio is capped at 2x the instalment
OBSERVATION_MONTHS = 6   # behavioural features look at months 1-6 only
# ---------------------------------------------------------------------------


def panel_source(loans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """J1 + P5: loans with outcomes, term and issue date known, instalment > 0."""
    l = loans.select("loan_id", "issue_date", "term_months", "installment")
    o = outcomes.select("loan_id", "total_pymnt", "last_pymnt_d", "last_pymnt_amnt",
                        "default_flag")
    return l.where(eligible()).join(o, "loan_id")


def eligible() -> F.Column:
    """P5: term and issue date known, instalment > 0."""
    return (F.col("term_months").isNotNull() & (F.col("installment") > 0)
            & F.col("issue_date").isNotNull())


def with_schedule(src: DataFrame) -> DataFrame:
    """Per loan: issue month, whole term, active months and uniform payment."""
    issue = month_date("issue_date")
    last = month_date_lenient("last_pymnt_d")
    term = F.col("term_months").cast("int")
    total = F.coalesce(F.col("total_pymnt"), F.lit(0.0))
    s = src.withColumns({"_issue": issue, "_last": last, "_term": term, "_total": total})
    active = (F.when(F.col("_last").isNull() | (F.col("_last") < F.col("_issue")), F.lit(0))
              .otherwise(F.least(months_apart("_last", "_issue") + 1, F.col("_term"))))
    s = s.withColumn("_active", active)
    return s.withColumn(
        "_per_month",
        F.when(F.col("_active") > 0, F.col("_total") / F.col("_active")).otherwise(F.lit(0.0)))


def explode_months(sched: DataFrame, max_month: int | None = None) -> DataFrame:
    """Rows for months 1..term (or 1..min(term, max_month)); none when term < 1."""
    upper = F.col("_term") if max_month is None else F.least(F.col("_term"), F.lit(max_month))
    months = F.when(upper >= 1, F.sequence(F.lit(1), upper))
    m = F.col("month_number")
    active = m <= F.col("_active")
    est = F.when(active, F.col("_per_month")).otherwise(F.lit(0.0))
    return (sched.withColumn("month_number", F.explode(months))
            .withColumns({
                "month_date": F.add_months(F.col("_issue"), m - 1).cast("timestamp_ntz"),
                "expected_payment": dround("installment", 2),
                "estimated_payment": dround(est, 2),
                "payment_ratio": month_ratio(F.col("installment"), est),
                "is_active": active.cast("int"),
            }))


def monthly_panel(loans: DataFrame, outcomes: DataFrame,
                  max_month: int | None = None) -> DataFrame:
    """The panel, all months (or the first ``max_month`` when derived on the fly)."""
    sched = with_schedule(panel_source(loans, outcomes))
    return explode_months(sched, max_month).select(*PANEL_COLUMNS)


def monthly_panel_of(records: DataFrame) -> DataFrame:
    """U1 from typed records (one row per loan): no join."""
    return explode_months(with_schedule(records.where(eligible()))).select(*PANEL_COLUMNS)


def payment_runs(records: DataFrame) -> DataFrame:
    """U1 run-length encoded, from typed records: per loan with any month ``runs``, an
    array of (first, last, is_active, estimated_payment, payment_ratio)."""
    s = with_schedule(records.where(eligible())).where(F.col("_term") >= 1)

    def run(first, last, active, payment):
        return F.struct(first.alias("first"), last.alias("last"), F.lit(active).alias("is_active"), dround(payment, 2).alias("estimated_payment"),
                        month_ratio(F.col("installment"), payment).alias("payment_ratio"))

    paid = F.greatest(F.col("_active"), F.lit(0))
    runs = F.filter(F.array(run(F.lit(1), paid, 1, F.col("_per_month")), run(paid + 1, F.col("_term"), 0, F.lit(0.0))),
                    lambda r: r["first"] <= r["last"])
    return s.select("loan_id", "default_flag", F.col("_issue").alias("issue_month"), dround("installment", 2).alias("expected_payment"),
                    runs.alias("runs"))


def expand_runs(runs: DataFrame, max_month: int | None = None) -> DataFrame:
    """The panel's rows out of its runs, all months or the first ``max_month``."""
    last = F.col("r.last") if max_month is None else F.least(F.col("r.last"), F.lit(max_month))
    months = runs.withColumn("r", F.explode("runs")).withColumn("month_number", F.explode(
        F.when(last >= F.col("r.first"), F.sequence(F.col("r.first"), last))))
    return months.withColumn("month_date", F.add_months("issue_month", F.col("month_number") - 1).cast("timestamp_ntz")).select(
        *[F.col(f"r.{c}").alias(c) if c in ("estimated_payment", "payment_ratio", "is_active") else c for c in PANEL_COLUMNS])


def runs_profile(runs: DataFrame) -> DataFrame:
    """R9 on runs: rows, loans, months per loan, active share."""
    r = runs.select("loan_id", F.explode("runs").alias("r")).select(
        "loan_id", (F.col("r.last") - F.col("r.first") + 1).alias("months"), "r.is_active")
    a = r.agg(F.sum("months").alias("panel_rows"), F.count_distinct("loan_id").alias("loans"),
              F.sum(F.col("months") * F.col("is_active")).alias("_active"))
    return a.select("panel_rows", "loans", dround(F.try_divide("panel_rows", "loans"), 1).alias("months_per_loan"),
                    dround(F.try_divide("_active", "panel_rows"), 3).alias("active_share"))


def runs_by_label(runs: DataFrame) -> DataFrame:
    """R2 on runs: each weighs as many months as it has among the first ones. Ratios
    have four digits and are summed as whole numbers."""
    r = runs.select("loan_id", "default_flag", F.explode("runs").alias("r"))
    r = r.withColumn("k", F.least(F.col("r.last"), F.lit(OBSERVATION_MONTHS)) - F.col("r.first") + 1).where("k > 0")
    units = F.round(F.col("r.payment_ratio") * 10_000).cast("long")
    return (r.groupBy("default_flag")
            .agg(dround(F.sum(F.col("k") * units) / 10_000.0 / F.sum("k"), 3).alias("avg_payment_ratio"),
                 dround(F.sum(F.col("k") * F.col("r.is_active")) / F.sum("k"), 3).alias("avg_active_rate"),
                 F.count_distinct("loan_id").alias("loan_count"))
            .orderBy("default_flag"))


def month_ratio(installment: F.Column, payment: F.Column) -> F.Column:
    """payment over instalment, capped, to 4 digits."""
    ratio = F.when(installment > 0, payment / installment).otherwise(F.lit(0.0))
    return dround(F.least(ratio, F.lit(RATIO_CAP)), 4)


def panel_profile(panel: DataFrame) -> DataFrame:
    """Rows, loans, months per loan, active share."""
    return panel.agg(
        F.count(F.lit(1)).alias("panel_rows"),
        F.count_distinct("loan_id").alias("loans"),
        dround(F.count(F.lit(1)) / F.count_distinct("loan_id"), 1).alias("months_per_loan"),
        dround(F.avg("is_active"), 3).alias("active_share"),
    )


def early_payment_by_label(panel: DataFrame) -> DataFrame:
    """R2: months 1-6 payment ratio, active rate and loans per default flag."""
    return (panel.where(F.col("month_number") <= OBSERVATION_MONTHS)
            .groupBy("default_flag")
            .agg(dround(F.avg("payment_ratio"), 3).alias("avg_payment_ratio"),
                 dround(F.avg("is_active"), 3).alias("avg_active_rate"),
                 F.count_distinct("loan_id").alias("loan_count"))
            .orderBy("default_flag"))
