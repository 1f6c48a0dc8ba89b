"""Raw loan records -> loans, borrowers, outcomes.

All steps are narrow projections and filters: no shuffle. The three table
builders read the same labelled frame; on a cluster, write them in one job
(``loanrisk.sources.io.write_tables``) so the raw scan happens once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loanrisk.functions.num import (DEFAULT_NEGATIVE, DEFAULT_POSITIVE, dround, first_number,
                                    grade_number, null_token, percent_lenient,
                                    percent_strict)

# --- fixed values -----------------------------------------------------------
# Raw columns per output table, in output order; absent ones are skipped.
LOAN_COLS = [
    "id", "issue_d", "loan_amnt", "funded_amnt", "term", "int_rate",
    "installment", "grade", "sub_grade", "purpose", "title",
    "initial_list_status", "application_type",
]
BORROWER_COLS = [
    "id", "emp_title", "emp_length", "home_ownership", "annual_inc",
    "verification_status", "dti", "delinq_2yrs", "earliest_cr_line",
    "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
    "mort_acc", "pub_rec_bankruptcies",
]
OUTCOME_COLS = [
    "id", "loan_status", "out_prncp", "out_prncp_inv", "total_pymnt",
    "total_rec_prncp", "total_rec_int", "total_rec_late_fee", "recoveries",
    "collection_recovery_fee", "last_pymnt_d", "last_pymnt_amnt",
]
RENAMES = {"id": "loan_id", "issue_d": "issue_date"}
# Raw columns that hold plain numbers (parsed leniently: junk -> null).
NUMERIC_COLS = {
    "loan_amnt", "funded_amnt", "installment", "annual_inc", "dti",
    "delinq_2yrs", "open_acc", "pub_rec", "revol_bal", "total_acc",
    "mort_acc", "pub_rec_bankruptcies", "out_prncp", "out_prncp_inv",
    "total_pymnt", "total_rec_prncp", "total_rec_int", "total_rec_late_fee",
    "recoveries", "collection_recovery_fee", "last_pymnt_amnt",
}
# ---------------------------------------------------------------------------


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Missing-value tokens -> null on every text column."""
    return raw.select(*[
        null_token(F.col(c)).alias(c) if t == "string" else F.col(c)
        for c, t in raw.dtypes
    ])


def clean_id(raw: DataFrame) -> DataFrame:
    """Drop rows without an id; id is trimmed text."""
    return (raw.where(F.col("id").isNotNull())
            .withColumn("id", F.trim(F.col("id").cast("string"))))


def default_flag_expr(status: str = "loan_status") -> F.Column:
    s = F.col(status)
    return (F.when(s.isin(DEFAULT_POSITIVE), F.lit(1))
            .when(s.isin(DEFAULT_NEGATIVE), F.lit(0)))


def add_default_flag(df: DataFrame) -> DataFrame:
    """Label 1/0 from the status; unknown statuses (and null) are dropped."""
    return (df.withColumn("default_flag", default_flag_expr())
            .where(F.col("default_flag").isNotNull()))


def labelled(raw: DataFrame, audit: Observation | None = None) -> DataFrame:
    """Raw records -> cleaned, labelled records (P3 then P4). With ``audit``, the counts
    of ``ingest_audit`` are observed on the way, by the job that writes the result."""
    clean = normalise_raw(raw)
    if audit is not None:
        # an observed frame keeps all its columns: only those that go on
        clean = normalise_raw(raw.select(*present(raw, list(dict.fromkeys(["id", *LOAN_COLS, *BORROWER_COLS, *OUTCOME_COLS])))))
        clean = clean.observe(audit, *audit_counts())
    return add_default_flag(clean_id(clean))


def typed_records(df: DataFrame) -> DataFrame:
    """Labelled raw records -> typed records, every field parsed once: numbers
    (leniently: junk and NaN -> null), int_rate (F2, strict), revol_util (F3,
    lenient), term_months (F1), emp_length_years (F5), grade_numeric (F4)."""
    wanted = present(df, list(dict.fromkeys(LOAN_COLS + BORROWER_COLS + OUTCOME_COLS + ["default_flag"])))
    parsers = {**{c: lenient_number for c in NUMERIC_COLS}, **PARSERS}
    cols = [parsers[c](F.col(c)).alias(c) if c in parsers else F.col(c) for c in wanted]
    derived = [parse(F.col(c)).alias(name) for name, (c, parse) in DERIVED.items() if c in wanted]
    return df.select(*cols, *derived).withColumnsRenamed({k: v for k, v in RENAMES.items() if k in wanted})


def lenient_number(c: F.Column) -> F.Column:
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


# Percent fields, and columns derived from others.
PARSERS = {"int_rate": percent_strict, "revol_util": percent_lenient}
DERIVED = {
    "term_months": ("term", first_number),
    "grade_numeric": ("grade", grade_number),
    "emp_length_years": ("emp_length", first_number),
}


def _columns_of(records: DataFrame, wanted: list[str], derived: list[str]) -> DataFrame:
    return records.select(*present(records, [RENAMES.get(c, c) for c in wanted] + derived))


def loans_of(records: DataFrame) -> DataFrame:
    """The loans table: loan columns, term_months, grade_numeric."""
    return _columns_of(records, LOAN_COLS, ["term_months", "grade_numeric"])


def borrowers_of(records: DataFrame) -> DataFrame:
    """The borrowers table: borrower columns, emp_length_years."""
    return _columns_of(records, BORROWER_COLS, ["emp_length_years"])


def outcomes_of(records: DataFrame) -> DataFrame:
    """The outcomes table: outcome columns, default_flag."""
    return _columns_of(records, OUTCOME_COLS, ["default_flag"])


def build_loans(df: DataFrame) -> DataFrame:
    """Labelled raw records -> loans."""
    return loans_of(typed_records(df))


def build_borrowers(df: DataFrame) -> DataFrame:
    """Labelled raw records -> borrowers."""
    return borrowers_of(typed_records(df))


def build_outcomes(df: DataFrame) -> DataFrame:
    """Labelled raw records -> outcomes."""
    return outcomes_of(typed_records(df))


def audit_counts() -> list[F.Column]:
    """Rows read, dropped per rule, kept, and defaults, over normalised raw records."""
    flag = default_flag_expr()
    has_id = F.col("id").isNotNull()
    kept = has_id & flag.isNotNull()
    return [
        F.count(F.lit(1)).alias("rows_read"),
        F.sum(F.when(~has_id, 1).otherwise(0)).cast("long").alias("dropped_null_id"),
        F.sum(F.when(has_id & flag.isNull(), 1).otherwise(0)).cast("long").alias("dropped_status"),
        F.sum(F.when(kept, 1).otherwise(0)).cast("long").alias("rows_kept"),
        F.sum(F.when(kept, flag)).cast("long").alias("defaults"),
    ]


AUDIT_SCHEMA = "rows_read long, dropped_null_id long, dropped_status long, rows_kept long, defaults long"


def with_default_rate(audit: DataFrame) -> DataFrame:
    return audit.withColumn("default_rate", dround(F.col("defaults") / F.col("rows_kept"), 4))


def ingest_audit(raw: DataFrame) -> DataFrame:
    """Rows read, dropped per rule, kept, default rate - one pass of its own."""
    return with_default_rate(normalise_raw(raw).agg(*audit_counts()))


def observed_audit(spark: SparkSession, audit: Observation) -> DataFrame:
    """R10 as observed while the records were written: no pass over the raw records."""
    return with_default_rate(spark.createDataFrame([audit.get], AUDIT_SCHEMA))
