"""Raw loan records derived from the driver's test tables.

The loan pipeline reads one wide CSV of loan records. The test data is a
TPC-H-like star schema, so this module maps it onto that record, entirely
in Spark (joins + aggregates), so the raw frame grows with the tables:

    loan    <- orders            (one loan per order, k = o_orderkey)
    borrower<- customer          (joined on o_custkey)
    payments<- lineitem          (aggregated per l_orderkey)

Every field comes out as text, exactly as a CSV reader with an all-string
schema would hand it over, so the cleaning step does the same parsing it
does on a real file. The DuckDB twin of this mapping lives in
``loanrisk.plans.oracle`` and must stay expression-for-expression equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanrisk.functions.num import dround

# --- fixed values -----------------------------------------------------------
# Years added to order and ship dates, so 1995-2001 become 2011-2017 and the
# 2016 maturity cut splits the data.
YEAR_SHIFT = 16
# Employment length text by k % 5 ("n/a" is a missing-value token).
EMP_LENGTH_TEXT = ["< 1 year", "3 years", "10+ years", "1 year", "n/a"]
# Home ownership by market segment; ANY and OTHER hit the "else 0" branch.
HOME_BY_SEGMENT = {
    "AUTOMOBILE": "MORTGAGE",
    "BUILDING": "OWN",
    "FURNITURE": "RENT",
    "HOUSEHOLD": "ANY",
    "MACHINERY": "OTHER",
}
# Letter by k % 8; X is not a grade and maps to null.
GRADE_LETTERS = "ABCDEFGX"
# Order status -> loan status when not late and not charged off.
STATUS_BY_ORDER = {"O": "Current", "P": "In Grace Period", "F": "Fully Paid"}
# Loans with k % 53 = 0 (k % 59 = 0) are issued in 2007 (2018), bands of the period report.
YEAR_BY_MODULUS = [(53, "2007"), (59, "2018")]
VERIFICATION = ["Verified", "Source Verified", "Not Verified"]
LATE_STATUS = "Late (31-120 days)"
# ---------------------------------------------------------------------------

RAW_COLUMNS = [
    "id", "issue_d", "loan_amnt", "funded_amnt", "term", "int_rate",
    "installment", "grade", "sub_grade", "purpose", "title", "initial_list_status", "application_type",
    "emp_title", "emp_length", "home_ownership", "annual_inc", "verification_status", "dti", "delinq_2yrs", "earliest_cr_line",
    "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
    "mort_acc", "pub_rec_bankruptcies",
    "loan_status", "out_prncp", "out_prncp_inv", "total_pymnt", "total_rec_prncp", "total_rec_int",
    "total_rec_late_fee", "recoveries", "collection_recovery_fee", "last_pymnt_d", "last_pymnt_amnt",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month_text(ts) -> F.Column:
    return F.date_format(F.add_months(F.to_date(ts), 12 * YEAR_SHIFT), "MMM-yyyy")


def _pick(index: F.Column, values: list[str]) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _decimal_text(hundredths_or_tenths: F.Column, digits: int) -> F.Column:
    """Integer n -> 'n / 10**digits' written with exactly ``digits`` decimals."""
    unit = 10 ** digits
    n = hundredths_or_tenths
    return F.concat(
        F.floor(n / unit).cast("long").cast("string"), F.lit("."),
        F.lpad((n % unit).cast("string"), digits, "0"))


def payment_totals(lineitem: DataFrame) -> DataFrame:
    """Per order: total paid, largest line, last ship date.

    The total is summed in exact integer units of 1/10,000 (price cents x
    discount percent), so it does not depend on summation order.
    """
    units = (F.round(F.col("l_extendedprice") * 100).cast("long")
             * F.round(F.lit(100.0) - F.col("l_discount") * 100).cast("long"))
    return (lineitem.groupBy("l_orderkey")
            .agg(F.sum(units).alias("pay_units"),
                 F.max("l_extendedprice").alias("pay_max_price"),
                 F.max("l_shipdate").alias("pay_last_ship")))


def loan_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``raw_loans``, counted from the footers of the orders."""
    return read_table(spark, sf_dir, "orders").count()


def raw_loans(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The raw wide loan record (all text) for every order in ``sf_dir``. With ``parts``
    the rows come in so many partitions by a hash of ``id``: the few columns that they
    are made of are dealt by it, not the wide records."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    pay = payment_totals(read_table(spark, sf_dir, "lineitem"))

    j = (o.join(pay, o.o_orderkey == pay.l_orderkey, "left")
         .join(c, o.o_custkey == c.c_custkey, "left"))
    if parts:
        j = j.withColumn("_key", F.col("o_orderkey").cast("string")).repartition(parts, "_key")

    k = F.col("o_orderkey")
    term = F.when(k % 3 == 0, F.lit(60.0)).otherwise(F.lit(36.0))
    rate_hundredths = F.lit(500) + (k * 7919) % 2000
    rate_above_base = ((k * 7919) % 2000) / F.lit(100.0)
    late = (F.col("o_orderstatus") == "P") & (k % 10 == 3)
    charged_off = ((k * 104729) % 1000) < (F.lit(60.0) + F.lit(12.0) * rate_above_base)
    status_map = F.create_map(*[x for kv in STATUS_BY_ORDER.items() for x in map(F.lit, kv)])
    home_map = F.create_map(*[x for kv in HOME_BY_SEGMENT.items() for x in map(F.lit, kv)])
    util_tenths = (k * 31) % 1000
    issue = _month_text(F.col("o_orderdate"))
    issue_d = issue
    for modulus, year in reversed(YEAR_BY_MODULUS):
        issue_d = F.when(k % modulus == 0, F.concat(F.substring(issue, 1, 4), F.lit(year))).otherwise(issue_d)
    grade = F.substring(F.lit(GRADE_LETTERS), (k % 8 + 1).cast("int"), 1)

    def txt(c):
        return c.cast("string")

    cols = {
        "id": txt(k),
        "issue_d": issue_d,
        "loan_amnt": txt(F.col("o_totalprice")),
        "funded_amnt": txt(F.col("o_totalprice")),
        "term": F.when(k % 3 == 0, F.lit(" 60 months")).otherwise(F.lit(" 36 months")),
        "int_rate": F.concat(_decimal_text(rate_hundredths, 2), F.lit("%")),
        "installment": txt(dround(F.col("o_totalprice") / term, 2)),
        "grade": grade,
        "sub_grade": F.concat(grade, txt(k % 5 + 1)),
        "purpose": F.col("o_orderpriority"),
        "title": F.col("o_orderpriority"),
        "initial_list_status": F.when(k % 2 == 0, "w").otherwise("f"),
        "application_type": F.when(k % 10 == 0, "Joint App").otherwise("Individual"),
        "emp_title": F.col("c_name"),
        "emp_length": _pick((k % 5).cast("int"), EMP_LENGTH_TEXT),
        "home_ownership": home_map[F.col("c_mktsegment")],
        "annual_inc": txt(F.col("c_acctbal") * F.lit(15.0)),
        "verification_status": _pick((k % 3).cast("int"), VERIFICATION),
        "dti": F.when(k % 97 == 0, F.lit(None).cast("string"))
                .otherwise(txt((k % 450) / F.lit(10.0))),
        "delinq_2yrs": txt(k % 4),
        "earliest_cr_line": F.date_format(F.to_date("o_orderdate"), "MMM-yyyy"),
        "open_acc": txt(k % 20),
        "pub_rec": txt(F.greatest(k % 7 - 4, F.lit(0))),
        "revol_bal": txt(F.col("pay_max_price")),
        "revol_util": F.when(k % 101 == 0, F.lit("bad"))
                       .otherwise(F.concat(_decimal_text(util_tenths, 1), F.lit("%"))),
        "total_acc": txt(k % 50),
        "mort_acc": txt(k % 6),
        "pub_rec_bankruptcies": txt(k % 2),
        "loan_status": F.when(late, F.lit(LATE_STATUS))
                        .when(charged_off & (k % 17 == 0), F.lit("Default"))
                        .when(charged_off, F.lit("Charged Off"))
                        .otherwise(status_map[F.col("o_orderstatus")]),
        "out_prncp": txt((k % 1000) / F.lit(4.0)),
        "out_prncp_inv": txt((k % 1000) / F.lit(4.0)),
        "total_pymnt": txt(F.col("pay_units") / F.lit(10000.0)),
        "total_rec_prncp": txt((k % 5000) / F.lit(2.0)),
        "total_rec_int": txt((k % 300) / F.lit(4.0)),
        "total_rec_late_fee": txt(k % 3),
        "recoveries": txt((k % 11) / F.lit(4.0)),
        "collection_recovery_fee": txt((k % 11) / F.lit(8.0)),
        "last_pymnt_d": _month_text(F.col("pay_last_ship")),
        "last_pymnt_amnt": txt(F.col("pay_max_price")),
    }
    return j.select(*[v.alias(n) for n, v in cols.items()])
