"""Scalar column helpers shared by every builder.

All helpers return ``pyspark.sql.Column`` expressions built from
``pyspark.sql.functions`` only, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Text a pandas CSV reader turns into a missing value by default. Our CSV
# reader keeps every field as text, so these become null explicitly.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Loan status -> label. Anything else (late buckets, null) is dropped.
DEFAULT_POSITIVE = ["Charged Off", "Default"]
DEFAULT_NEGATIVE = ["Fully Paid", "Current", "In Grace Period"]
# Letter grade -> 1..7.
GRADES = ["A", "B", "C", "D", "E", "F", "G"]
# Month text format of issue and payment dates, e.g. "Jan-2015".
MONTH_FORMAT = "MMM-yyyy"
# Home ownership ordinal code; anything else is 0.
HOME_OWNERSHIP_CODE = {"MORTGAGE": 3, "OWN": 2, "RENT": 1}
# Scorecard scaling: 600 points at odds 1:19, 20 points double the odds.
BASE_SCORE = 600.0
BASE_ODDS = 1.0 / 19.0
PDO = 20.0
# ---------------------------------------------------------------------------

FACTOR = PDO / math.log(2.0)
OFFSET = BASE_SCORE - FACTOR * math.log(BASE_ODDS)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dround(c: str | Column, k: int) -> Column:
    """ROUND(x, k) on a double as SQL engines do it: scale, round half away
    from zero on the scaled value, unscale.

    ``F.round(x, k)`` rounds the printed decimal instead, which breaks ties
    differently (0.00015 -> 0.0002 there, 0.0001 here).
    """
    scale = float(10 ** k)
    return F.round(col(c) * F.lit(scale), 0) / F.lit(scale)


def null_token(c: str | Column) -> Column:
    """Map the CSV reader's missing-value tokens to null, keep other text."""
    c = col(c)
    return F.when(c.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def no_nan(c: str | Column) -> Column:
    """NaN -> null, so comparisons and averages behave like SQL nulls."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def first_number(c: str | Column) -> Column:
    """First run of digits as double: ' 36 months' -> 36.0, '< 1 year' -> 1.0."""
    return F.nullif(F.regexp_extract(col(c), r"(\d+)", 1), F.lit("")).cast("double")


def percent_strict(c: str | Column) -> Column:
    """'13.56%' -> 13.56; malformed text raises (ANSI cast)."""
    return F.replace(col(c), F.lit("%"), F.lit("")).cast("double")


def percent_lenient(c: str | Column) -> Column:
    """'54.3%' -> 54.3; malformed text -> null (never NaN)."""
    return no_nan(F.replace(col(c), F.lit("%"), F.lit("")).try_cast("double"))


def grade_number(c: str | Column) -> Column:
    """A..G -> 1.0..7.0, anything else null."""
    m = F.create_map(*[x for i, g in enumerate(GRADES) for x in (F.lit(g), F.lit(float(i + 1)))])
    return m[col(c)]


def month_date(c: str | Column) -> Column:
    """Strict 'Jan-2015' -> 2015-01-01 (malformed text raises)."""
    return F.to_date(col(c), MONTH_FORMAT)


def month_date_lenient(c: str | Column) -> Column:
    """Lenient 'Jan-2015' -> date, malformed -> null."""
    return F.try_to_date(col(c), MONTH_FORMAT)


def months_apart(later: str | Column, earlier: str | Column) -> Column:
    """Whole calendar months from ``earlier`` to ``later`` (both month starts)."""
    later, earlier = col(later), col(earlier)
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 otherwise (null compares go to 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def emp_stability(years: str | Column) -> Column:
    y = col(years)
    return (F.when(y >= 10, "senior").when(y >= 3, "established")
            .when(y >= 1, "early").otherwise("new"))


def home_ownership_code(c: str | Column) -> Column:
    c = col(c)
    out = F.lit(0)
    for name, code in reversed(list(HOME_OWNERSHIP_CODE.items())):
        out = F.when(c == name, F.lit(code)).otherwise(out)
    return out


def iv_strength(iv: str | Column) -> Column:
    v = col(iv)
    return (F.when(v > 0.3, "strong").when(v > 0.1, "medium")
            .when(v > 0.02, "weak").otherwise("useless"))


def log_odds_to_points(x: str | Column) -> Column:
    """Scorecard points: OFFSET + FACTOR * log-odds (higher = riskier)."""
    return F.lit(OFFSET) + F.lit(FACTOR) * col(x)


def points_to_pd(s: str | Column) -> Column:
    """As published: 1 / (1 + exp((s - OFFSET) / FACTOR)), i.e. 1 - sigmoid(x)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp((col(s) - F.lit(OFFSET)) / F.lit(FACTOR)))


def points_to_pd_consistent(s: str | Column) -> Column:
    """Inverse of ``log_odds_to_points`` followed by the sigmoid."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(col(s) - F.lit(OFFSET)) / F.lit(FACTOR)))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def integer_points(x: str | Column) -> Column:
    """Round half to even, as numpy does, then int."""
    return F.rint(col(x)).cast("int")


def income_band(inc: str | Column) -> Column:
    """Right-closed bands (0,40k] (40k,70k] (70k,100k] (100k,inf); else null."""
    v = col(inc)
    return (F.when((v > 0) & (v <= 40000), "<40k")
            .when((v > 40000) & (v <= 70000), "40-70k")
            .when((v > 70000) & (v <= 100000), "70-100k")
            .when(v > 100000, ">100k"))


def metric_safe(c: str | Column) -> Column:
    """'<40k' -> 'lt40k', '>100k' -> 'gt100k', '40-70k' -> '40_70k'."""
    return F.replace(F.replace(F.replace(col(c), F.lit("<"), F.lit("lt")),
                               F.lit(">"), F.lit("gt")), F.lit("-"), F.lit("_"))
