"""DuckDB SQL twins of the Spark builders, for the correctness gate.

Each constant is one CTE body over the pre-registered test views
(orders, customer, lineitem ...). ``with_ctes(names, select)`` assembles a
statement that defines just the CTEs a query needs, in dependency order.
The Spark side must compute the same values; types are cast to match.
"""

from __future__ import annotations

# Raw loan record: the twin of loanrisk.sources.fixtures.raw_loans (text fields).
RAW = r"""
SELECT
  CAST(o.o_orderkey AS VARCHAR) AS id,
  CASE WHEN o.o_orderkey % 53 = 0 THEN strftime(CAST(o.o_orderdate AS DATE), '%b-') || '2007'
       WHEN o.o_orderkey % 59 = 0 THEN strftime(CAST(o.o_orderdate AS DATE), '%b-') || '2018'
       ELSE strftime(CAST(o.o_orderdate AS DATE) + INTERVAL 16 YEAR, '%b-%Y') END AS issue_d,
  o.o_totalprice AS loan_amnt,
  o.o_totalprice AS funded_amnt,
  CASE WHEN o.o_orderkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
  CAST((500 + (o.o_orderkey * 7919) % 2000) // 100 AS VARCHAR) || '.' ||
    lpad(CAST((500 + (o.o_orderkey * 7919) % 2000) % 100 AS VARCHAR), 2, '0') || '%' AS int_rate,
  round(o.o_totalprice / CASE WHEN o.o_orderkey % 3 = 0 THEN 60.0::DOUBLE ELSE 36.0::DOUBLE END, 2) AS installment,
  substr('ABCDEFGX', CAST(o.o_orderkey % 8 + 1 AS INTEGER), 1) AS grade,
  substr('ABCDEFGX', CAST(o.o_orderkey % 8 + 1 AS INTEGER), 1) || CAST(o.o_orderkey % 5 + 1 AS VARCHAR) AS sub_grade,
  o.o_orderpriority AS purpose,
  o.o_orderpriority AS title,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'w' ELSE 'f' END AS initial_list_status,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'Joint App' ELSE 'Individual' END AS application_type,
  c.c_name AS emp_title,
  CASE o.o_orderkey % 5 WHEN 0 THEN '< 1 year' WHEN 1 THEN '3 years' WHEN 2 THEN '10+ years'
       WHEN 3 THEN '1 year' ELSE 'n/a' END AS emp_length,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'MORTGAGE' WHEN 'BUILDING' THEN 'OWN'
       WHEN 'FURNITURE' THEN 'RENT' WHEN 'HOUSEHOLD' THEN 'ANY' WHEN 'MACHINERY' THEN 'OTHER' END
    AS home_ownership,
  c.c_acctbal * 15.0::DOUBLE AS annual_inc,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Source Verified' ELSE 'Not Verified' END AS verification_status,
  strftime(CAST(o.o_orderdate AS DATE), '%b-%Y') AS earliest_cr_line,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE (o.o_orderkey % 450) / 10.0::DOUBLE END AS dti,
  CAST(o.o_orderkey % 4 AS DOUBLE) AS delinq_2yrs,
  CAST(o.o_orderkey % 20 AS DOUBLE) AS open_acc,
  CAST(greatest(o.o_orderkey % 7 - 4, 0) AS DOUBLE) AS pub_rec,
  p.pay_max_price AS revol_bal,
  CASE WHEN o.o_orderkey % 101 = 0 THEN 'bad'
       ELSE CAST(((o.o_orderkey * 31) % 1000) // 10 AS VARCHAR) || '.' ||
            CAST(((o.o_orderkey * 31) % 1000) % 10 AS VARCHAR) || '%' END AS revol_util,
  CAST(o.o_orderkey % 50 AS DOUBLE) AS total_acc,
  CAST(o.o_orderkey % 6 AS DOUBLE) AS mort_acc,
  CAST(o.o_orderkey % 2 AS DOUBLE) AS pub_rec_bankruptcies,
  CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 10 = 3 THEN 'Late (31-120 days)'
       WHEN (o.o_orderkey * 104729) % 1000 < 60.0::DOUBLE + 12.0::DOUBLE * (((o.o_orderkey * 7919) % 2000) / 100.0::DOUBLE)
         THEN CASE WHEN o.o_orderkey % 17 = 0 THEN 'Default' ELSE 'Charged Off' END
       WHEN o.o_orderstatus = 'O' THEN 'Current'
       WHEN o.o_orderstatus = 'P' THEN 'In Grace Period'
       WHEN o.o_orderstatus = 'F' THEN 'Fully Paid' END AS loan_status,
  (o.o_orderkey % 1000) / 4.0::DOUBLE AS out_prncp,
  (o.o_orderkey % 1000) / 4.0::DOUBLE AS out_prncp_inv,
  p.pay_units / 10000.0::DOUBLE AS total_pymnt,
  (o.o_orderkey % 5000) / 2.0::DOUBLE AS total_rec_prncp,
  (o.o_orderkey % 300) / 4.0::DOUBLE AS total_rec_int,
  CAST(o.o_orderkey % 3 AS DOUBLE) AS total_rec_late_fee,
  (o.o_orderkey % 11) / 4.0::DOUBLE AS recoveries,
  (o.o_orderkey % 11) / 8.0::DOUBLE AS collection_recovery_fee,
  strftime(CAST(p.pay_last_ship AS DATE) + INTERVAL 16 YEAR, '%b-%Y') AS last_pymnt_d,
  p.pay_max_price AS last_pymnt_amnt
FROM orders o
LEFT JOIN (
  SELECT l_orderkey,
         SUM(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(100.0 - l_discount * 100) AS BIGINT)) AS pay_units,
         MAX(l_extendedprice) AS pay_max_price,
         MAX(l_shipdate) AS pay_last_ship
  FROM lineitem GROUP BY l_orderkey
) p ON o.o_orderkey = p.l_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
"""

LABELLED = """
SELECT *,
  CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1
       WHEN loan_status IN ('Fully Paid', 'Current', 'In Grace Period') THEN 0 END AS default_flag
FROM raw
WHERE id IS NOT NULL
  AND (CASE WHEN loan_status IN ('Charged Off', 'Default') THEN 1
            WHEN loan_status IN ('Fully Paid', 'Current', 'In Grace Period') THEN 0 END) IS NOT NULL
"""

LOANS = r"""
SELECT trim(id) AS loan_id, issue_d AS issue_date, loan_amnt, funded_amnt, term,
  CAST(replace(int_rate, '%', '') AS DOUBLE) AS int_rate,
  installment, grade, sub_grade, purpose, title, initial_list_status, application_type,
  CAST(NULLIF(regexp_extract(term, '(\d+)', 1), '') AS DOUBLE) AS term_months,
  CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 2.0 WHEN 'C' THEN 3.0 WHEN 'D' THEN 4.0
             WHEN 'E' THEN 5.0 WHEN 'F' THEN 6.0 WHEN 'G' THEN 7.0 END::DOUBLE AS grade_numeric
FROM labelled
"""

BORROWERS = r"""
SELECT trim(id) AS loan_id, emp_title,
  CASE WHEN emp_length = 'n/a' THEN NULL ELSE emp_length END AS emp_length,
  home_ownership, annual_inc, verification_status, dti, delinq_2yrs, earliest_cr_line, open_acc, pub_rec, revol_bal,
  TRY_CAST(replace(revol_util, '%', '') AS DOUBLE) AS revol_util,
  total_acc, mort_acc, pub_rec_bankruptcies,
  CAST(NULLIF(regexp_extract(CASE WHEN emp_length = 'n/a' THEN NULL ELSE emp_length END, '(\d+)', 1), '') AS DOUBLE)
    AS emp_length_years
FROM labelled
"""

OUTCOMES = """
SELECT trim(id) AS loan_id, loan_status, out_prncp, out_prncp_inv, total_pymnt, total_rec_prncp, total_rec_int,
       total_rec_late_fee, recoveries, collection_recovery_fee, last_pymnt_d, last_pymnt_amnt,
       CAST(default_flag AS INTEGER) AS default_flag
FROM labelled
"""

SCHEDULE = """
SELECT loan_id, installment, default_flag, issue, term,
  CASE WHEN last IS NULL OR last < issue THEN 0
       ELSE least((year(last) - year(issue)) * 12 + (month(last) - month(issue)) + 1, term) END AS active,
  total
FROM (
  SELECT l.loan_id, l.installment, o.default_flag,
         CAST(strptime(l.issue_date, '%b-%Y') AS DATE) AS issue,
         CAST(try_strptime(o.last_pymnt_d, '%b-%Y') AS DATE) AS last,
         CAST(trunc(l.term_months) AS INTEGER) AS term,
         COALESCE(o.total_pymnt, 0.0) AS total
  FROM loans l JOIN outcomes o USING (loan_id)
  WHERE l.term_months IS NOT NULL AND l.installment > 0 AND l.issue_date IS NOT NULL
) s
"""


def _panel_sql(max_month: int | None) -> str:
    upper = "term" if max_month is None else f"least(term, {int(max_month)})"
    return f"""
SELECT loan_id, CAST(month_number AS INTEGER) AS month_number,
  CAST(issue + to_months(month_number - 1) AS TIMESTAMP_NS) AS month_date,
  round(installment, 2) AS expected_payment,
  round(CASE WHEN month_number <= active THEN per_month ELSE 0.0 END, 2) AS estimated_payment,
  round(least(CASE WHEN installment > 0
                   THEN (CASE WHEN month_number <= active THEN per_month ELSE 0.0 END) / installment
                   ELSE 0.0 END, 2.0), 4) AS payment_ratio,
  CAST(month_number <= active AS INTEGER) AS is_active,
  default_flag
FROM (
  SELECT *, CASE WHEN active > 0 THEN total / active ELSE 0.0 END AS per_month,
         unnest(generate_series(1, {upper})) AS month_number
  FROM schedule WHERE {upper} >= 1
) g
"""


PANEL = _panel_sql(None)
PANEL6 = _panel_sql(6)

ORIGINATION = """
SELECT l.loan_id, l.issue_date, l.grade, l.grade_numeric, l.term_months, l.int_rate,
  l.loan_amnt, l.installment, l.purpose, b.annual_inc, b.dti, b.revol_util, b.revol_bal,
  b.delinq_2yrs, b.open_acc, b.pub_rec, b.total_acc, b.mort_acc, b.pub_rec_bankruptcies,
  CASE WHEN b.annual_inc > 0 THEN round(l.loan_amnt / b.annual_inc, 4) END AS loan_to_income,
  CASE WHEN b.annual_inc > 0 THEN round(l.installment * 12 / b.annual_inc, 4) END AS payment_to_income,
  CASE WHEN b.dti > 28 THEN 1 ELSE 0 END AS high_dti_flag,
  CASE WHEN b.revol_util > 75 THEN 1 ELSE 0 END AS high_util_flag,
  CASE WHEN b.delinq_2yrs > 0 THEN 1 ELSE 0 END AS prior_delinq_flag,
  CASE WHEN b.pub_rec > 0 THEN 1 ELSE 0 END AS public_record_flag,
  CASE WHEN b.dti > 28 AND b.revol_util > 75 THEN 1 ELSE 0 END AS dual_stress_flag,
  b.emp_length_years,
  CASE WHEN b.emp_length_years >= 10 THEN 'senior' WHEN b.emp_length_years >= 3 THEN 'established'
       WHEN b.emp_length_years >= 1 THEN 'early' ELSE 'new' END AS emp_stability,
  b.home_ownership,
  CASE b.home_ownership WHEN 'MORTGAGE' THEN 3 WHEN 'OWN' THEN 2 WHEN 'RENT' THEN 1 ELSE 0 END
    AS home_ownership_enc,
  o.default_flag
FROM loans l JOIN borrowers b USING (loan_id) JOIN outcomes o USING (loan_id)
WHERE l.loan_amnt > 0 AND b.annual_inc > 0 AND b.dti IS NOT NULL
"""

# One pass: the lag is taken first, then a single GROUP BY per loan.
PAYMENT_FEATURES = """
SELECT g.*,
  CASE WHEN g.avg_payment_ratio_m6 < 0.95 THEN 1 ELSE 0 END AS underpayment_flag,
  CASE WHEN g.min_payment_ratio_m6 = 0 THEN 1 ELSE 0 END AS missed_payment_flag,
  CASE WHEN g.payment_trend_m6 < -0.1 THEN 1 ELSE 0 END AS deteriorating_flag,
  CASE WHEN g.still_active_m6 = 0 THEN 1 ELSE 0 END AS early_dropout_flag
FROM (
  SELECT loan_id,
    round(avg(payment_ratio), 4) AS avg_payment_ratio_m6,
    round(min(payment_ratio), 4) AS min_payment_ratio_m6,
    round(stddev_samp(payment_ratio), 4) AS payment_volatility_m6,
    CAST(sum(is_active) AS BIGINT) AS active_months_m6,
    max(CASE WHEN month_number = 6 THEN is_active ELSE 0 END) AS still_active_m6,
    round(avg(CASE WHEN month_number >= 4 THEN payment_ratio END)
          - avg(CASE WHEN month_number <= 3 THEN payment_ratio END), 4) AS payment_trend_m6,
    round(avg(CASE WHEN month_number = 1 THEN payment_ratio END), 4) AS first_month_ratio,
    round(avg(CASE WHEN month_number = 6 THEN payment_ratio END), 4) AS last_month_ratio,
    coalesce(round(avg(abs(payment_ratio - prev_ratio))
                   FILTER (WHERE month_number > 1 AND prev_ratio IS NOT NULL), 4), 0.0)
      AS avg_monthly_change
  FROM (SELECT *, lag(payment_ratio) OVER (PARTITION BY loan_id ORDER BY month_number) AS prev_ratio
        FROM obs) x
  GROUP BY loan_id
) g
"""

OBS = "SELECT * FROM panel6 WHERE month_number <= 6"

# Aggregate per quarter, then attach it to each loan.
VINTAGE = """
SELECT lo.loan_id, lo.issue_date, lo.issue_quarter, lo.issue_year,
       st.vintage_default_rate, st.vintage_size
FROM (SELECT loan_id, issue_date, default_flag,
             CAST(date_trunc('quarter', strptime(issue_date, '%b-%Y')) AS TIMESTAMP_NS) AS issue_quarter,
             CAST(year(strptime(issue_date, '%b-%Y')) AS INTEGER) AS issue_year
      FROM loans JOIN outcomes USING (loan_id)) lo
LEFT JOIN (SELECT CAST(date_trunc('quarter', strptime(issue_date, '%b-%Y')) AS TIMESTAMP_NS) AS q,
                  round(avg(default_flag), 4) AS vintage_default_rate, count(*) AS vintage_size
           FROM loans JOIN outcomes USING (loan_id) GROUP BY 1) st
  ON lo.issue_quarter IS NOT DISTINCT FROM st.q
"""

MODEL_FEATURES = """
SELECT o.*, p.* EXCLUDE (loan_id), v.* EXCLUDE (loan_id, issue_date)
FROM origination_features o
JOIN payment_features p USING (loan_id)
JOIN vintage_features v USING (loan_id)
"""

# name -> (body, dependencies)
CTES: dict[str, tuple[str, list[str]]] = {
    "raw": (RAW, []),
    "labelled": (LABELLED, ["raw"]),
    "loans": (LOANS, ["labelled"]),
    "borrowers": (BORROWERS, ["labelled"]),
    "outcomes": (OUTCOMES, ["labelled"]),
    "schedule": (SCHEDULE, ["loans", "outcomes"]),
    "panel": (PANEL, ["schedule"]),
    "panel6": (PANEL6, ["schedule"]),
    "obs": (OBS, ["panel6"]),
    "origination_features": (ORIGINATION, ["loans", "borrowers", "outcomes"]),
    "payment_features": (PAYMENT_FEATURES, ["obs"]),
    "vintage_features": (VINTAGE, ["loans", "outcomes"]),
    "model_features": (MODEL_FEATURES, ["origination_features", "payment_features",
                                        "vintage_features"]),
}


def _order(names: list[str], extra: dict[str, tuple[str, list[str]]]) -> list[str]:
    table = {**CTES, **extra}
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in table[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(names: list[str], select: str,
              extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """``WITH <needed CTEs> <select>``; ``extra`` adds query-local CTEs."""
    extra = extra or {}
    table = {**CTES, **extra}
    order = _order(names, extra)
    body = ",\n".join(f"{n} AS ({table[n][0]})" for n in order)
    return f"WITH {body}\n{select}"
