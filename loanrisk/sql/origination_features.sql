/* View 1: what is known when a loan is issued.
   Reads loans, borrowers, outcomes; thresholds: 28 % of income, 75 % of the credit line. */
CREATE OR REPLACE TEMPORARY VIEW origination_features AS
WITH facts AS (
  SELECT * FROM loans NATURAL JOIN borrowers NATURAL JOIN (SELECT loan_id, default_flag FROM outcomes)
  WHERE loan_amnt > 0 AND annual_inc > 0 AND dti IS NOT NULL
)
SELECT
  loan_id, issue_date, grade, grade_numeric, term_months, int_rate, loan_amnt, installment, purpose,
  annual_inc, dti, revol_util, revol_bal, delinq_2yrs, open_acc, pub_rec, total_acc, mort_acc, pub_rec_bankruptcies,
  rounded(loan_amnt / annual_inc, 4) AS loan_to_income,
  rounded(12 * installment / annual_inc, 4) AS payment_to_income,
  as_flag(dti > 28) AS high_dti_flag,
  as_flag(revol_util > 75) AS high_util_flag,
  as_flag(delinq_2yrs > 0) AS prior_delinq_flag,
  as_flag(pub_rec > 0) AS public_record_flag,
  as_flag(dti > 28 AND revol_util > 75) AS dual_stress_flag,
  emp_length_years,
  -- the last band that the years of employment reach
  array('new', 'early', 'established', 'senior')[as_flag(emp_length_years >= 1) + as_flag(emp_length_years >= 3) + as_flag(emp_length_years >= 10)] AS emp_stability,
  home_ownership,
  coalesce(map('MORTGAGE', 3, 'OWN', 2, 'RENT', 1)[home_ownership], 0) AS home_ownership_enc,
  default_flag
FROM facts;
