-- View 2: payments of months 1 to 6, from monthly_payments.
CREATE OR REPLACE TEMPORARY VIEW payment_features AS
WITH early AS (
  SELECT *, abs(payment_ratio - lag(payment_ratio) OVER (PARTITION BY loan_id ORDER BY month_number)) AS change
  FROM monthly_payments WHERE month_number <= 6
), summed AS (
  SELECT
    loan_id,
    rounded(avg(payment_ratio), 4) AS avg_payment_ratio_m6,
    rounded(min(payment_ratio), 4) AS min_payment_ratio_m6,
    rounded(stddev_samp(payment_ratio), 4) AS payment_volatility_m6,
    sum(is_active) AS active_months_m6,
    as_flag(bool_or(month_number = 6 AND is_active = 1)) AS still_active_m6,
    rounded(avg(if(month_number > 3, payment_ratio, NULL)) - avg(if(month_number > 3, NULL, payment_ratio)), 4) AS payment_trend_m6,
    rounded(any_value(if(month_number = 1, payment_ratio, NULL), true), 4) AS first_month_ratio,
    rounded(any_value(if(month_number = 6, payment_ratio, NULL), true), 4) AS last_month_ratio,
    coalesce(rounded(avg(change), 4), 0.0D) AS avg_monthly_change
  FROM early GROUP BY loan_id
)
SELECT *,
  as_flag(avg_payment_ratio_m6 < 0.95) AS underpayment_flag,
  as_flag(min_payment_ratio_m6 = 0) AS missed_payment_flag,
  as_flag(payment_trend_m6 < -0.1) AS deteriorating_flag,
  as_flag(still_active_m6 = 0) AS early_dropout_flag
FROM summed;
