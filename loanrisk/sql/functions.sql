-- Rounds as SQL engines do on doubles: scaled, half away from zero; unscaled.
CREATE OR REPLACE TEMPORARY FUNCTION rounded(x DOUBLE, digits INT) RETURNS DOUBLE
  RETURN round(x * power(10, digits), 0) / power(10, digits);

CREATE OR REPLACE TEMPORARY FUNCTION as_flag(yes BOOLEAN) RETURNS INT
  RETURN if(coalesce(yes, false), 1, 0);

CREATE OR REPLACE TEMPORARY FUNCTION month_of(t STRING) RETURNS DATE
  RETURN to_date(t, 'MMM-yyyy');
