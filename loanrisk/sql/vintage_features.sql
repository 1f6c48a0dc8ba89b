-- View 3: default rate and size of a loan's quarter; a row a quarter goes back to the loans.
CREATE OR REPLACE TEMPORARY VIEW issued AS
SELECT loan_id, issue_date, date_trunc('QUARTER', month_of(issue_date)) AS issue_quarter, year(month_of(issue_date)) AS issue_year, default_flag
FROM loans JOIN outcomes USING (loan_id);

CREATE OR REPLACE TEMPORARY VIEW vintage_features AS
SELECT loan_id, issue_date, CAST(i.issue_quarter AS TIMESTAMP_NTZ) AS issue_quarter, issue_year, vintage_default_rate, vintage_size
FROM issued i LEFT JOIN (
  SELECT issue_quarter, rounded(avg(default_flag), 4) AS vintage_default_rate, count(*) AS vintage_size
  FROM issued GROUP BY issue_quarter) q ON i.issue_quarter <=> q.issue_quarter;
