-- View 4: the three others on one row per loan.
CREATE OR REPLACE TEMPORARY VIEW model_features AS
SELECT * FROM origination_features JOIN payment_features USING (loan_id)
JOIN (SELECT * EXCEPT (issue_date) FROM vintage_features) USING (loan_id);

SELECT * FROM model_features;
