"""Hand-made panel and feature fixtures (FIXTURES.md section 3) and plan shape."""

import re

from pyspark.sql import functions as F

from loanrisk.operators import features, panel

LOANS = "loan_id string, issue_date string, term_months double, installment double"
OUTS = ("loan_id string, total_pymnt double, last_pymnt_d string, last_pymnt_amnt double, "
        "default_flag int")


def frames(spark, loans, outs):
    return spark.createDataFrame(loans, LOANS), spark.createDataFrame(outs, OUTS)


def by_loan(rows):
    out = {}
    for r in rows:
        out.setdefault(r["loan_id"], []).append(r)
    return out


def test_panel_edge_cases(spark):
    loans, outs = frames(spark, [
        ("never", "Jan-2015", 36.0, 100.0),
        ("before", "Jan-2015", 36.0, 100.0),
        ("cap", "Jan-2015", 36.0, 100.0),
        ("past", "Jan-2015", 36.0, 100.0),
        ("zero_term", "Jan-2015", 0.0, 100.0),
        ("no_inst", "Jan-2015", 36.0, 0.0),
    ], [
        ("never", None, None, None, 1),
        ("before", 500.0, "Jan-2014", 10.0, 0),
        ("cap", 1e9, "Mar-2015", 10.0, 0),
        ("past", 3600.0, "Sep-2021", 10.0, 0),
        ("zero_term", 10.0, "Jan-2016", 1.0, 0),
        ("no_inst", 10.0, "Jan-2016", 1.0, 0),
    ])
    p = by_loan(panel.monthly_panel(loans, outs).collect())
    assert set(p) == {"never", "before", "cap", "past"}
    never = p["never"]
    assert len(never) == 36 and all(r.is_active == 0 and r.payment_ratio == 0 for r in never)
    assert all(r.is_active == 0 for r in p["before"])
    cap = sorted(p["cap"], key=lambda r: r.month_number)
    assert [r.is_active for r in cap[:4]] == [1, 1, 1, 0] and cap[0].payment_ratio == 2.0
    assert sum(r.is_active for r in p["past"]) == 36
    assert sorted(r.month_number for r in p["past"]) == list(range(1, 37))
    import datetime as dt
    assert sorted(p["past"], key=lambda r: r.month_number)[13].month_date == dt.datetime(2016, 2, 1)


def test_panel_rows_equal_terms_and_payments_add_up(spark):
    rows_l, rows_o = [], []
    for i in range(40):
        term = 36.0 if i % 2 else 60.0
        rows_l.append((f"L{i}", "Mar-2014", term, 50.0 + i))
        rows_o.append((f"L{i}", 1000.0 + 37 * i, f"{['Jan', 'Jun', 'Dec'][i % 3]}-2016", 5.0, i % 2))
    loans, outs = frames(spark, rows_l, rows_o)
    p = panel.monthly_panel(loans, outs)
    assert p.count() == sum(int(r[2]) for r in rows_l)
    got = {r["loan_id"]: r["s"] for r in p.groupBy("loan_id").agg(F.sum("estimated_payment").alias("s")).collect()}
    for lid, total, *_ in rows_o:
        assert abs(got[lid] - total) < 0.01 * 60


def test_payment_feature_edges(spark):
    loans, outs = frames(spark, [
        ("one_month", "Jan-2015", 1.0, 100.0),
        ("three", "Jan-2015", 3.0, 100.0),
        ("six", "Jan-2015", 36.0, 100.0),
    ], [
        ("one_month", 100.0, "Jan-2015", 1.0, 0),
        ("three", 300.0, "Mar-2015", 1.0, 0),
        ("six", 250.0, "Feb-2015", 1.0, 1),
    ])
    f = {r["loan_id"]: r for r in features.payment_features_from_tables(loans, outs).collect()}
    assert f["one_month"].payment_volatility_m6 is None          # one row: null
    assert f["one_month"].avg_monthly_change == 0.0              # no lag pairs -> 0
    assert f["three"].payment_trend_m6 is None and f["three"].deteriorating_flag == 0
    six = f["six"]
    assert six.active_months_m6 == 2 and six.still_active_m6 == 0 and six.early_dropout_flag == 1
    assert six.first_month_ratio == 1.25 and six.min_payment_ratio_m6 == 0.0
    assert six.missed_payment_flag == 1
    # lag-based change: |1.25-1.25|, |0-1.25|, 0, 0, 0 over months 2..6
    assert six.avg_monthly_change == 0.25


def test_flags_on_nulls(spark):
    loans = spark.createDataFrame(
        [("a", "Jan-2015", "B", 2.0, 36.0, 10.0, 1000.0, 30.0, "car")],
        "loan_id string, issue_date string, grade string, grade_numeric double, term_months double, "
        "int_rate double, loan_amnt double, installment double, purpose string")
    bor = spark.createDataFrame(
        [("a", 50000.0, 10.0, None, None, None, None, None, None, None, None, None, "RENT")],
        "loan_id string, annual_inc double, dti double, revol_util double, revol_bal double, "
        "delinq_2yrs double, open_acc double, pub_rec double, total_acc double, mort_acc double, "
        "pub_rec_bankruptcies double, emp_length_years double, home_ownership string")
    outs = spark.createDataFrame([("a", 0)], "loan_id string, default_flag int")
    r = features.origination_features(loans, bor, outs).first()
    assert (r.high_util_flag, r.dual_stress_flag, r.prior_delinq_flag) == (0, 0, 0)
    assert r.emp_stability == "new" and r.home_ownership_enc == 1
    assert r.loan_to_income == 0.02


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_payment_features_single_exchange(spark):
    """Window (lag) and aggregate share the loan_id clustering of the join."""
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(features.payment_features_from_tables(t.loans, t.outcomes))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # bucketed tables: the join, the lag window and the groupBy need no exchange
    assert plan.count("Exchange hashpartitioning") == 0, plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_vintage_uses_bounded_broadcast(spark):
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    plan = _plan(features.vintage_features(t.loans, t.outcomes))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_one_row_forms_equal_join_forms(spark):
    """Typed records (one row per loan) give what the joins of the three tables give."""
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    pairs = [
        (features.model_features_of(t.records), features.model_features(t.loans, t.borrowers, t.outcomes)),
        (features.model_features_of(t.records), features.model_features(t.loans, t.borrowers, t.outcomes, t.panel)),
        (features.origination_of(t.records), features.origination_features(t.loans, t.borrowers, t.outcomes)),
        (features.vintage_of(t.records), features.vintage_features(t.loans, t.outcomes)),
        (panel.monthly_panel_of(t.records), panel.monthly_panel(t.loans, t.outcomes)),
    ]
    for a, b in pairs:
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_one_row_payment_edges(spark):
    rows = [("one_month", "Jan-2015", 1.0, 100.0, 100.0, "Jan-2015"), ("three", "Jan-2015", 3.0, 100.0, 300.0, "Mar-2015"),
            ("six", "Jan-2015", 36.0, 100.0, 250.0, "Feb-2015"), ("zero_term", "Jan-2015", 0.0, 100.0, 1.0, None),
            ("unpaid", "Jan-2015", 36.0, 100.0, None, None), ("junk_date", "Jan-2015", 36.0, 100.0, 5.0, "13-2015")]
    df = spark.createDataFrame(rows, "loan_id string, issue_date string, term_months double, installment double, "
                                     "total_pymnt double, last_pymnt_d string")
    f = {r["loan_id"]: r for r in features.payment_columns_of(df).collect()}
    assert set(f) == {"one_month", "three", "six", "unpaid", "junk_date"}
    assert f["one_month"].payment_volatility_m6 is None and f["one_month"].avg_monthly_change == 0.0
    assert f["three"].payment_trend_m6 is None and f["three"].last_month_ratio is None
    assert (f["six"].first_month_ratio, f["six"].min_payment_ratio_m6, f["six"].avg_monthly_change) == (1.25, 0.0, 0.25)
    assert f["unpaid"].active_months_m6 == 0 and f["junk_date"].active_months_m6 == 0


def test_payment_columns_without_arrays_of_months(spark):
    """the months of a loan are one ratio and zeros. No array is built and folded
    in each row, and the columns are those of the panel's aggregates to the last digit."""
    rows = [(f"{term}-{paid}-{total}", "Jan-2015", float(term), 97.3, total, f"{'JanFebMarAprMayJunJulAugSep'[3 * paid:3 * paid + 3]}-2015" if paid >= 0 else None)
            for term in range(0, 9) for paid in range(-1, 9)
            for total in (0.0, 33.41, 100.0, 412.77, 583.8, 1e9, -55.5, -1234567.89, float("inf"), -float("inf"), None)]
    df = spark.createDataFrame(rows, "loan_id string, issue_date string, term_months double, installment double, total_pymnt double, "
                                     "last_pymnt_d string").withColumn("default_flag", F.lit(0))
    got = features.payment_columns_of(df).select("loan_id", *features.PAYMENT_FEATURES)
    months = panel.explode_months(panel.with_schedule(df.where(panel.eligible())), 6).repartition(1, "loan_id").sortWithinPartitions("loan_id", "month_number")
    want = features.payment_flags(features.payment_aggregates(months)).select(*got.columns)
    assert got.count() == 8 * 10 * 11
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("aggregate(") <= 2


def test_model_features_scans_twice_and_pushes_filters(spark):
    """One scan for the columns, one for the quarter statistic; the numeric filters
    reach the first; no join of loan tables, no exchange of loan rows."""
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = _plan(features.model_features_of(t.records))
        stored = _plan(features.payment_features(t.panel))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan parquet") == 2 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1      # quarters, partially aggregated
    for pushed in ("GreaterThan(loan_amnt,0.0)", "GreaterThan(annual_inc,0.0)", "GreaterThan(installment,0.0)", "IsNotNull(dti)"):
        assert pushed in plan, pushed
    assert stored.count("FileScan parquet") == 1 and "LessThanOrEqual(month_number,6)" in stored
    assert "Exchange" not in stored and "Generate" not in stored


def test_model_features_plan_at_scale(spark):
    """With broadcasts off (as for large tables), the whole 48-column view
    needs one exchange: the partial aggregate by issue quarter. Every join
    and the per-loan aggregation run on the loan_id buckets."""
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(features.model_features(t.loans, t.borrowers, t.outcomes))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert "SortMergeJoin" in plan


def test_mature_vintages_alone_are_read(spark):
    """Filters on the issue year reach the folders: in the split and in what the three
    fits read; joins on loan_id still need no exchange."""
    from loanrisk.operators import models, split
    from loanrisk.plans import modelling
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    mature = split.mature(t.model_features)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        for df in (modelling.split_rows(t, "train"), *models.splits(t.model_features), mature.select("loan_id")):
            assert re.search(r"PartitionFilters: \[[^\]]*issue_year[^\]]*<= 2016", _plan(df)), _plan(df)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = mature.select("loan_id", "dti").join(t.loans.select("loan_id", "loan_amnt"), "loan_id")
        assert "Exchange" not in _plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert t.model_features.columns == tables(spark, t.sf_dir, materialize=False).model_features.columns


def test_audit_is_observed_by_the_write(spark):
    """No scan of raw records: one row made of what the ingest job counted."""
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    audit = t.ingest_audit
    assert "Scan parquet" not in _plan(audit) and "Exchange" not in _plan(audit)
    assert audit.collect() == tables(spark, t.sf_dir, materialize=False).ingest_audit.collect()


def test_runs_are_the_panel(spark):
    """Expanded runs are the panel's rows, also its first months alone; aggregates on runs
    equal those on rows, and read no month's row."""
    from loanrisk.plans.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(tuple, df.select(*panel.PANEL_COLUMNS).collect()))
    assert t.runs.where(F.size("runs") > 2).count() == 0
    early = panel.expand_runs(t.runs, 6)
    assert rows(early) == rows(t.panel.where("month_number <= 6"))
    assert panel.expand_runs(t.runs).exceptAll(t.panel).count() == 0 and panel.expand_runs(t.runs).count() == t.panel.count()
    assert panel.runs_profile(t.runs).collect() == panel.panel_profile(t.panel).collect()
    assert panel.runs_by_label(t.runs).collect() == panel.early_payment_by_label(t.panel).collect()
    assert "monthly_payments" not in _plan(panel.runs_by_label(t.runs)) and "monthly_payments" in _plan(t.panel)


def test_runs_of_odd_loans(spark):
    """No month, never active, active to the end, last payment before the issue."""
    rows = [("1", "Jan-2015", 3.0, 100.0, 300.0, "Mar-2015", 0), ("2", "Jan-2015", 3.0, 100.0, 50.0, "Jan-2015", 1),
            ("3", "Jan-2015", 3.0, 100.0, 0.0, None, 1), ("4", "Jan-2015", 0.0, 100.0, 10.0, "Feb-2015", 0),
            ("5", "Jan-2015", 2.0, 100.0, 10.0, "Dec-2014", 0), ("6", "Jan-2015", None, 100.0, 10.0, "Feb-2015", 0)]
    df = spark.createDataFrame(rows, "loan_id string, issue_date string, term_months double, installment double, total_pymnt double, "
                                     "last_pymnt_d string, default_flag int").withColumn("last_pymnt_amnt", F.lit(None).cast("double"))
    got = {r.loan_id: [(x["first"], x["last"], x.is_active) for x in r.runs] for r in panel.payment_runs(df).collect()}
    assert got == {"1": [(1, 3, 1)], "2": [(1, 1, 1), (2, 3, 0)], "3": [(1, 3, 0)], "5": [(1, 2, 0)]}
    assert panel.expand_runs(panel.payment_runs(df)).exceptAll(panel.monthly_panel_of(df)).count() == 0
