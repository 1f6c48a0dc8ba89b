"""CSV scan, exact sample, table writes and missing-table skip."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from loanrisk.operators import clean
from loanrisk.sources import io
from loanrisk.sources.fixtures import raw_loans
from tests.conftest import SMALL


def test_csv_roundtrip_and_cleaning(spark):
    d = tempfile.mkdtemp(prefix="loanrisk-csv-")
    path = os.path.join(d, "raw.csv")
    with open(path, "w") as fh:
        fh.write("id,issue_d,loan_amnt,term,int_rate,grade,emp_length,revol_util,loan_status,title\n")
        fh.write('1,Jan-2015,1000,36 months,13.56%,B,< 1 year,54.3%,Fully Paid,"car, new"\n')
        fh.write('2,Feb-2015,2000,60 months,7.00%,X,n/a,bad,Charged Off,"multi\nline"\n')
        fh.write(',Mar-2015,3000,36 months,9.00%,A,1 year,10%,Current,x\n')
        fh.write('4,Mar-2015,3000,36 months,9.00%,A,1 year,10%,Late (31-120 days),x\n')
    raw = io.read_raw_csv(spark, path, multi_line=True)
    assert raw.count() == 4 and all(t == "string" for _, t in raw.dtypes)
    lab = clean.labelled(raw)
    assert sorted(r.id for r in lab.collect()) == ["1", "2"]
    loans = {r.loan_id: r for r in clean.build_loans(lab).collect()}
    assert loans["1"].term_months == 36.0 and loans["1"].int_rate == 13.56
    assert loans["2"].grade_numeric is None and loans["2"].title == "multi\nline"
    bor = {r.loan_id: r for r in clean.build_borrowers(lab).collect()}
    assert bor["1"].emp_length_years == 1.0 and bor["2"].emp_length_years is None
    assert bor["1"].revol_util == 54.3 and bor["2"].revol_util is None
    audit = clean.ingest_audit(raw).first()
    assert (audit.rows_read, audit.dropped_null_id, audit.dropped_status, audit.rows_kept) == (4, 1, 1, 2)


def test_sample_exact(spark):
    raw = raw_loans(spark, SMALL)
    s = io.sample_exact(raw, 50)
    ids = [r.id for r in s.collect()]
    assert len(ids) == 50 and len(set(ids)) == 50
    assert ids == [r.id for r in io.sample_exact(raw, 50).collect()]
    assert io.sample_exact(raw, 0).count() == raw.count()


def test_write_and_load_tables(spark):
    d = tempfile.mkdtemp(prefix="loanrisk-tables-")
    lab = clean.labelled(raw_loans(spark, SMALL))
    tabs = io.write_separate_tables(lab, d, "t" + os.path.basename(d)[-6:].replace("-", "_"), 4)
    assert set(tabs) == {"loans", "borrowers", "outcomes"}
    assert tabs["loans"].count() == lab.count()
    got = io.load_tables(spark, d, ["loans", "missing_table"])
    assert set(got) == {"loans"}
    io.register_views(got)
    assert spark.sql("SELECT count(*) AS n FROM loans").first().n == lab.count()


def test_sql_file_views_csv_and_drop(spark):
    d = tempfile.mkdtemp(prefix="loanrisk-sql-")
    spark.createDataFrame([("a", 1), ("b", 0)], "loan_id string, default_flag int") \
        .createOrReplaceTempView("outcomes_tmp")
    path = os.path.join(d, "view.sql")
    with open(path, "w") as fh:
        fh.write("CREATE OR REPLACE TEMP VIEW rate_tmp AS "
                 "SELECT avg(default_flag) AS rate FROM outcomes_tmp")
    io.run_sql_file(spark, path)
    assert spark.table("rate_tmp").first().rate == 0.5
    io.write_csv(spark.table("rate_tmp"), os.path.join(d, "rate_csv"))
    files = [f for f in os.listdir(os.path.join(d, "rate_csv")) if f.endswith(".csv")]
    assert len(files) == 1
    io.write_table(spark.table("rate_tmp"), os.path.join(d, "t"), "rate_table_tmp")
    assert spark.catalog.tableExists("rate_table_tmp")
    io.drop_table(spark, "rate_table_tmp")
    assert not spark.catalog.tableExists("rate_table_tmp")


def test_load_tables_reads_the_single_table_layout(spark):
    d = tempfile.mkdtemp(prefix="loanrisk-records-")
    lab = clean.labelled(raw_loans(spark, SMALL))
    tag = "r" + os.path.basename(d)[-6:].replace("-", "_")
    io.write_tables(lab, d, tag, 4)
    got = io.load_tables(spark, d)
    assert set(got) == {"loans", "borrowers", "outcomes"}
    assert got["outcomes"].count() == lab.count()
    assert "default_flag" in got["outcomes"].columns and "loan_id" in got["loans"].columns


def test_csv_path_gives_the_same_model_table(spark):
    """S1 end to end: raw records written as CSV, scanned back as text, give
    exactly the model table built from the in-memory records."""
    import glob

    from loanrisk.operators import features
    from loanrisk.plans.tables import tables
    d = tempfile.mkdtemp(prefix="loanrisk-csvpath-")
    raw_loans(spark, SMALL).coalesce(1).write.option("header", True).csv(os.path.join(d, "raw"))
    raw = io.read_raw_csv(spark, glob.glob(os.path.join(d, "raw", "*.csv"))[0])
    t = io.write_tables(clean.labelled(raw), os.path.join(d, "tables"), "csvpath", 4)
    via_csv = features.model_features(t["loans"], t["borrowers"], t["outcomes"])
    direct = tables(spark, SMALL).model_features.select(*via_csv.columns)
    assert via_csv.count() == direct.count()
    assert via_csv.exceptAll(direct).count() == 0


def test_csv_scan_is_split(spark):
    """A CSV file is read by several tasks; line breaks in quotes need multi_line."""
    import glob
    d = tempfile.mkdtemp(prefix="loanrisk-csvsplit-")
    raw_loans(spark, SMALL).coalesce(1).write.option("header", True).csv(os.path.join(d, "raw"))
    path = glob.glob(os.path.join(d, "raw", "*.csv"))[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        split, whole = io.read_raw_csv(spark, path), io.read_raw_csv(spark, path, multi_line=True)
        assert split.rdd.getNumPartitions() > 1 and whole.rdd.getNumPartitions() == 1
        assert split.exceptAll(whole).count() == 0 and split.count() == whole.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sample_is_exact_and_by_hash(spark):
    import hashlib
    df = spark.range(3000).selectExpr("cast(id as string) AS id").unionByName(
        spark.createDataFrame([(None,), ("7",)], "id string"))
    ids = sorted((hashlib.md5(((r.id or "") + "42").encode()).hexdigest(), r.id) for r in df.collect() if r.id is not None)
    for n in (1, 17, 1000, 2999):
        got = [r.id for r in io.sample_exact(df, n).collect()]
        assert len(got) == n and set(got) - {None} <= {i for _, i in ids[:n]}
    assert io.sample_exact(df, 5000).count() == io.sample_exact(df, None).count() == 3002


def test_tables_of_two_sessions_do_not_meet(spark, monkeypatch):
    a = io.tag_for(spark, SMALL)
    monkeypatch.setattr(io, "session_key", lambda _: "another application")
    b = io.tag_for(spark, SMALL)
    assert a != b and io.table_root(spark, a) != io.table_root(spark, b)


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from loanrisk.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda k, default=None: default)
    for master, ok in (("spark://host:7077", False), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError):
            checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=sc))


def test_scripts_are_cut_outside_quotes_and_comments():
    script = """-- one; two
SELECT ';' AS a, "b;c", `d;e`, 'it''s; x', 'y\\'; z'; /* a; /* nested; */ still; */ SELECT 2
;;  -- nothing more;
"""
    assert io.split_statements(script) == [
        "-- one; two\nSELECT ';' AS a, \"b;c\", `d;e`, 'it''s; x', 'y\\'; z'", "/* a; /* nested; */ still; */ SELECT 2"]
    assert io.split_statements("") == io.split_statements(" ; -- a") == []


def test_a_script_runs_in_order_and_is_edited_in_place(spark, tmp_path):
    root = str(tmp_path)
    io.store_scripts(spark, root)
    new = "CREATE OR REPLACE TEMP VIEW stepped AS SELECT 1 AS x; SELECT x + 1 AS y FROM stepped; -- end"
    spark.createDataFrame([(new,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/functions")
    io.store_scripts(spark, root)      # leaves the edited one
    assert io.run_sql_file(spark, f"{root}/functions").collect()[0].y == 2
    spark.createDataFrame([("-- nothing",)], "value string").coalesce(1).write.text(f"{root}/none")
    assert io.run_sql_file(spark, f"{root}/none") is None


@pytest.mark.parametrize("seed, size", [(1, 64), (2, 400), (3, 5000)])
def test_quoted_line_breaks_in_split_files(spark, tmp_path, seed, size):
    """The rows of the unsplit reader, with records, quotes and runs of quotes over
    split borders, records longer than a split, several files, no last line break."""
    import csv
    import random
    rng = random.Random(seed)
    bits = ["a", "bc", ",", "\n", '"', '""', "\n\n", " ", "é", "x" * 30, "\n,\n"]
    for f in range(3):
        with open(tmp_path / f"part-{f}.csv", "w", newline="") as fh:
            w = csv.writer(fh, lineterminator="\n")
            w.writerow(["id", "title", "rest"])
            for i in range(60):
                long = 40 if i == 20 + f else 6
                w.writerow([f"{f}-{i}", "t" + "".join(rng.choice(bits) for _ in range(rng.randrange(long))) + ".", rng.choice(["", "r", "q\nq"])])
            if f == 1:
                fh.write('1-last,"no\nend",z')
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        split = io.read_raw_csv(spark, str(tmp_path), quoted_breaks=True)
        whole = io.read_raw_csv(spark, str(tmp_path), multi_line=True)
        got, want = (sorted(map(repr, df.collect())) for df in (split, whole))
        assert len(want) == 181 and got == want and split.columns == whole.columns
        assert size > 1000 or split.rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_are_written_bucket_by_bucket(spark, monkeypatch):
    """A write that needs no exchange has a task a bucket, with the rows of that one, so
    that no task sorts more; and the wide records cross no exchange."""
    from pyspark.sql import DataFrameWriter

    from loanrisk.plans.tables import LoanTables, default_buckets
    seen, save = {}, DataFrameWriter.saveAsTable
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(self, name, *a, **kw):
        per_task = self._df.select("loan_id", F.spark_partition_id().alias("p")).groupBy("p").agg(
            F.count_distinct(F.pmod(F.hash("loan_id"), F.lit(6))).alias("n")).collect()
        seen[name.rsplit("_", 2)[-2] + "_" + name.rsplit("_", 1)[-1]] = [r.n for r in per_task], plan(self._df)
        return save(self, name, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", watched)
    spark.conf.set("loanrisk.buckets", "6")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        t = LoanTables(spark, f"{SMALL}/.")
        assert t.panel.count() and t.model_features.count()
    finally:
        spark.conf.unset("loanrisk.buckets")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert set(seen) == {"loan_records", "monthly_payments", "model_features"}
    for name, (buckets_in_task, _) in seen.items():
        assert buckets_in_task == [1] * 6, (name, buckets_in_task)
    above, below = seen["loan_records"][1].split("REPARTITION_BY_NUM", 1)
    assert "total_rec_late_fee" in above and "total_rec_late_fee" not in below
    assert [default_buckets(spark, n) for n in (0, 54_000_000)] == [int(spark.conf.get("spark.sql.shuffle.partitions")), 824]


def test_raw_loans_dealt_by_id_are_the_same_rows(spark):
    a, b = raw_loans(spark, SMALL), raw_loans(spark, SMALL, 5)
    assert a.columns == b.columns and b.rdd.getNumPartitions() == 5
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
