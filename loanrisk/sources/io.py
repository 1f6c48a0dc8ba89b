"""Sources and sinks.

* ``read_raw_csv``   S1/S2: header CSV, every column as text, native splits.
* ``sample_exact``   S3: exact-size, seeded, without replacement.
* ``write_tables``   S4/S6: the cleaned labelled records written once,
  bucketed and sorted by ``loan_id``; loans / borrowers / outcomes are its
  column projections, so every later join or groupBy on ``loan_id`` runs
  without an exchange. ``write_separate_tables`` writes three tables.
* ``load_tables``    S5/S8: read the tables that exist, report the missing.
* ``drop_table``     S7, ``register_views`` S9, ``run_sql_file`` S15.
* ``write_csv``      S11: a small report as one CSV file.
"""

from __future__ import annotations

import csv
import hashlib
import logging
import os
import re
import time
import uuid
from importlib import resources

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loanrisk.operators import clean
from loanrisk.session import checkpoint_dir, session_key
from loanrisk.sources.csv_splits import read_split_csv

log = logging.getLogger(__name__)

TABLES = ["loans", "borrowers", "outcomes"]
#: Spark's choice to scan a bucketed table as plain files where the plan needs no buckets.
AUTO_BUCKETED_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
PREFIX_DIGITS = 4    # hex digits of the hash prefix in sample_exact


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line (one line reaches the driver)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    return [c.strip() for c in next(csv.reader([first[0][0]]))]


def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                 multi_line: bool = False, quoted_breaks: bool = False) -> DataFrame:
    """Raw loan CSV with header, all columns as text (no inference pass).

    Files are split into many tasks. Where quoted text may hold line breaks,
    ``quoted_breaks`` still splits them, with a pass that counts quotes and one that
    joins lines (``csv_splits``); ``multi_line`` reads each file in one task.
    """
    names = columns or _header(spark, path)
    schema = StructType([StructField(n, StringType(), True) for n in names])
    if quoted_breaks:
        return read_split_csv(spark, path, schema, staged)
    return (spark.read.option("header", True).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .schema(schema).csv(path))


def sample_exact(df: DataFrame, n: int | None, seed: int = 42, key: str = "id") -> DataFrame:
    """S3: exactly ``n`` rows (or all if fewer), chosen by a seeded hash of the key.

    ``None`` or 0 means the full table. Rows are counted per hash prefix (at most
    65,536 numbers reach the driver); prefixes below the one where the n-th row
    falls are taken whole, and only that one prefix is ranked.
    """
    if not n:
        return df
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))
    hashed = df.withColumn("_h", h)
    prefix = F.substring("_h", 1, PREFIX_DIGITS)
    counts = hashed.groupBy(prefix.alias("prefix")).count().collect()
    edge, before = None, 0
    for p, c in sorted((r["prefix"], r["count"]) for r in counts):
        if before + c > n:
            edge = p
            break
        before += c
    if edge is None:  # n rows or fewer
        return df
    whole = hashed.where(prefix < edge)
    rest = hashed.where(prefix == edge).orderBy("_h", key).limit(int(n) - before)
    return whole.unionByName(rest).drop("_h")


def table_root(spark: SparkSession, tag: str) -> str:
    """Shared folder for written tables: under the session's checkpoint dir."""
    return os.path.join(checkpoint_dir(spark), "tables", tag)


def table_name(tag: str, name: str) -> str:
    return f"lr_{tag}_{name}"


def tag_for(spark: SparkSession, source: str) -> str:
    """Names the tables of one source in one application, so that sessions on the
    same source never write into each other's files."""
    return hashlib.md5(f"{session_key(spark)}:{source}".encode()).hexdigest()[:12]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder under a fresh name, and read back:
    an intermediate result that several jobs use and a lost executor cannot take."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "staged", session_key(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    _STAGED.setdefault(session_key(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: dict[str, list[str]] = {}


def staged_paths(spark: SparkSession) -> list[str]:
    """Intermediate results of this session that are still there."""
    return list(_STAGED.get(session_key(spark), []))


def release_staged(spark: SparkSession, since: int = 0) -> int:
    """Remove the session's intermediate results, or those after the first ``since``,
    and return their number. Frames that read them are of no more use: call this when
    the results made from them are written or no longer needed."""
    held = _STAGED.get(session_key(spark), [])
    gone = held[since:]
    for path in gone:
        remove_folder(spark, path)
    del held[since:]
    return len(gone)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


# ---------------------------------------------------------------- versions
# A folder of versions: each is written under a fresh name first, and published by
# appending one row to the folder's version log. Spark's committer shows that row
# whole or not at all, so a reader sees the version before or the new one; a write
# that fails half-way is never seen.

VERSION_SCHEMA = "version string, at double, retired boolean"


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions under ``root``, the latest first (one small row each)."""
    try:
        rows = spark.read.schema(VERSION_SCHEMA).parquet(f"{root}/versions").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    gone = {r["version"] for r in rows if r["retired"]}
    return [r["version"] for r in sorted(rows, key=lambda r: (r["at"], r["version"]), reverse=True) if r["version"] not in gone]


def publish(spark: SparkSession, root: str, write, at: float | None = None) -> str:
    """Call ``write(path)`` with the path of a fresh version, then publish it.
    Returns the version's name."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    write(f"{root}/{version}")
    _log_versions(spark, root, [version], False, at)
    return version


def _log_versions(spark: SparkSession, root: str, names: list[str], retired: bool, at: float | None = None) -> None:
    at = time.time() if at is None else at
    rows = spark.createDataFrame([(v, at, retired) for v in names], VERSION_SCHEMA)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/versions")


def publish_table(df: DataFrame, root: str) -> str:
    """``df`` as the latest version of the table at ``root``. Frames that read an
    earlier version keep reading it."""
    return publish(df.sparkSession, root, lambda path: df.write.parquet(path))


def published(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The table at ``root`` in the given version, or its latest."""
    return spark.read.parquet(version_path(spark, root, version))


def version_path(spark: SparkSession, root: str, version: str | None = None) -> str:
    there = versions(spark, root)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no published version {version or ''} under {root}")
    return f"{root}/{version or there[0]}"


def retire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all published versions but the last ``keep`` (at least one). The log
    names them first, so nobody is sent to a version that is going."""
    if keep < 1:
        raise ValueError("keep at least one version")
    gone = versions(spark, root)[keep:]
    if gone:
        _log_versions(spark, root, gone, True)
        for version in gone:
            remove_folder(spark, f"{root}/{version}")
    return gone


def write_table(df: DataFrame, path: str, name: str | None = None,
                buckets: int | None = None, key: str = "loan_id",
                prepartitioned: bool = False, parts: str | None = None) -> None:
    """Overwrite a Parquet table; bucketed by ``key`` when ``buckets``.

    Rows are first hash-partitioned on the key into exactly ``buckets``
    partitions (the same hash the bucket id uses), so each task writes one
    bucket and the table has one file per bucket, not tasks x buckets.
    ``prepartitioned``: the frame already comes out of joins on ``key`` over
    tables with the same bucketing, so that exchange is skipped, and such tables are
    scanned bucket by bucket: a task that scans files as they come has the rows of
    many buckets, and sorts them all before it writes the first. ``parts``: a
    low-cardinality column that gets a folder for each of its values, so that filters
    on it leave folders unread (at most buckets x values files).
    """
    if buckets:
        src = df if prepartitioned else df.repartition(buckets, key)
        w = (src.write.mode("overwrite").format("parquet")
             .option("path", path).bucketBy(buckets, key).sortBy(key))
        conf = df.sparkSession.conf
        auto = conf.get(AUTO_BUCKETED_SCAN)
        conf.set(AUTO_BUCKETED_SCAN, "false" if prepartitioned else auto)
        try:
            (w.partitionBy(parts) if parts else w).saveAsTable(name)
        finally:
            conf.set(AUTO_BUCKETED_SCAN, auto)
        return
    w = df.write.mode("overwrite").format("parquet").option("path", path)
    if name:
        w.saveAsTable(name)
    else:
        df.write.mode("overwrite").parquet(path)


def write_records(labelled: DataFrame, root: str, tag: str, buckets: int, prepartitioned: bool = False) -> DataFrame:
    """Parse the cleaned, labelled records once and write them typed, one row per
    loan, bucketed by ``loan_id``: one scan of the raw data, one shuffle (none if they
    are ``prepartitioned`` by their id; rows elsewhere only make more files)."""
    spark = labelled.sparkSession
    name = table_name(tag, "loan_records")
    write_table(clean.typed_records(labelled), os.path.join(root, "loan_records"), name, buckets, prepartitioned=prepartitioned)
    return spark.table(name)


def write_tables(labelled: DataFrame, root: str, tag: str, buckets: int) -> dict[str, DataFrame]:
    """``write_records``; returns loans / borrowers / outcomes as plain column
    selections of that one table. Each reads only its own Parquet columns and keeps
    the bucketing, so joins between them and groupings by ``loan_id`` need no exchange.
    """
    return records_tables(write_records(labelled, root, tag, buckets))


def records_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The three tables out of typed records."""
    return {"loans": clean.loans_of(records), "borrowers": clean.borrowers_of(records),
            "outcomes": clean.outcomes_of(records)}


def write_separate_tables(labelled: DataFrame, root: str, tag: str,
                          buckets: int) -> dict[str, DataFrame]:
    """S4 x 3: the three tables as separate bucketed Parquet tables.

    The labelled frame feeds three writes, so it is persisted for their
    duration (recomputable from lineage if an executor is lost).
    """
    spark = labelled.sparkSession
    labelled = labelled.persist()
    try:
        for n, df in records_tables(clean.typed_records(labelled)).items():
            write_table(df, os.path.join(root, n), table_name(tag, n), buckets)
    finally:
        labelled.unpersist()
    return {n: spark.table(table_name(tag, n)) for n in TABLES}


def load_tables(spark: SparkSession, root: str, names: list[str] = TABLES) -> dict[str, DataFrame]:
    """S5 + S8: read the tables under ``root``; skip (and report) missing ones.

    Reads either layout: one ``loan_records`` table (``write_tables``), from
    which the three tables are projected, or separate tables per name.
    """
    def read(path: str) -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            return None

    records = read(os.path.join(root, "loan_records"))
    projected = records_tables(records) if records is not None else {}
    out = {}
    for n in names:
        df = projected.get(n)
        if df is None:
            df = read(os.path.join(root, n))
        if df is None:
            log.warning("MISSING: %s - write the tables first", os.path.join(root, n))
            continue
        out[n] = df
    return out


def drop_table(spark: SparkSession, name: str) -> None:
    """S7."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def register_views(frames: dict[str, DataFrame]) -> None:
    """Create-or-replace a temp view per frame."""
    for n, df in frames.items():
        df.createOrReplaceTempView(n)


def split_statements(script: str) -> list[str]:
    """The statements of a SQL script: cut at each ``;`` that stands outside quotes
    ('...', "...", `...`) and comments (``--`` to the line's end, nested ``/* */``)."""
    out, start, at, n = [], 0, 0, len(script)
    while at < n:
        c = script[at]
        if c in "'\"`":
            at += 1
            while at < n and script[at] != c:
                at += 2 if script[at] == "\\" and c != "`" else 1
        elif script.startswith("--", at):
            end = script.find("\n", at)
            at = n if end < 0 else end
        elif script.startswith("/*", at):
            depth, at = 1, at + 2
            while at < n and depth:
                step = {"/*": 1, "*/": -1}.get(script[at:at + 2], 0)
                depth, at = depth + step, at + (2 if step else 1)
            continue
        elif c == ";":
            out.append(script[start:at])
            start = at + 1
        at += 1
    out.append(script[start:])
    return [s.strip() for s in out if _has_code(s)]


def _has_code(statement: str) -> bool:
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", "", statement, flags=re.S)
    return bool(bare.strip())


def run_sql_file(spark: SparkSession, path: str) -> DataFrame | None:
    """Run the SQL script at ``path`` (shared storage), statement by statement
    in order; returns the last one's result (None for a script without any)."""
    script = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    out = None
    for statement in split_statements(script):
        out = spark.sql(statement)
    return out


#: The feature views as scripts, in the order they need each other.
VIEW_SCRIPTS = ["functions", "origination_features", "payment_features", "vintage_features", "model_features"]


def store_scripts(spark: SparkSession, root: str) -> None:
    """Put the feature views' scripts under ``root`` on shared storage, to be edited
    and rerun there. Scripts that are there already stay as they are."""
    for name in VIEW_SCRIPTS:
        text = resources.files("loanrisk").joinpath("sql", f"{name}.sql").read_text(encoding="utf-8")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("ignore").text(f"{root}/{name}")


def run_feature_scripts(spark: SparkSession, root: str, frames: dict[str, DataFrame]) -> DataFrame:
    """The four feature views from the scripts under ``root``, over views of
    loans, borrowers, outcomes and monthly_payments; returns model_features."""
    register_views(frames)
    for name in VIEW_SCRIPTS:
        out = run_sql_file(spark, f"{root}/{name}")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as a single CSV with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
