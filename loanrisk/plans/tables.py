"""The base tables and views, derived from a test-data folder in Spark.

``LoanTables`` is lazily built; each attribute is a DataFrame. Nothing is
collected. As in the reference flow (ingest once, query many times), the typed
records are written once per session and source folder - to the shared
checkpoint folder, bucketed and sorted by ``loan_id`` - and every view and report
reads them back, as the three base tables or as one row per loan. Joins and groupings on ``loan_id`` then run
without an exchange. ``materialize=False`` keeps the whole chain lazy.
"""

from __future__ import annotations

import os
import threading
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession

from loanrisk.operators import clean, features, panel
from loanrisk.sources import io
from loanrisk.session import session_key
from loanrisk.sources.fixtures import loan_count, raw_loans


# Guards the once-per-session writes when queries run from several threads.
MATERIALIZE_LOCK = threading.RLock()


#: Loans of a bucket at most: a task sorts its bucket before it writes it, in the panel
#: up to 60 rows of about 100 bytes a loan.
BUCKET_LOANS = 65_536


def default_buckets(spark: SparkSession, loans: int = 0) -> int:
    """Bucket count of the written tables: ``loanrisk.buckets`` when set (size
    it to the data, e.g. total bytes / 512 MB), else the shuffle parallelism, and more
    where buckets would hold over ``BUCKET_LOANS`` loans."""
    b = spark.conf.get("loanrisk.buckets", None)
    return int(b) if b else max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-loans // BUCKET_LOANS))


@dataclass
class LoanTables:
    spark: SparkSession
    sf_dir: str
    materialize: bool = True

    @cached_property
    def base(self) -> dict[str, DataFrame]:
        return io.records_tables(self.records)

    @property
    def tag(self) -> str:
        return io.tag_for(self.spark, self.sf_dir)

    @cached_property
    def records(self) -> DataFrame:
        """Typed records, one row per loan."""
        if not self.materialize:
            return clean.typed_records(self.labelled)
        with MATERIALIZE_LOCK:
            return io.write_records(self.labelled, io.table_root(self.spark, self.tag), self.tag, self.buckets,
                                    prepartitioned=True)

    @cached_property
    def buckets(self) -> int:
        """Of all written tables of this set, found once."""
        return default_buckets(self.spark, loan_count(self.spark, self.sf_dir))

    def _stored(self, df: DataFrame, name: str, parts: str | None = None) -> DataFrame:
        """``df`` written once per session, bucketed by ``loan_id`` (its rows come
        from the bucketed records, so the write adds no exchange), in a folder for
        each value of ``parts``."""
        if not self.materialize:
            return df
        table = io.table_name(self.tag, name)
        with MATERIALIZE_LOCK:
            io.write_table(df, os.path.join(io.table_root(self.spark, self.tag), name), table,
                           self.buckets, prepartitioned=True, parts=parts)
        return self.spark.table(table)

    @cached_property
    def raw(self) -> DataFrame:
        return raw_loans(self.spark, self.sf_dir)

    @cached_property
    def audit(self) -> Observation:
        """Counts of the ingest, taken by the job that writes the records."""
        return Observation("ingest")

    @cached_property
    def labelled(self) -> DataFrame:
        if not self.materialize:
            return clean.labelled(self.raw)
        return clean.labelled(raw_loans(self.spark, self.sf_dir, self.buckets), self.audit)

    @property
    def ingest_audit(self) -> DataFrame:
        """R10; one scan of the raw records serves it and the tables."""
        if not self.materialize:
            return clean.ingest_audit(self.raw)
        _ = self.records
        return clean.observed_audit(self.spark, self.audit)

    @property
    def loans(self) -> DataFrame:
        return self.base["loans"]

    @property
    def borrowers(self) -> DataFrame:
        return self.base["borrowers"]

    @property
    def outcomes(self) -> DataFrame:
        return self.base["outcomes"]

    @cached_property
    def panel(self) -> DataFrame:
        """The stored ``monthly_payments`` table, every loan month."""
        return self._stored(panel.monthly_panel_of(self.records), "monthly_payments")

    @cached_property
    def runs(self) -> DataFrame:
        """The panel run-length encoded: a row per loan, a projection of the records."""
        return panel.payment_runs(self.records)

    @cached_property
    def origination(self) -> DataFrame:
        return features.origination_of(self.records)

    @cached_property
    def payment(self) -> DataFrame:
        return features.payment_columns_of(self.records).select("loan_id", *features.PAYMENT_FEATURES)

    @cached_property
    def vintage(self) -> DataFrame:
        return features.vintage_of(self.records)

    @cached_property
    def model_features(self) -> DataFrame:
        """Built once and written (bucketed by loan_id, a folder for each issue year):
        reports, splits and every model read it back instead of re-running the view
        stack, and those over mature vintages leave the other years unread."""
        df = features.model_features_of(self.records)
        return self._stored(df, "model_features", parts="issue_year").select(*df.columns)


_SESSION_TABLES: dict[tuple[str, str], LoanTables] = {}


def tables(spark: SparkSession, sf_dir: str, materialize: bool = True) -> LoanTables:
    """The table set for ``sf_dir``, written at most once per session."""
    if not materialize:
        return LoanTables(spark, sf_dir, materialize=False)
    key = (session_key(spark), os.path.abspath(sf_dir))
    with MATERIALIZE_LOCK:
        t = _SESSION_TABLES.get(key)
        if t is None:
            t = _SESSION_TABLES[key] = LoanTables(spark, sf_dir)
        # touch the written tables under the lock, so two threads never write them twice
        _ = t.records
    return t
