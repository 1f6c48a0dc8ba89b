"""Helpers shared by the operators of this subpackage.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``:
written once by a job, then read back, so a lost executor costs at most the
tasks that were running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanrisk.session import checkpoint_dir, session_key

#: Characters of the class ``[\x20\x09-\x0D]``, as every word rule here uses them.
SPACES = " \t\n\x0b\x0c\r"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never used twice."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{session_key(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (cuts the lineage). Shuffle
    files of the job that wrote it are of no more use and go when it ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ids_are_unique(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null or repeated; counts per id are summed in each task first."""
    again = df.groupBy(F.col(id_col).alias("id")).count().filter("count > 1 OR id IS NULL")
    return not again.limit(1).count()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
