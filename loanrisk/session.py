"""Spark session helpers.

The library never builds its own cluster configuration on a real cluster: it
reads what the session already carries (shuffle partitions, checkpoint folder)
and only fills gaps when running locally (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "loanrisk") -> SparkSession:
    """Session for tests and the local bench: AQE on, UTC, no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOANRISK_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on; keep everything else as given.

    This sets the session's time zone to UTC for good: month parsing and quarter
    truncation must agree with tables written earlier. Callers that show local
    times should do so in a session of their own.
    """
    # Month parsing and quarter truncation must not depend on the host zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def session_key(spark: SparkSession) -> str:
    """Identifies the running application (memo key for once-per-session work)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a local SparkContext handle
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only a local master gets a folder of its own when it is unset;
    elsewhere a machine-local folder would be invisible to the executors, so that
    raises. The RDD checkpoint directory is set once, if the session has none.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # no local SparkContext handle: the session conf is all we have
        sc = None
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="loanrisk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
