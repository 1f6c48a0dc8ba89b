"""Exact dedup with a stateful stream (operator 1).

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most code points in the
original text stays, then the smallest id, then the last place in the files.

1. *Keys.* One pass writes a narrow table: id, code points, SHA-256 of the
   normalised text and the content locator (file, row in the file).
2. *State.* A Structured Streaming query reads that table (new files in it go
   through the same query later) and keeps, per digest and without expiry, in
   RocksDB: the number of rows, the first row's locator (whose content stands for
   the digest) and the stable identifier of the row that stays. It is a streaming
   aggregation, so a digest with a third of all rows reaches the state as one
   partial row per task.
3. *Full bytes.* A row is a hit when its digest is held with another locator. The
   normalised text of each hit is compared with the content at the first row's
   locator, byte by byte; hits are joined to that content by digest, a join whose
   large keys Spark splits. Rows whose bytes differ (a digest collision) are
   regrouped by digest and whole text.

Defined results: null text is empty, and equals other empty texts; null ids come
last among equals; repeated rows are told apart by their locator, so one stays;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanrisk.llm.common import SPACES, scratch, text_or_empty, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # one bound for all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # a store for each shuffle partition: megabytes allocated ahead in each add up
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Files of the key table in a micro-batch.
FILES_PER_BATCH = 10_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text_col: str) -> Column:
    return F.translate(text_or_empty(text_col), SPACES, "")


def rank() -> Column:
    """The largest of a group stays: most code points, then the smallest id (one
    with all bits turned is the larger, and null the least), then the last place."""
    return F.struct("points", F.bitwise_not("id").alias("turned_id"), "at")


def located(df: DataFrame) -> DataFrame:
    """``df`` with its content locator ``_at``, as it is if it has one (a column of
    that name and another type: ``ValueError``). A frame that is not read from files
    is written to the shared folder first; one that joins or explodes file rows must
    be written by the caller, as rows would share a place."""
    if "_at" in df.columns:
        if df.schema["_at"].dataType.simpleString() != "struct<file:string,row:bigint>":
            raise ValueError("column in use: _at")
        return df
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at")
    try:
        return df.select("*", at)
    except AnalysisException:
        return written(df, "dedup-content").select("*", at)


def update_state(spark: SparkSession, keys_path: str, state_path: str, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Take the files of ``keys_path`` that the state has not seen into it."""
    keys = (spark.readStream.schema("id long, points long, digest string, at struct<file: string, row: long>")
            .option("maxFilesPerTrigger", files_per_batch).parquet(keys_path))
    state = keys.groupBy("digest").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max(rank()).alias("stays"))
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_path)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """``digest, n, first, stays`` of every digest in the state."""
    held = spark.read.format("statestore").load(state_path)
    # the buffers of the three aggregates: count, min and max
    return held.select(F.col("key.digest").alias("digest"), F.col("value.count").alias("n"),
                       F.col("value.min").alias("first"), F.col("value.max").alias("stays"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and
    ``at``, the row's content locator."""
    spark = df.sparkSession
    content = located(df).select(F.col(id_col).cast("long").alias("id"), F.length(text_or_empty(text_col)).cast("long").alias("points"),
                                 normalised(text_col).alias("body"), F.col("_at").alias("at"))
    content = content.withColumn("digest", digest(F.col("body")))
    keys_path, state_path = scratch(spark, "dedup-keys"), scratch(spark, "dedup-state")
    # sha256 stands beside the digest only where that is another function (tests)
    content.select("id", "points", "digest", "at").write.parquet(keys_path)
    update_state(spark, keys_path, state_path, files_per_batch)
    state = written(read_state(spark, state_path), "dedup-groups")
    keys = spark.read.parquet(keys_path)

    several = state.filter("n > 1").select("digest", "first")
    members = written(content.select("digest", "at", "body").join(several, "digest")
                      .select("digest", "body", (F.col("at") == F.col("first")).alias("is_first")), "dedup-members")
    held = members.filter("is_first").select("digest", F.col("body").alias("held"))
    # nothing is grouped by digest here, so that Spark may split a large digest's join
    differ = written(members.filter("NOT is_first").join(held, "digest").filter("body <> held").select("digest"),
                     "dedup-collisions").distinct()

    out = keys.join(state, "digest").select(
        F.col("id").alias("doc_id"), F.bitwise_not("stays.turned_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("stays.at")).alias("kept"), "digest", "at")
    if differ.limit(1).count():
        out = out.join(differ, "digest", "left_anti").unionByName(_by_bytes(content.join(differ, "digest", "left_semi")))
    if digest is not sha256:
        out = out.join(content.select("at", F.sha2("body", 256).alias("sha")), "at").withColumn("digest", F.col("sha"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "at")


def drop_copies(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns; options as above."""
    rows = located(df)
    kept = exact_dedup(rows, **options).filter("kept").select(F.col("at").alias("_kept_at"))
    return rows.join(kept, rows["_at"] == kept["_kept_at"], "left_semi").drop("_at")


def _by_bytes(content: DataFrame) -> DataFrame:
    """The rows of collided digests, grouped by digest and whole text."""
    groups = content.groupBy("digest", "body").agg(F.count("*").alias("n"), F.max(rank()).alias("stays"))
    return content.join(groups, ["digest", "body"]).select(
        F.col("id").alias("doc_id"), F.bitwise_not("stays.turned_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("stays.at")).alias("kept"), "digest", "at")
