"""Sharding by proportional stratified interleaving (operator 6).

Law ``rows``: shard sizes in rows differ by at most one. Within each source rows
are ranked in a seeded pseudo-random order of their ids (where ids are null or repeat:
of ids and contents, then by place in the files); a row's fractional rank is
``(rank + 1/2) / rows of the source``. Sorted by it, every stretch of the whole
holds each source in proportion, and cutting the order into equal stretches gives
shards that match the mixture.

Both orders are distributed sorts: rows are dealt by ranges of the full sort key,
so a source with a third of all rows lies in many ranges, and a row's place is
its place in its range plus the rows of earlier ranges. Those totals are a small
table of at most (ranges + sources) rows, summed in Spark.

Defined results: a null source is a stratum of its own; rows equal in
all columns are interchangeable and get different slots; an empty
table gives no rows; all columns of the input are carried, and one of the names in
``ADDED`` already in use raises ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanrisk.llm.common import ids_are_unique, written
from loanrisk.llm.exact_dedup import located

#: Names of the output, and of columns on the way to it.
ADDED = {"shard", "slot", "_key", "_fraction", "_row_at", "_place", "_at", "_range", "_n", "_first", "_shift", "_group_rows", "_r"}
LOCAL = (1 << 33) - 1  # monotonically_increasing_id: range number << 33 | row in range


def places(df: DataFrame, order: list[Column], by: list[str], name: str) -> DataFrame:
    """Adds ``_place``: the row's position in ``order`` within its group ``by``
    (whose columns lead the order; none: over all rows), from 0."""
    held = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("_at", F.monotonically_increasing_id()), name)
    held = held.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(LOCAL)))
    groups = held.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("_range", *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(W.partitionBy(*by)).alias("_group_rows"))
    g = groups.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g_{c}") for c in by], "_shift", "_group_rows")
    same = held["_range"] == g["_r"]
    for c in by:
        same = same & held[c].eqNullSafe(g[f"_g_{c}"])
    return (held.join(g, same).withColumn("_place", F.col("_at") + F.col("_shift"))
            .drop("_at", "_range", "_r", "_shift", *[f"_g_{c}" for c in by]))


def stratified_shards(df: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id",
                      source_col: str = "source") -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0)."""
    if taken := ADDED & {*df.columns}:
        raise ValueError(f"columns in use: {sorted(taken)}")
    if ids_are_unique(df, id_col):
        keyed, tie = df.withColumn("_key", F.xxhash64(F.lit(seed), F.col(id_col))), [F.col(id_col)]
    else:
        # one id may be on many rows: their contents set them apart, and then their place
        keyed = (located(df).withColumnRenamed("_at", "_row_at")
                 .withColumn("_key", F.xxhash64(F.lit(seed), F.col(id_col), *[F.col(c) for c in df.columns])))
        tie = [F.col(id_col), F.col("_row_at.file"), F.col("_row_at.row")]
    ranked = places(keyed, [F.col(source_col), F.col("_key"), *tie], [source_col], "shard-ranks")
    # (2 rank + 1) / (2 rows): one division, the same double for equal fractions
    ranked = (ranked.withColumn("_fraction", (2 * F.col("_place") + 1) / (2 * F.col("_group_rows")))
              .drop("_place", "_group_rows"))
    placed = places(ranked, [F.col("_fraction"), F.col(source_col), F.col("_key"), *tie], [], "shard-order")
    # shard = floor(place * shards / rows); it starts at ceil(shard * rows / shards)
    rows = F.col("_group_rows")
    return (placed.withColumn("shard", F.expr(f"CAST((_place * {shards}) div _group_rows AS INT)"))
            .withColumn("slot", F.col("_place") - F.expr(f"(shard * _group_rows + {shards - 1}) div {shards}"))
            .drop("_place", rows, "_key", "_fraction", "_row_at").drop("_group_rows"))
