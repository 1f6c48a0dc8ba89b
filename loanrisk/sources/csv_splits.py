"""CSV with line breaks in quoted text, read by many tasks a file.

Spark splits a CSV file only where every line is a record. Here lines are read as text
and put together again:

1. The quotes of each split are counted (one pass; a row a split). Their running sum
   over a file's splits, odd or even, tells whether a split begins inside quotes.
2. In each split a streaming pass joins lines until the quotes are even: a record. It
   holds one record. What lies before the first end of a record begun earlier, and
   what is begun but not ended, are fragments: at most two a split.
3. Fragments of neighbouring splits are joined in order, over those rows alone.

Quotes must stand as the format has them: around a field, doubled inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD, HEAD, TAIL, MIDDLE = "record", "head", "tail", "middle"
PIECES = "kind string, file string, start long, is_first boolean, body string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _pieces(lines: DataFrame, begins: DataFrame) -> DataFrame:
    """Records and fragments of each split, in order; ``open`` tells whether it begins
    inside quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, inside, fresh, first = None, [], False, False, False

        def rest():
            """What is begun at a split's end: the start of a record, or a stretch of one
            that neither begins nor ends here."""
            if held:
                yield (MIDDLE if fresh else HEAD, *place, False, "\n".join(held))

        for batch in batches:
            out = []
            odd = pc.bit_wise_and(pc.count_substring(batch["value"], '"'), 1).to_pylist()
            for value, file, start, open_, turns in zip(*(batch[c].to_pylist() for c in ("value", "file", "start", "open")), odd):
                if (file, start) != place:
                    out += rest()
                    place, held, inside, first = (file, start), [], open_, start == 0
                    fresh = open_  # no record has ended yet
                held.append(value)
                inside ^= bool(turns)
                if not inside:
                    out.append((TAIL if fresh else RECORD, *place, first, "\n".join(held)))
                    held, fresh, first = [], False, False
            yield _batch(out)
        yield _batch(list(rest()))

    def _batch(rows):
        names = ["kind", "file", "start", "is_first", "body"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()))], names)

    joined = lines.join(F.broadcast(begins), ["file", "start"])   # a row a split
    return joined.select("value", "file", "start", "open").mapInArrow(run, PIECES)


def split_parity(lines: DataFrame) -> DataFrame:
    """``file, start, open`` of each split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _chained(fragments: DataFrame) -> DataFrame:
    """Fragments put together: a head, the stretches behind it, and the tail that ends it
    (or the end of the file)."""
    upto = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == TAIL, 0).otherwise(1))
    chain = fragments.withColumn("chain", F.sum((F.col("kind") == HEAD).cast("int")).over(upto))
    return chain.groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "is_first", "body"))).alias("parts"),
        F.max(F.when(F.col("kind") == HEAD, F.col("start"))).alias("start")).select(
        "file", "start", F.array_join("parts.body", "\n").alias("body"))


def read_split_csv(spark: SparkSession, path: str, schema: StructType, staged) -> DataFrame:
    """Records of all files at ``path`` without their headers, parsed to text columns.
    ``staged`` stores a small table (a row a split; the fragments) and reads it back."""
    lines = _lines(spark, path)
    begins = staged(split_parity(lines), "csv-splits")
    pieces = _pieces(lines, begins)
    fragments = staged(pieces.where(F.col("kind") != RECORD), "csv-fragments")
    # a header that crosses a border is the chain that begins a file: it has no record before it
    whole = pieces.where((F.col("kind") == RECORD) & ~F.col("is_first")).select("body")
    first_ends = staged(pieces.where((F.col("kind") == RECORD) & F.col("is_first")).select("file"), "csv-headers")
    chained = _chained(fragments).join(first_ends.withColumn("seen", F.lit(True)), "file", "left")
    chained = chained.where(F.col("seen") | (F.col("start") > 0)).select("body")
    records = whole.unionByName(chained).where(~F.col("body").rlike(r"^\s*$"))
    ddl = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    parsed = F.from_csv(F.regexp_replace("body", r"\r$", ""), ddl, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records.select(parsed.alias("r")).select("r.*")
