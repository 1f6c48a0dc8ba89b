"""The corpus pipeline over ``documents``, a stage after another.

Each stage reads the table its predecessor wrote; all but the last return the
columns of ``documents``:

1. language ID: rows without a recognised language go (no letters, or no language
   holds half of the score); the model learns as the query's does. Where there is
   nothing to learn from, all rows with a letter stay;
2. exact dedup: one row of equal texts stays;
3. SimHash near-dedup: one row of each component stays (four words a shingle, four
   bits), as its query has it;
4. mixing: rows as often as the mixture takes them, in the order of its blocks;
5. packing: pieces of sequences, in that order. Spark reads files by size, not by
   name, so this stage sorts its input by file and row again.

Defined results: a null or empty text has no letters and goes in the first stage;
rows with null or equal ids are told apart by their place in the files or their text,
never by the id alone, and such ids appear in the result as they are; of repeated rows
one stays, and ties are broken by place; a null language is nothing to learn from, a null
source is a source of its own; an empty table gives no rows. Columns of ``documents``
may have any names but those that a stage adds itself (``mixing.ADDED``, ``lang_pred``,
``score``), which raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanrisk.llm import catalog, exact_dedup, langid, mixing, simhash
from loanrisk.llm.common import table, written
from loanrisk.llm.exact_dedup import located

#: Least score of the predicted language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = catalog.language_model(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = langid.predict(docs, model, carry=docs.columns)
    return named.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    order = ["block", "block_order"]
    return mixing.mix(docs).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def in_table_order(docs: DataFrame) -> DataFrame:
    """``docs`` in partitions that follow the numbers of Spark's part files, and in
    them the rows; files named otherwise come first, by path."""
    file = F.col("_at.file")
    number = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long")
    order = [number.asc_nulls_first(), file, F.col("_at.row")]
    return located(docs).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return catalog.packed_pieces(in_table_order(docs))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k + 1}-{name.replace(' ', '_')}")
    return docs


#: SQL has no subword tokenizer, fingerprint or trained model.
ORACLE_SQL = None
