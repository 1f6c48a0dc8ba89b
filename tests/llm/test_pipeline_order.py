import corpus_pipeline
from loanrisk.llm.common import written
from tests.conftest import SMALL


def test_sequences_follow_the_table_over_files_of_unequal_size(spark):
    """The last file is the largest, so Spark would read it first."""
    sizes = [1, 40, 3, 200, 800]
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    texts = spark.sparkContext.parallelize(range(len(sizes)), len(sizes)).flatMap(
        lambda k: [(starts[k] + i, f"document {i} of file {k}. " * 40) for i in range(sizes[k])])
    docs = written(spark.createDataFrame(texts, "doc_id long, text string"), "test")
    assert len(docs.inputFiles()) == len(sizes)
    pieces = sorted(corpus_pipeline.pack(spark, docs, SMALL).collect(), key=lambda p: (p.sequence_id, p.offset))
    ids = [p.doc_id for p in pieces]
    assert ids == sorted(ids) and set(ids) == set(range(sum(sizes)))
