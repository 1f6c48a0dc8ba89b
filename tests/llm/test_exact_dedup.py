import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loanrisk.llm import catalog, exact_dedup
from loanrisk.llm.common import written
from tests.conftest import SMALL

SPACES = re.compile("[\x20\x09-\x0D]")


def brute(rows):
    """(id, text) -> sorted (doc_id, keep_id, size, kept, sha); equal rows count apart."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[SPACES.sub("", t or "")].append((-len(t or ""), i is None, i or 0, -k, i))
    out = []
    for body, members in groups.items():
        keep = min(members)[4]
        for rank, m in enumerate(sorted(members)):
            out.append((m[4], keep, len(members), rank == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_edges(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert got(exact_dedup.exact_dedup(edge_docs)) == brute(rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(catalog.op1_exact_dedup(spark, SMALL)) == brute(rows)


def test_colliding_digests_are_told_apart_by_bytes(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    weak = exact_dedup.exact_dedup(edge_docs, digest=lambda body: F.lit("same"))
    assert got(weak) == brute(rows)


def test_state_goes_on_with_new_files(spark, edge_docs, tmp_path):
    keys, state = str(tmp_path / "keys"), str(tmp_path / "state")
    first = spark.createDataFrame([(1, 5, "d1", ("f", 0)), (2, 9, "d2", ("f", 1))],
                                  "id long, points long, digest string, at struct<file: string, row: long>")
    more = spark.createDataFrame([(3, 7, "d1", ("g", 0)), (0, 7, "d1", ("g", 1))], first.schema)
    first.write.parquet(keys)
    exact_dedup.update_state(spark, keys, state)
    more.write.mode("append").parquet(keys)
    exact_dedup.update_state(spark, keys, state)
    rows = {r.digest: (r.n, r.first.file, ~r.stays.turned_id) for r in exact_dedup.read_state(spark, state).collect()}
    assert rows == {"d1": (3, "f", 0), "d2": (1, "f", 2)}


def test_drop_copies_keeps_columns(spark, edge_docs):
    kept = exact_dedup.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [SPACES.sub("", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({SPACES.sub("", r.text or "") for r in edge_docs.collect()})


def test_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
