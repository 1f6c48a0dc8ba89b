import zlib
from collections import Counter

import pytest

from loanrisk.llm import catalog, sharding
from loanrisk.llm.common import written
from tests.conftest import SMALL


def check(rows, shards):
    """Sizes one apart, slots gapless, every shard with its part of each source."""
    sizes = Counter(r.shard for r in rows)
    n = len(rows)
    assert all(n // shards <= sizes[s] <= -(-n // shards) for s in range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    by_source = Counter(r.source for r in rows)
    both = Counter((r.source, r.shard) for r in rows)
    for source, m in by_source.items():
        for s in range(shards):
            # the cut of the whole and of the source differ by less than a row a source
            assert abs(both[source, s] - m * sizes[s] / n) < 1 + len(by_source) * m / n + 1


def test_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id", "IF(doc_id % 3 = 0, 'hot', source) AS source")
    check(sharding.stratified_shards(docs, 8).collect(), 8)


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = catalog.op6_sharding(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes.values()) == {25} and {(r.shard, r.slot) for r in rows} == {(s, k) for s in range(8) for k in range(25)}


def test_brute_force_order(spark):
    """The same order by sorting in Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "IF(doc_id % 3 = 0, 'hot', source) AS source")
    keys = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(42, doc_id) AS k").collect()}
    rows = [(r.source, keys[r.doc_id], r.doc_id) for r in docs.collect()]
    ranks, by_source = [], Counter(s for s, _, _ in rows)
    seen = Counter()
    for s, k, i in sorted(rows):
        ranks.append(((2 * seen[s] + 1) / (2 * by_source[s]), s, k, i))
        seen[s] += 1
    want = {}
    for place, (_, _, _, i) in enumerate(sorted(ranks)):
        shard = place * 7 // len(rows)
        want[i] = (shard, place - -(-shard * len(rows) // 7))
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.stratified_shards(docs, 7).collect()} == want


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_edges(edge_docs, shards):
    rows = sharding.stratified_shards(edge_docs, shards).collect()
    assert len(rows) == edge_docs.count()
    check(rows, shards)


def test_more_rounds_give_the_same(spark, edge_docs):
    docs = written(edge_docs, "test")
    key = lambda n: sorted(map(repr, sharding.stratified_shards(docs.repartition(n), 4).select("doc_id", "shard", "slot").collect()))
    assert key(1) == key(5)


def test_empty_and_clash(no_docs, edge_docs):
    assert sharding.stratified_shards(no_docs, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.stratified_shards(edge_docs.withColumn("slot", edge_docs.doc_id), 3)


@pytest.mark.parametrize("ids", ["CAST(NULL AS LONG)", "IF(doc_id % 3 = 0, 7, doc_id)"])
def test_null_and_equal_ids(spark, ids):
    """Rows without an id of their own are shuffled and spread like others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr(f"{ids} AS doc_id", "text", "source", "doc_id AS _note")
    docs = written(docs, "test")
    out = sharding.stratified_shards(docs, 8).collect()
    check(out, 8)
    assert sorted(r._note for r in out) == list(range(1000))
    order = [r._note for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.doc_id in (None, 7)]
    steps = [abs(a - b) for a, b in zip(order, order[1:])]
    assert sum(steps) / len(steps) > 200  # no stretch in file order
    key = lambda d: sorted((r._note, r.shard, r.slot) for r in sharding.stratified_shards(d, 8).collect())
    assert key(docs.repartition(1)) == key(docs.repartition(7))
