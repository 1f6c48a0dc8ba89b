import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from loanrisk.llm import catalog, components, simhash
from loanrisk.llm.common import written
from tests.conftest import SMALL

WORDS = re.compile("[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text, k=4):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    """Index -> index of a representative."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check(df, rows, **options):
    got = simhash.near_duplicates(df, **options).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    assert sorted((repr(r.doc_id), r.fingerprint) for r in got) == sorted((repr(i), f"{f:016x}") for (i, _), f in zip(rows, fps))
    comp = brute_components(fps, options.get("distance", 4))
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min([x for x in (i, least.get(c)) if x is not None], default=None)
    want = sorted((repr(i), repr(least[c])) for (i, _), c in zip(rows, comp))
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in got) == want
    assert sum(r.kept for r in got) == len(set(comp))
    assert all(r.doc_id == r.component_id for r in got if r.kept)


@pytest.mark.parametrize("options", [{}, {"max_file": 2}, {"blocks": 8}, {"blocks": 5, "max_file": 3}, {"distance": 2}])
def test_documents(spark, options):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], **options)


def test_sf001(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark, edge_docs, no_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and 0 < kept.count() < edge_docs.count()


@pytest.mark.parametrize("options", [{}, {"max_file": 50}, {"blocks": 7, "max_file": 10}])
def test_dense_group(spark, options):
    """Many fingerprints a few bits apart, in chains and clouds."""
    rng = random.Random(11)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    centre = rng.getrandbits(64)
    fps = {flip(centre, rng.randrange(0, 4)) for _ in range(150)}
    x = rng.getrandbits(64)
    for _ in range(40):
        fps.add(x := flip(x, 4))
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    df = written(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long"), "test")
    links = simhash.fingerprint_links(df, 4, **options)
    labels = {r.node % (1 << 64): r.label for r in components.connected_components(links).collect()}
    comp = brute_components(fps, 4)
    groups = {}
    for f, c in zip(fps, comp):
        groups.setdefault(c, set()).add(labels.get(f, f"alone {f}"))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g, key=str) for g in groups.values()}) == len(groups)


def test_masks_cover_every_close_pair():
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_masks(blocks, 4)
        rng = random.Random(blocks)
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in masks)
    with pytest.raises(ValueError):
        simhash.fingerprint_links(None, 3)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.createDataFrame([(1000, 1000), (-5, 2000), (2000, 3000), (2000, 3000)], "a long, b long"))
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, -5: -5, 2000: -5, 3000: -5}


def test_query_columns(spark):
    assert catalog.op10_simhash(spark, SMALL).columns == ["doc_id", "fingerprint", "component_id", "kept"]
