import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from loanrisk.llm import catalog, line_dedup
from tests.conftest import SMALL

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    """Rows in document order -> (id, lines, dropped, kept text)."""
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    for place, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(place)
    out = []
    for place, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or place == max(holders[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(df, rows, **options):
    got = line_dedup.dedup_lines(df, **options).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=repr) == sorted(brute(rows, **options), key=repr)
    for r in got:
        keep = line_dedup.unpack_bits(r.bitmap, r.n_lines)
        assert (~keep).sum() == r.n_dropped


def random_docs(seed, n=120):
    """A hot line in most documents, lines of every frequency, repeats in a document."""
    rng = random.Random(seed)
    shared = [("É" if k % 3 else "x") * 20 + f" Shared Line {k} " + "y" * rng.randrange(0, 30) for k in range(30)]
    docs = []
    for i in range(n):
        lines = [shared[0]] * (rng.random() < 0.8) + [shared[min(29, int(rng.expovariate(0.2)))] for _ in range(rng.randrange(0, 8))]
        lines += [f"own {i} {k} " + "z" * rng.randrange(0, 60) for k in range(rng.randrange(0, 3))]
        rng.shuffle(lines)
        docs.append((i, "\n".join(rng.choice(["", " ", "\t\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\x0b "]) for x in lines)))
    return docs


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 3), (3, 40)])
def test_random_documents(spark, seed, partitions):
    rows = random_docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(df, rows)
        check(df, rows, min_docs=2, min_chars=10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def streamed(ranges, min_docs, size):
    """What ``dropped_lines`` makes of the ranges' verdicts, in Python."""
    dropped, open_, sums = set(), [], defaultdict(lambda: [0, -1])
    for rows in ranges:
        stream = line_dedup.KeyStream(min_docs)
        out = []
        for k in range(0, len(rows), size):
            part = rows[k:k + size]
            hashes = np.array([[h, 0] for h, _, _ in part], np.uint64)
            out += stream.take(hashes, np.array([d for _, d, _ in part]), np.array([p for _, _, p in part]))
            assert sum(len(d) for d, _ in stream.held) <= 3 * (min_docs - 1)  # of three lines a document
        out += stream.end()
        assert sum(b.num_rows for b in out if b.num_rows and b["kind"][0].as_py() == line_dedup.SUMMARY) <= 2
        for kind, key, doc, position in (r for b in out for r in zip(*(c.to_pylist() for c in b.columns))):
            if kind == line_dedup.DROPPED:
                assert (doc, position) not in dropped
                dropped.add((doc, position))
            elif kind == line_dedup.OPEN:
                open_.append((key, doc, position))
            else:
                sums[key] = [sums[key][0] + position, max(sums[key][1], doc)]
    late = {(d, p) for key, d, p in open_ if sums[key][0] >= min_docs and d != sums[key][1]}
    assert not dropped & late
    return dropped | late


@pytest.mark.parametrize("seed", range(30))
def test_keys_over_many_ranges(seed):
    """Ranges cut anywhere between two documents of a key; batches of any size."""
    rng = random.Random(seed)
    rows, position = [], 0
    for h in range(rng.randrange(1, 12)):
        for doc in sorted(rng.sample(range(60), rng.choice([1, 2, 3, 4, 5, 30])), reverse=True):
            for _ in range(rng.randrange(1, 4)):
                position += 1
                rows.append((h, doc, position))
    docs = defaultdict(set)
    for h, d, _ in rows:
        docs[h].add(d)
    want = {(d, p) for h, d, p in rows if len(docs[h]) >= 4 and d != max(docs[h])}
    cuts = [k for k in range(1, len(rows)) if rows[k][:2] != rows[k - 1][:2] and rng.random() < 0.3]
    ranges = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for size in (1, 2, 7, 1000):
        assert streamed(ranges, 4, size) == want


def test_edges(spark, edge_docs, no_docs):
    rows = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    check(edge_docs, rows)
    check(edge_docs, rows, min_docs=2)
    assert line_dedup.dedup_lines(no_docs).count() == 0 and line_dedup.keep_bitmaps(no_docs).count() == 0


def test_null_and_equal_ids(spark):
    """Each row is a document: of the same text six times, one stays whole."""
    line = "a line of forty code points or more, in every row"
    for ids in ([None] * 6, [3] * 6):
        out = line_dedup.dedup_lines(spark.createDataFrame([(i, f"{line}\nown") for i in ids], "doc_id long, text string")).collect()
        assert sorted((r.n_lines, r.n_dropped, r.kept) for r in out) == [(2, 0, f"{line}\nown")] + [(2, 1, "own")] * 5


def test_a_document_of_dropped_lines_alone(spark):
    line = "é" * 40
    rows = [(i, line) for i in range(5)] + [(5, "É" * 40), (6, "é" * 39)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_bitmaps(spark):
    rng = random.Random(1)
    for n in (1, 7, 8, 9, 1000):
        dropped = np.array(sorted(rng.sample(range(n), n // 3)), np.int64)
        keep = line_dedup.unpack_bits(line_dedup.pack_bits(n, dropped), n)
        assert len(keep) == n and np.flatnonzero(~keep).tolist() == dropped.tolist()


def test_query(spark):
    docs = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{docs}/documents.parquet").collect())
    want = [(i, n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, n, d, kept in brute(rows)]
    assert sum(d for _, _, d, _ in want)
    assert sorted(tuple(r) for r in catalog.op12_line_dedup(spark, docs).collect()) == want
