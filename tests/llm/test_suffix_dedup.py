import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanrisk.llm import catalog, suffix_dedup
from tests.conftest import SMALL


def brute(texts, length=100):
    """Texts in order -> (bytes, removed spans, kept)."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                covered[s:s + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out.append((len(b), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(b, np.uint8)[~covered])))
    return out


def check(df, rows, **options):
    got = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in
                  suffix_dedup.remove_repeats(df, **options).collect()), key=repr)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]))), key=repr)


def random_docs(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé \n") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(rng.randrange(20, 80))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(word() for _ in range(rng.randrange(1, 60)))
                 for _ in range(rng.randrange(0, 6))]
        text = "".join(parts)
        if rng.random() < 0.2:  # overlapping repeats of a short cycle
            text += "xyz" * rng.randrange(10, 120)
        docs.append((i, text))
    return docs


@pytest.mark.parametrize("seed, max_bucket", [(1, 50_000), (2, 2)])
def test_random_texts(spark, monkeypatch, seed, max_bucket):
    rows = random_docs(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df, rows, max_bucket=max_bucket)


def test_stretches_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(6000)).encode()
    whole = suffix_dedup.runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    import pyarrow as pa
    windows = set()
    for data, bounds, rows, begin in suffix_dedup._stretches(pa.array([text], pa.large_binary()), 100):
        t, first, last, bucket, _ = suffix_dedup.runs(data, bounds)
        for k in range(len(t)):
            windows |= {(w + begin[t[k]], bucket[k]) for w in range(first[k], last[k] + 1)}
    assert windows == {(w, b) for _, first, last, b in zip(*whole[:4]) for w in range(first, last + 1)}


def test_hash_collisions_in_initial_buckets(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_gram_hash", lambda words: np.zeros(len(words), np.uint64))
    rng = random.Random(5)
    base = bytes(rng.choice(b"ab") for _ in range(160))
    contexts = [np.frombuffer(x, np.uint8) for x in (base, base[10:150], bytes(rng.choice(b"ab") for _ in range(130)))]
    flags = suffix_dedup.refine(contexts, np.array([1, 2, 3]), np.array([0, 0, 0]))
    assert flags.tolist() == [False] * 61 + [True] * 41 + [False] * 31


def test_edges(edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    check(edge_docs, rows)


def test_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want = sorted((i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest())
                  for (i, _), (n, s, k) in zip(rows, brute([t for _, t in rows])))
    assert sorted(tuple(r) for r in catalog.op3_suffix_dedup(spark, SMALL).collect()) == want


def test_empty(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_shared_passage_without_a_whole_window(spark):
    """Buckets with several contexts, none of whose windows repeats."""
    rng = random.Random(11)
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = part(60)
    rows = [(1, part(90) + shared + part(90)), (2, part(70) + shared + part(110))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    rows += [(3, part(50)), (4, part(99)), (5, None), (6, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows)


@pytest.mark.parametrize("max_bucket", [10, 50_000])
def test_passage_in_a_third_of_the_documents(spark, max_bucket):
    """One q-gram bucket with a context for each of them, between other neighbours."""
    rng = random.Random(12)
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, whole = part(70), part(140)
    rows = [(i, part(120) + (short if i % 3 == 0 else whole if i % 3 == 1 else "") + part(120)) for i in range(150)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, max_bucket=max_bucket)


@pytest.mark.parametrize("seed", range(20))
def test_buckets_over_many_ranges(seed):
    """Ranges cut between any two contexts, batches of any size: the same repeats, and
    the first rows of contexts in buckets with several."""
    import pyarrow as pa
    rng = random.Random(seed)
    rows = sorted((False, b, c, 0, rng.randrange(50), rng.randrange(1000)) for b in range(rng.randrange(1, 9))
                  for c in rng.sample(range(100), rng.choice([1, 1, 2, 9])) for _ in range(rng.choice([1, 1, 3])))
    contexts = {}
    for r in rows:
        contexts.setdefault(r[1], {}).setdefault(r[2], r)
    want_open = {(r[1], r[4], r[5]) for by in contexts.values() if len(by) > 1 for r in by.values()}
    heads = [r for by in contexts.values() for r in by.values()]
    cuts = [k for k in range(1, len(rows)) if rows[k][1:3] != rows[k - 1][1:3] and rng.random() < 0.4]

    class Rows:  # what mapInArrow gives a task
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    run = suffix_dedup._compare_contexts(Rows()).run
    kinds = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        size = rng.choice([1, 2, 5, 100])
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in ([r[1] for r in part], [r[2] for r in part], [r[3] for r in part], [r[4] for r in part],
                                              [r[5] for r in part], [r[5] for r in part], [r[0] for r in part])], suffix_dedup.RUN_NAMES)
                   for part in (rows[k:min(k + size, b)] for k in range(a, b, size))]
        kinds += [tuple(r.values()) for out in run(iter(batches)) for r in out.to_pylist()]
    ends = [r for r in kinds if r[6] >= suffix_dedup.BORDER]
    spread = {r[0] for r in ends if sum(x[0] == r[0] for x in ends) > 1}
    got = [r for r in kinds if r[6] == suffix_dedup.OPEN] + [r for r in ends if r[6] == suffix_dedup.BORDER and r[0] in spread]
    assert sorted((r[0], r[3], r[4]) for r in got) == sorted(want_open)
    repeats = [r for r in kinds if r[6] == suffix_dedup.REPEATED]
    assert len(repeats) == len(rows) - len(heads)
