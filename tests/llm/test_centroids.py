import hashlib
import math
import random

import numpy as np
import pytest

from loanrisk.llm import catalog, centroids
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<float>, cluster int, distance string, v string"


def brute(rows, k=40, dimensions=64, rounds=5):
    """(vec_id, vector) -> sorted rows of the result, in whole numbers of Python."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    around = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(around))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(around)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                around[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in last if c == j) for j in range(len(around))]
    return sorted(((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, around[c])).encode()).hexdigest())
                   for i, d, c in last), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def check(df, **options):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((tuple(r) for r in centroids.cluster(df, **options).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rows, **options)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in catalog.op13_centroids(spark, SMALL).collect()), key=repr) == brute(rows)


def test_edges(spark):
    """Nulls, wrong sizes, infinities, ties, a vector that a third of the rows share,
    repeated ids, clashing names."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.02) for _ in range(4)]) for i in range(60)] + [(100 + i, [0.5, 0.5, -0.5, 0.0]) for i in range(40)]
    rows += [(1, [0.1] * 4), (1, [0.1] * 4), (1, [-0.1] * 4), (None, [0.2] * 4), (None, [0.3] * 4), (7, None), (8, []), (9, [0.1] * 3),
             (10, [0.1, None, 0.1, 0.1]), (11, [math.nan] * 4), (12, [math.inf, 0.0, 0.0, 0.0]), (13, [0.1] * 5), (14, [-0.0, 0.0, 1e-30, -1e-30]),
             (15, [500_000.0, -500_000.0, 1.0, 2.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, 1, "d", "v") for i, v in rows], VECTORS).repartition(3)
    for k in (1, 2, 7, 40, 500):
        check(df, k=k, dimensions=4)


def test_few_or_none(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2], 0, "", ""), (2, None, 0, "", "")], VECTORS)
    check(df, dimensions=2)
    assert centroids.cluster(df.filter("vec_id = 2"), dimensions=2).count() == 0
    assert centroids.cluster(df.limit(0), dimensions=2).count() == 0


def test_beyond_the_largest(spark):
    df = spark.createDataFrame([(1, [1e9, 0.2], 0, "", "")], VECTORS)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df, dimensions=2).collect()


@pytest.mark.parametrize("seed, size", [(1, 3), (2, 50), (3, 1 << 26)])
def test_search(seed, size):
    """The same centroid and distance as comparing with all, equal centroids and
    ties included; and clustered vectors need fewer distances."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(-size, size + 1, (30, 16))
    around = np.concatenate([middle, middle[:5]])
    x = np.concatenate([rng.integers(-size, size + 1, (500, 16)), middle[rng.integers(0, 30, 300)], (middle[:10] + middle[10:20]) // 2])
    cluster, distance, computed = centroids.Centroids(around).nearest(x)
    full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in around] for v in x]
    assert [(min(f), f.index(min(f))) for f in full] == list(zip(distance.tolist(), cluster.tolist()))
    assert computed < len(x) * len(around)


def test_bounds_reject_most(spark):
    """Vectors with means and deviations of their own: few distances are computed."""
    rng = np.random.default_rng(3)
    around = np.arange(40)[:, None] * 50 + rng.integers(-20, 20, (40, 64))
    x = around[rng.integers(0, 40, 1000)] + rng.integers(-3, 4, (1000, 64))
    _, _, computed = centroids.Centroids(around).nearest(x)
    assert computed < 2.5 * len(x)
