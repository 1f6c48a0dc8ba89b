import hashlib
import math
import re
from collections import defaultdict

import pytest

from loanrisk.llm import catalog, mixing
from loanrisk.llm.common import written


def weights(tokens, entropy_share, max_epochs, budget):
    total = sum(tokens)
    q = [t / total for t in tokens]

    def w(t):
        z = sum(x ** t for x in q)
        return [x ** t / z for x in q]
    entropy = lambda t: -sum(x * math.log(x) for x in w(t))
    most = lambda t: max(x / y for x, y in zip(w(t), q)) * budget / total
    grid = [k / 20000 for k in range(20001)]
    t = max((x for x in grid if entropy(x) >= entropy_share * math.log(len(q)) - 1e-9), default=0)
    if most(t) > max_epochs:
        t = min((x for x in grid if x >= t and most(x) <= max_epochs), default=1.0)
    return t, w(t)


def brute(rows, weight, budget, block_tokens, seed=42):
    """rows: source -> [(id, tokens)]; the copies that the mixture takes."""
    out, n_blocks = [], -(-budget // block_tokens)
    for source, members in rows.items():
        quota, at, epoch = math.floor(weight[source] * budget), 0, 0
        while at < quota:
            order = sorted(members, key=lambda m: hashlib.md5(f"{seed}:{epoch}:{m[0]}".encode()).hexdigest())
            for i, n in order:
                if at < quota:
                    out.append((i, source, n, epoch, at, at * n_blocks // quota))
                at += n
            epoch += 1
    return sorted(out)


@pytest.mark.parametrize("entropy_share, max_epochs, factor", [(0.98, 4.0, 1), (0.999, 4.0, 2), (1.0, 1.5, 1), (0.5, 4.0, 0.3)])
def test_copies(spark, monkeypatch, entropy_share, max_epochs, factor):
    monkeypatch.setattr(mixing, "CELL_ROWS", 16)  # many cells
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 7 = 1 THEN NULL ELSE concat('s', doc_id % 5) END AS source")
    docs = written(docs, "test")
    rows = defaultdict(list)
    for r in docs.collect():
        rows[r.source].append((r.doc_id, len(r.text.split())))
    sources = list(rows)
    tokens = [sum(n for _, n in rows[s]) for s in sources]
    budget = int(factor * sum(tokens))
    got = mixing.plan_copies(docs, budget_tokens=budget, entropy_share=entropy_share, max_epochs=max_epochs, block_tokens=20_000).collect()
    t, w = weights(tokens, entropy_share, max_epochs, budget)
    assert got[0].exponent == pytest.approx(t, abs=1e-4)
    held = {r.source: r.weight for r in got}
    assert [held[s] for s in sources] == pytest.approx(w, abs=1e-3)
    want = brute(rows, held, budget, 20_000)
    key = lambda r: (r[0], r[3])
    assert sorted(((r.doc_id, r.source, r.tokens, r.epoch, r.token_start, r.block) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.block_order == hashlib.md5(f"42:block:{r.block}:{r.epoch}:{r.doc_id}".encode()).hexdigest()


def test_edges(spark, edge_docs, no_docs):
    rows = mixing.mix(edge_docs, budget_tokens=20_000, block_tokens=500).collect()
    assert rows and set(edge_docs.columns) < set(rows[0].asDict())
    ranges = defaultdict(list)
    for r in rows:
        assert r.tokens == len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))
        ranges[r.source].append((r.token_start, r.tokens))
    for spans in ranges.values():  # each source's stream is gapless
        spans.sort()
        at = 0
        for start, n in spans:
            assert start == at
            at += n
    assert mixing.mix(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(edge_docs.withColumn("epoch", edge_docs.doc_id))


def test_nothing_but_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    got = catalog.op8_mixing(spark, sf).collect()
    assert len({r.source for r in got}) == 20 and {r.epoch for r in got} <= {0, 1}


@pytest.mark.parametrize("ids", ["CAST(NULL AS LONG)", "IF(doc_id % 3 = 0, 7, doc_id)"])
def test_null_and_equal_ids(spark, ids):
    """Rows without an id of their own fall into many cells and are permuted."""
    docs = written(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr(f"{ids} AS doc_id", "text", "source"), "test")
    rows = mixing.plan_copies(docs).collect()
    same = [r for r in rows if r.doc_id in (None, 7)]
    assert len({r.block_order for r in same}) == len(same) > 200
    first = [r.at.row for r in sorted(same, key=lambda r: r.token_start) if r.epoch == 0 and r.source == same[0].source]
    steps = [abs(a - b) for a, b in zip(first, first[1:])]
    assert sum(steps) / len(steps) > 150  # no file order
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for copies in by_source.values():  # the stream has no gaps
        copies.sort(key=lambda r: (r.token_start, r.tokens))
        assert all(b.token_start - a.token_start in (0, a.tokens) for a, b in zip(copies, copies[1:]))
