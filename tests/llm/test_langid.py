import zlib

import numpy as np
import public_tokenizers as P
import pytest

from loanrisk.llm import catalog, langid
from tests.conftest import SMALL

SF = "/root/testdata/sf0.01"


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:n]] * all_segmentations(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p)


def small_model():
    pieces = [b"a", b"b", b"c", b" ", b"ab", b" a", b"abc", b"bc", b"cab", b" abcabca"]
    keys = np.array(sorted(langid._key(x) for x in pieces), np.uint64)
    rng = np.random.default_rng(0)
    table = rng.random((len(keys), 2))
    table[keys == langid._key(b"abc"), 0] = 0.0
    table /= table.sum(axis=0)
    by_piece = [{x: table[np.searchsorted(keys, langid._key(x)), k] for x in pieces} for k in range(2)]
    return langid.Model(["x", "y"], keys, np.vstack([table, np.zeros(2)])), by_piece


def test_forward_sums_all_segmentations():
    model, by_piece = small_model()
    words = [b" abcabcab", b"a", b" cab", b" abcabca", b"bcbcbc"]
    got = model.log_likelihood(words)
    for w, row in zip(words, got):
        assert row == pytest.approx([np.log(all_segmentations(w, p)) for p in by_piece])


def test_expected_uses_weigh_segmentations():
    model, by_piece = small_model()
    p = np.append(model.probability[:-1, 1], 0.0)
    got = langid._expected([b"abc"], np.array([2.0]), model.keys, p)
    q = by_piece[1]
    ways = {(b"a", b"b", b"c"): q[b"a"] * q[b"b"] * q[b"c"], (b"ab", b"c"): q[b"ab"] * q[b"c"], (b"a", b"bc"): q[b"a"] * q[b"bc"],
            (b"abc",): q[b"abc"]}
    for piece in q:
        want = 2 * sum(x * w.count(piece) for w, x in ways.items()) / sum(ways.values())
        assert got[np.searchsorted(model.keys, langid._key(piece))] == pytest.approx(want)


def test_words():
    assert langid.split_words("Ab-c1d  É") == [b" ab", b" c", b" d", " é".encode()]
    assert langid.split_words("x" * 60) == [b" " + b"x" * 23, b"x" * 24, b"x" * 13]


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op5_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    unseen = [docs[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert sum(unseen) >= 0.98 * len(unseen)


def test_batches_and_cache_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = catalog.language_model(docs)
    key = lambda df: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in df.collect()}
    assert key(langid.predict(docs, model)) == key(langid.predict(docs.repartition(7), model))
    for r in docs.limit(20).collect():  # a text's own words, one by one
        words = langid.split_words(r.text)
        total = model.log_likelihood(words).sum(axis=0)
        assert model.languages[int(total.argmax())] == key(langid.predict(docs.filter(docs.doc_id == r.doc_id), model))[r.doc_id][0]


def test_edges(spark, edge_docs, no_docs):
    path = P.path(catalog.BYTE_RANKS)
    model = langid.train(edge_docs, path)
    assert model.languages == ["de", "en", "fr"]
    rows = langid.predict(edge_docs, model, carry=edge_docs.columns).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred != "und" and r.score > 0
    assert {r.lang_pred for r in rows if r.doc_id == 6} == {"de"}
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.train(no_docs, path)
    assert {r.lang_pred for r in langid.predict(edge_docs, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(edge_docs.withColumn("score", edge_docs.doc_id), model, carry=["score"])


def test_query_against_plain_sums(spark):
    """Language and score of every document, by sums over segmentations in plain Python
    with the model's probabilities: no arrays, no cache, no pieces of text."""
    import functools
    import math

    import regex
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = catalog.language_model(docs)
    names = [int(k).to_bytes(8, "big").lstrip(b"\0") for k in model.keys] + list(model.long)
    table = {n: model.probability[i].tolist() for i, n in enumerate(names)}
    longest = max(map(len, names))

    @functools.lru_cache(None)
    def log_likelihood(word):
        out = []
        for k in range(len(model.languages)):
            a = [1.0] + [0.0] * len(word)
            for i in range(1, len(word) + 1):
                a[i] = math.fsum(a[j] * table[word[j:i]][k] for j in range(max(0, i - longest), i) if word[j:i] in table)
            out.append(math.log(a[-1]))
        return out

    got = {r.doc_id: r for r in catalog.op5_language_id(spark, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        words = [b" " + w.encode() for w in regex.findall(r"\p{L}+", (r.text or "").lower())]
        mine = got[r.doc_id]
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not words:
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        totals = [math.fsum(log_likelihood(w)[k] for w in words) * langid.SHARPNESS / len(words) for k in range(len(model.languages))]
        best = max(totals)
        assert mine.lang_pred == model.languages[totals.index(best)]
        assert mine.score == pytest.approx(1 / sum(math.exp(t - best) for t in totals), rel=1e-6)
