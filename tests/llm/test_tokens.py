"""Token files (operator 4), packing (operator 9) and their shared encoder."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanrisk.llm import catalog, packing, token_files, wordwise
from loanrisk.llm.common import scratch
from tests.conftest import SMALL

FILES = [catalog.WORD_BPE, catalog.BYTE_BPE]
_plain = {}


def plain(name, text):
    if name not in _plain:
        _plain[name] = Tokenizer.from_file(P.path(name))
        _plain[name].encode_special_tokens = True
    return _plain[name].encode(text or "", add_special_tokens=False).ids


def encode(name, texts, end_id=None):
    out = []
    for _, ids, cuts in wordwise.encoder(P.path(name)).encode(pa.array(texts, pa.string()), end_id):
        out += [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    return out


# letters, marks, white space of many kinds, punctuation and contractions
texts = st.text(st.sampled_from(list("abAB zéÉß'st.,!?12 \n\t\r") + [" ", " ", "́", "　", "\x85", "中", "İ", "Σ", "×", "😀"]), max_size=40)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=200, deadline=None)
@given(batch=st.lists(st.one_of(st.none(), texts), max_size=6))
def test_ids_are_the_library_s(name, batch):
    assert encode(name, batch) == [plain(name, t) for t in batch]


@pytest.mark.parametrize("name", FILES)
def test_ids_of_documents(spark, name):
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [plain(name, t) + [7] for t in docs]
    assert encode(name, docs, 7) == want
    assert encode(name, docs[::-1], 7) == want[::-1]  # with a filled cache


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(wordwise, "CACHE_PIECES", 3)
    e = wordwise.PieceEncoder(P.path(catalog.BYTE_BPE))
    for batch in (["a b a b", "c d c d e"], ["c e e a a", None, ""]):
        got = [ids[a:b].tolist() for _, ids, cuts in e.encode(pa.array(batch)) for a, b in zip(cuts, cuts[1:])]
        assert got == [plain(catalog.BYTE_BPE, t) for t in batch]
    assert 0 < len(e.index) <= 3


@settings(max_examples=100, deadline=None)
@given(bits=st.integers(1, 32), n=st.integers(0, 3000), block=st.sampled_from([8, 64, 4096]), seed=st.integers(0, 9))
def test_packed_round_trip_and_random_access(bits, n, block, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 1 << bits, n)
    payload = token_files.pack(ids, bits, block)
    assert (token_files.unpack(payload) == ids).all()
    a = int(rng.integers(0, n + 1))
    c = int(rng.integers(0, 500))
    assert (token_files.unpack(payload, a, c) == ids[a:a + c]).all()
    n_blocks = -(-n // block)
    full = n_blocks * block * bits // 8 if n % block == 0 else (n // block * block * bits // 8) + -(-(n % block) * bits // 8)
    if bits not in (8, 16, 32):
        assert len(payload) <= token_files.HEAD.size + 8 * (n_blocks + 1) + full + 1


def test_bits_and_range():
    assert [token_files.bits_for(v) for v in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        token_files.pack(np.array([4]), 2)


def check_files(got, rows, name, end_id):
    """rows: (id, text) in file order."""
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = plain(name, t) + [end_id]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)


@pytest.mark.parametrize("segment_ids", [1 << 20, 40])
def test_token_files_edges(spark, edge_docs, segment_ids):
    path = scratch(spark, "test")
    token_files.write_token_files(edge_docs, path, P.path(catalog.WORD_BPE), 1 << 17, 2, block_ids=16, segment_ids=segment_ids)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == edge_docs.count()
    texts = {}
    for r in edge_docs.collect():
        texts.setdefault(r.doc_id, r.text)
    check_files(got, [(i, texts[i]) for i in ids], catalog.WORD_BPE, 2)


def test_token_files_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    start = 0
    for r, (i, t) in zip(sorted(catalog.op4_token_files(spark, SMALL).collect()), rows, strict=True):
        ids = plain(catalog.WORD_BPE, t) + [2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_no_documents(spark, no_docs):
    path = scratch(spark, "test")
    token_files.write_token_files(no_docs, path, P.path(catalog.WORD_BPE), 49_408, 2)
    assert token_files.read_token_files(spark, path).count() == 0
    assert packing.pack(no_docs, P.path(catalog.BYTE_BPE), 0).count() == 0


def cheapest(at, penalty, window, least_power, window_cost):
    """The programme without queue or tables."""
    cost = [0.0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                power = n >= least_power and n & (n - 1) == 0
                options.append(cost[i] + (0 if power else window - n))
        cost.append(min(options) + penalty[j] + window_cost)
    return cost[-1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    at = np.cumsum([0] + [rng.randrange(1, 17) for _ in range(80)])
    penalty = np.array([0.0] + [rng.choice([0.0, 2.0, 9.0]) for _ in range(80)])
    cuts = packing.best_cuts(at, penalty, 32, 4, 1.0)
    total = 0.0
    for i, j in zip(cuts, cuts[1:]):
        n = int(at[j] - at[i])
        assert n <= 32
        total += penalty[j] + 1.0 + (0 if n >= 4 and n & (n - 1) == 0 else 32 - n)
    assert cuts[0] == 0 and cuts[-1] == 80
    assert total == pytest.approx(cheapest(at.tolist(), penalty.tolist(), 32, 4, 1.0))


def check_pieces(pieces, rows, name, end_id, window):
    """Each id in exactly one piece; sequences gapless; (tokens, padding)."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in rows:
        ids, at = plain(name, t) + [end_id], 0
        for p in sorted(by_doc.pop(i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            part = np.array(ids[at:at + p.length], "<u4").tobytes()
            assert (bytes(p.ids) == part) if "ids" in p else (p.ids_crc32 == zlib.crc32(part))
            at += p.length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == s[0].sequence_length <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return sum(p.length for p in pieces), padding


@pytest.mark.parametrize("window, block", [(1024, 1 << 20), (32, 100)])
def test_pieces(spark, window, block):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3, "doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.pack(docs, P.path(catalog.BYTE_BPE), 0, window=window, block_tokens=block).collect()
    check_pieces(pieces, rows, catalog.BYTE_BPE, 0, window)


def test_packing_query_pads_little(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokens, padding = check_pieces(catalog.op9_packing(spark, sf).collect(), rows, catalog.BYTE_BPE, 0, 1024)
    assert padding < 0.01 * tokens


def test_packing_edges(spark, edge_docs):
    """Documents with equal ids stay apart: their pieces are those of a fresh id."""
    from pyspark.sql import functions as F
    pieces = packing.pack(edge_docs, P.path(catalog.BYTE_BPE), 0).collect()
    assert sum(p.length for p in pieces) == sum(len(plain(catalog.BYTE_BPE, r.text)) + 1 for r in edge_docs.collect())
    fresh = edge_docs.withColumn("doc_id", F.monotonically_increasing_id())
    rows = [(r.doc_id, r.text) for r in fresh.collect()]
    check_pieces(packing.pack(fresh, P.path(catalog.BYTE_BPE), 0).collect(), rows, catalog.BYTE_BPE, 0, 1024)
