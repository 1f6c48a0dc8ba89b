import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loanrisk.llm import catalog, fim
from tests.conftest import SMALL


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", a, b - a, out


def check(df):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in rows), key=repr)
    assert sorted((tuple(r) for r in fim.restore(fim.transform(df)).collect()), key=repr) == want


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert fim.transform(no_docs).count() == 0


def odd_texts(n=400):
    rng = random.Random(4)
    bits = ["<", ">", "P", "S", "M", "<P", "<S", "P>", "<M>", "é", "漢字", "\U0001f600", "a", "\n", " ", ""]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for i in range(n)]


def test_parts_of_markers_and_wide_characters(spark):
    rows = odd_texts()
    assert {brute(*r)[1] for r in rows} == {"plain", "psm", "spm"}
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))


def test_sums_are_carried_over_stretches(monkeypatch):
    """The same bytes, whatever the size of a stretch and of a group."""
    rows = odd_texts()
    texts = [t.encode() for _, t in rows]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h = np.array([[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)] for i, _ in rows])
    for stretch in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(fim, "STRETCH", stretch)
        _, form, _, _, out, out_bounds = fim.transform_bytes(data, bounds, h)
        for (i, t), a, b in zip(rows, out_bounds, out_bounds[1:]):
            assert out[a:b].tobytes().decode() == brute(i, t)[4]
        back, back_bounds = fim.restore_bytes(out, out_bounds, form)
        assert back.tobytes() == data.tobytes() and back_bounds.tolist() == bounds.tolist()
    monkeypatch.setattr(fim, "GROUP", 50)
    assert [s.stop - s.start for s in fim._groups(np.array([10, 60, 0, 20, 20, 20]))] == [1, 1, 3, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<>PSMé\U0001f600a", max_size=12), max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_round_trip(texts, h1, h2):
    bodies = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)])
    h = np.array([[h1 + i, h2 - i, 0, i * 13] for i in range(len(texts))], np.int64).reshape(-1, 4)
    _, form, _, _, out, out_bounds = fim.transform_bytes(data, bounds, h)
    back, back_bounds = fim.restore_bytes(out, out_bounds, form)
    assert back.tobytes() == data.tobytes() and back_bounds.tolist() == bounds.tolist()


def test_options(spark, edge_docs):
    out = fim.transform(edge_docs, carry=("doc_id", "lang"), markers=(b"\x02pre", b"\x02suf", b"\x02mid"), changed_percent=100, spm_percent=0)
    back = fim.restore(out, markers=(b"\x02pre", b"\x02suf", b"\x02mid"))
    assert back.filter("n > 0 AND form <> 'psm'").count() == 0 and out.columns[:2] == ["doc_id", "lang"]
    assert sorted(r[0] for r in back.select("restored").collect()) == sorted(r[0] or "" for r in edge_docs.select("text").collect())
    with pytest.raises(ValueError):
        fim.transform(edge_docs, markers=(b"<P>", b"<<S", b"<M>"))
    with pytest.raises(ValueError):
        fim.transform(edge_docs.withColumnRenamed("lang", "form"), carry=("doc_id", "form"))
    with pytest.raises(ValueError):
        fim.restore_bytes(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([0, 8]), np.array([fim.PSM]))


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = catalog.op11_fim(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        *counts, out = brute(r.doc_id, rows[r.doc_id])
        assert list(r)[1:] == [*counts, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(rows[r.doc_id].encode()).hexdigest()]
