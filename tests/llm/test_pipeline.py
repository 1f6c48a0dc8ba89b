import zlib

import numpy as np

import corpus_pipeline
from loanrisk.llm import catalog, langid, mixing
from loanrisk.llm.common import table, written
from tests.conftest import SMALL
from tests.llm.test_exact_dedup import SPACES
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_tokens import check_pieces, plain


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "SimHash near-dedup", "mixing", "packing"]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        out = stage(spark, at, SMALL)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        at = written(out, "test")
        after = at.collect()
        if k == 0:
            named = langid.predict(docs, catalog.language_model(docs)).collect()
            keep = {r.doc_id for r in named if r.lang_pred != "und" and r.score >= 0.5}
            assert {r.doc_id for r in after} == keep
            assert len(after) >= 0.99 * len([r for r in before if any(c.isalpha() for c in r.text)])
        if k == 1:
            best = {}
            for r in before:
                key = SPACES.sub("", r.text)
                best[key] = min(best.get(key, (1,)), (-len(r.text), r.doc_id))
            assert {r.doc_id for r in after} == {i for _, i in best.values()}
        if k == 2:
            comp = brute_components([brute_fingerprint(r.text) for r in before], 4)
            least = {}
            for r, c in zip(before, comp):
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        if k == 3:
            plan = mixing.plan_copies(written(spark.createDataFrame(before, docs.schema), "test")).collect()
            assert [r.doc_id for r in after] == [r.doc_id for r in sorted(plan, key=lambda r: (r.block, r.block_order))]
            mixed = after
    ids = {r.doc_id: r.text for r in mixed}
    assert sum(p.length for p in after) == sum(len(plain(catalog.BYTE_BPE, r.text)) + 1 for r in mixed)
    for p in after:
        own = np.array(plain(catalog.BYTE_BPE, ids[p.doc_id]) + [0], "<u4")
        assert p.ids_crc32 == zlib.crc32(own[p.start:p.start + p.length].tobytes())
    if len(ids) == len(mixed):
        check_pieces(after, list(ids.items()), catalog.BYTE_BPE, 0, 1024)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None


def through(spark, docs):
    """What each stage returns."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "test")
        out.append(docs.collect())
    return out


def test_null_and_equal_ids(spark):
    """All ids null, or one on a third of the rows: the texts that come out of every
    stage but mixing are those that come out with good ids."""
    docs = table(spark, SMALL, "documents")
    want = through(spark, docs)
    for ids in ("CAST(NULL AS LONG)", "IF(doc_id % 3 = 0, 7, doc_id)"):
        named = written(docs.selectExpr(f"{ids} AS doc_id", *docs.columns[1:]), "test")
        got = through(spark, named)
        # the model learns from other rows, and may doubt another text
        assert abs(len(got[0]) - len(want[0])) <= 2 and len(got[0]) > 150
        for k in (1, 2):
            assert abs(len(got[k]) - len(want[k])) <= 2
        assert {r.text for r in got[3]} <= {r.text for r in got[2]} and len(got[3]) > 100
        tokens = sum(len(plain(catalog.BYTE_BPE, r.text)) + 1 for r in got[3])
        assert sum(p.length for p in got[4]) == tokens


def test_nothing_to_learn_from(spark):
    """Without a language, or with one id that is held out, texts with a letter stay."""
    assert zlib.crc32(b"6") % 5 == 0
    rows = [(6, f"some text of its own {i} " + chr(97 + i % 26) * 30, lang, "s", 1) for i, lang in enumerate(["en", None] * 20)]
    rows += [(6, "12 34", "en", "s", 1), (6, None, "en", "s", 1), (6, "", None, None, 1)]
    docs = written(spark.createDataFrame(rows, table(spark, SMALL, "documents").schema), "test")
    assert len(corpus_pipeline.language_id(spark, docs, SMALL).collect()) == 40
    nameless = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert len(corpus_pipeline.language_id(spark, written(nameless, "test"), SMALL).collect()) == 40


def test_edges(spark, edge_docs, no_docs):
    """Nulls, ties, repeated rows, long texts, clashing names; and no rows at all."""
    got = through(spark, edge_docs)
    assert all(r.text for r in got[0]) and got[4]
    assert [len(x) for x in through(spark, no_docs)] == [0] * 5
