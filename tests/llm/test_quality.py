import math
import random
import re
from collections import Counter

import pytest

from loanrisk.llm import catalog, quality
from tests.conftest import SMALL

WORDS = re.compile("[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\W\d_]+")


def base(text):
    t = text or ""
    words = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def histograms(text):
    t = text or ""
    spaces = len(t) - sum(map(len, WORDS.findall(t)))
    kinds = [sum("A" <= c <= "Z" for c in t), sum("0" <= c <= "9" for c in t), sum(c in ".,;:!?" for c in t),
             sum(c in "#*$%&|<>@^~_=+/\\{}[]" for c in t), sum(ord(c) > 127 for c in t), spaces]
    kinds.append(len(t) - sum(kinds))
    words = LETTERS.findall(t.lower())
    common = {w for ws in quality.COMMON_WORDS.values() for w in ws}
    return kinds, Counter(w for w in words if w in common), len(words)


def js(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def brute(rows):
    """(id, base counts, least class distance, (ratio, distance, limit) of words) of each row."""
    common = sorted({w for ws in quality.COMMON_WORDS.values() for w in ws})
    judged = [(i, lang, base(text), len(text or ""), *histograms(text)) for i, text, lang in rows]

    def reference(row):
        _, lang, counts, chars, _, words, n = row
        return (lang in quality.COMMON_WORDS and not failed(counts) and chars >= 200 and n >= 60
                and sum(words[w] for w in quality.COMMON_WORDS[lang]) >= 0.1 * n)

    whole = {}
    for row in filter(reference, judged):
        s = whole.setdefault(row[1], [0, 0, 0, [0] * 7, Counter()])
        s[0], s[1], s[2], s[3] = s[0] + 1, s[1] + row[3], s[2] + row[6], [a + b for a, b in zip(s[3], row[4])]
        s[4] += row[5]
    out = []
    for row in judged:
        i, lang, counts, chars, kinds, words, n = row
        classes, word = [], []
        for ref, (texts, ref_chars, ref_words, ref_kinds, ref_common) in whole.items():
            own = reference(row) and ref == lang
            if texts - own < 20:
                continue
            q = [(a - own * b) / (ref_chars - own * chars) for a, b in zip(ref_kinds, kinds)]
            wq = [(ref_common[w] - own * words[w]) / (ref_words - own * n) for w in common]
            thin = [x / 20 for x in wq]
            if chars >= 200:
                classes.append(js([k / chars for k in kinds], q))
            if n >= 60:
                p = [words[w] / n for w in common]
                limit = js(thin + [1 - sum(thin)], wq + [1 - sum(wq)])
                distance = js(p + [1 - sum(p)], wq + [1 - sum(wq)])
                word.append((distance / limit, distance, limit))
        out.append((i, counts, min(classes, default=None), min(word, default=None)))
    return out


def failed(counts):
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def check(df, rows):
    got = sorted(df.collect(), key=lambda r: (repr(r.doc_id), r.n_words, r.word_chars))
    want = sorted(brute(rows), key=lambda r: (repr(r[0]), *r[1]))
    assert len(got) == len(want)
    for g, (i, counts, classes, word) in zip(got, want):
        assert (g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (i, *counts)
        assert g.base_failed == failed(counts)
        assert g.class_distance == (classes if classes is None else pytest.approx(classes, abs=2e-6))
        assert (g.word_distance, g.word_limit) == (word if word is None else pytest.approx(word[1:], abs=2e-6)) if word else g.word_distance is None
        assert g.kept == (not g.base_failed and (classes or 0) <= 0.30 and (word or [0])[0] <= 1)


def test_query(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(catalog.op2_quality(spark, SMALL), rows)


def test_edges(edge_docs):
    check(quality.quality(edge_docs), [(r.doc_id, r.text, r.lang) for r in edge_docs.collect()])


def test_repeats_counted_once_where_windows_overlap(spark):
    df = spark.createDataFrame([(1, "a a a a a a a b", "en"), (2, "a b c d e x a b c d e y", "en"), (3, "p\np\n\n \np", "en")],
                               "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality.quality(df).collect()}
    assert got == {1: (7, 0), 2: (10, 0), 3: (0, 2)}


def test_symbol_noise_is_dropped_and_prose_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = catalog.op2_quality(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("NOT base_failed").collect()
    noise = [x.kept for x in r if x.n_symbols > x.n_words]
    prose = [x.kept for x in r if x.n_symbols == 0]
    assert sum(noise) <= 0.05 * len(noise) and sum(prose) >= 0.995 * len(prose)


def noise(kind, lang, n=300, start=10**6):
    """Long texts of random letters, of symbols, or of digits."""
    rng = random.Random(kind)
    letters = {"letters": "abcdefghijklmnopqrstuvwxyz", "symbols": "#*$%&|<>@^~_=+", "digits": "0123456789"}[kind]
    return [(start + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(120)), lang) for i in range(n)]


@pytest.mark.parametrize("kind", ["letters", "symbols", "digits"])
@pytest.mark.parametrize("lang", ["en", "xx", None])
def test_noise_is_rejected_whatever_its_label(spark, kind, lang):
    """As many noisy texts as there are of their language, or in a language of their
    own: all go; and the prose stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame(noise(kind, lang), docs.schema)
    got = {r.doc_id: r for r in quality.quality(docs.unionByName(more)).collect()}
    # digits are no words of letters: the class distance alone decides
    assert [i for i, r in got.items() if i >= 10**6 and r.kept] == []
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id").collect()
    judged = [got[r.doc_id].kept for r in good if not got[r.doc_id].base_failed]
    assert len(judged) > 300 and sum(judged) >= 0.99 * len(judged)


def test_each_distance_decides(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    alone = Counter()
    for _, counts, classes, word in brute(rows):
        if not failed(counts):
            alone[(classes or 0) > 0.30, (word or [0])[0] > 1] += 1
    assert alone[True, False] and alone[False, True]


def test_a_wrong_label_costs_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    turned = docs.selectExpr("doc_id", "text", "IF(doc_id % 10 = 3, IF(lang = 'en', 'fr', 'en'), lang) AS lang")
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").collect()}
    got = [r.kept for r in quality.quality(turned).collect() if r.doc_id in good and r.doc_id % 10 == 3 and not r.base_failed]
    assert len(got) > 20 and all(got)


def test_empty(no_docs):
    assert quality.quality(no_docs).count() == 0


def test_plan_has_no_python(spark):
    for name in ("op2_quality", "op7_chat", "op8_mixing"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name
