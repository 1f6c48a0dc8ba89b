import math
import random

import numpy as np
import public_tokenizers as P
import pytest

from loanrisk.llm import catalog, langid


def all_segmentations(word, p):
    """Natural logarithm of the sum over all segmentations."""
    logs = [0.0]
    for i in range(1, len(word) + 1):
        ways = [logs[i - n] + math.log(p[word[i - n:i]]) for n in range(1, i + 1) if p.get(word[i - n:i])]
        most = max(ways)
        logs.append(most + math.log(sum(math.exp(x - most) for x in ways)))
    return logs[-1]


def model():
    rng = np.random.default_rng(1)
    thai = "กขค"
    short = [bytes([b]) for b in sorted({*b" abc", *thai.encode()})] + [b"ab", b" a", "ข".encode(), b"bcabcabc"]
    long = sorted([b"abcabcabc", b" abcabcab", b"abcabcabcabcabcabcabcabcabc", thai.encode() * 2, b"abcabcabb"], key=lambda x: (len(x), x))
    keys = np.array(sorted(map(langid._key, short)), np.uint64)
    table = rng.random((len(keys) + len(long), 2))
    table /= table.sum(axis=0)
    named = [{**{x: table[np.searchsorted(keys, langid._key(x)), k] for x in short},
              **{x: table[len(keys) + i, k] for i, x in enumerate(long)}} for k in range(2)]
    return langid.Model(["x", "y"], keys, np.vstack([table, np.zeros(2)]), long), named


def test_words_of_any_length_are_summed_whole(monkeypatch):
    m, named = model()
    rng = random.Random(3)
    texts = ["abcabcabc", "abcabcab", "abcabcabb", "กขคกขค", "กขค" * 40, "abc" * 300, "a" * 25]
    texts += ["".join(rng.choice("abcก") for _ in range(n)) for n in (5, 9, 20, 23, 24, 25, 60, 60, 500, 3000)]
    words = [w for t in texts for w in langid.whole_words(t)]
    assert len(words) == len(texts) and max(map(len, words)) > 3000
    want = [[all_segmentations(w, p) for p in named] for w in words]
    assert m.log_likelihood(words) == pytest.approx(np.array(want), rel=1e-9)
    monkeypatch.setattr(langid, "LONG_PLACES", 50)  # long words in many parts
    assert m.log_likelihood(words) == pytest.approx(np.array(want), rel=1e-9)


def test_expected_uses_of_long_words_weigh_their_bytes():
    m, _ = model()
    for word in (b" " + b"abc" * 4, b" " + b"abc" * 400):
        use = langid._expected([word], np.array([2.0]), m.keys, m.probability[:, 0], m.long)
        sizes = [len(int(k).to_bytes(8, "big").lstrip(b"\0")) for k in m.keys] + [len(x) for x in m.long]
        assert use[len(m.keys):].sum() > 0
        assert (use * sizes).sum() == pytest.approx(2 * len(word))  # every segmentation covers the word


def test_training_uses_long_pieces():
    keys, long = langid.load_pieces(P.path(catalog.BYTE_RANKS))
    assert len(keys) + len(long) == 50_255  # all but the byte 0
    m = langid.fit([("en", "government", 50), ("de", "regierung", 50)], keys, 3, long)
    assert b" government" in m.long
    row = m.probability[len(m.keys) + m.long.index(b" government")]
    # all 50 uses are the whole word's; each of the 255 bytes counts half a use besides
    assert row[m.languages.index("en")] == pytest.approx(50 / (50 + 255 * langid.BYTE_COUNT), rel=0.01)


def test_a_long_word_is_one_word():
    """Segmentations with a piece across byte 24 count too."""
    p = {b" ": 0.2, b"a": 0.1, b"b": 0.1, b"c": 0.1, b"cab": 0.3, b"bca": 0.2}
    keys = np.array(sorted(map(langid._key, p)), np.uint64)
    by_key = {langid._key(x): v for x, v in p.items()}
    m = langid.Model(["x"], keys, np.array([[by_key[int(k)]] for k in keys] + [[0.0]]))
    got = langid._Scorer(m).of(["abc" * 20], np.array([1]))[0]
    assert got == pytest.approx([all_segmentations(b" " + b"abc" * 20, p), 1.0])
