"""Language ID by segmentation-marginalised unigrams (operator 5).

Vocabulary: the pieces of a fixed public byte-level vocabulary (all bytes but 0
are among them); those of more than ``PIECE_BYTES`` bytes are found by their first
bytes and then compared whole. Per language every piece has
a probability; a word's likelihood is the sum, over all its segmentations into
pieces, of the products of their probabilities (forward algorithm),

    a[0] = 1,  a[i] = sum over n of a[i - n] * P(word[i - n:i])

and a text's log-likelihood is the sum over its words. Words are runs of letters
in lower case with a space before them, as UTF-8, never cut; for one of more than
``WORD_BYTES`` bytes the sums slide over it, scaled, with as many places in memory
as the longest piece has bytes. The language with the largest
likelihood is predicted; the score is its share of the likelihoods of all
languages, each tempered by the number of words so that scores stay comparable
between short and long texts (geometric mean per word, to ``SHARPNESS``).

Training: expectation maximisation over the words of a bounded sample, about
``sample_docs`` documents of each language, taken by a hash of the id; expected
counts come from the forward and backward sums. The words of a sample are counted
in Spark, the fit runs over the distinct ones on the driver.

Prediction reads every whole text: a batch's distinct pieces of text are scored
once by numpy (those repeated stay cached in the worker) and summed by document.

Defined results: null text or one without letters is ``und`` with score 0; so is
any text if no labelled row exists; ties go to the first language in name order;
equal or null ids are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanrisk.llm.common import text_or_empty, written
from loanrisk.llm.wordwise import SPREAD_DOCS, distinct_pieces

#: Bytes of a piece that fit a key; bytes from which on a word's sums are scaled.
PIECE_BYTES, WORD_BYTES = 8, 24
#: Places of long words, over all of a group, that are looked up at once.
LONG_PLACES = 1 << 16
SAMPLE_DOCS = 300
ROUNDS = 3
#: Expected count that each single byte has besides the sample's.
BYTE_COUNT = 0.5
SHARPNESS = 4.0
UNKNOWN = "und"
CACHE_PIECES, SCORE_PIECES = 150_000, 50_000


def load_pieces(path: str) -> tuple[np.ndarray, list[bytes]]:
    """Sorted keys of the vocabulary's pieces of up to ``PIECE_BYTES`` bytes, and the
    longer pieces by length."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines}
    pieces |= {bytes([b]) for b in range(256)}
    pieces = {p for p in pieces if p and 0 not in p}
    keys = np.array(sorted(_key(p) for p in pieces if len(p) <= PIECE_BYTES), np.uint64)
    return keys, sorted((p for p in pieces if len(p) > PIECE_BYTES), key=lambda p: (len(p), p))


def _key(piece: bytes) -> int:
    return int.from_bytes(piece, "big")


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = max(1, int(size.max()))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), size


def _lookup(matrix: np.ndarray, keys: np.ndarray, long: Sequence[bytes] = ()) -> dict[int, np.ndarray]:
    """By n: for each word and place, the number of the piece of n bytes that begins
    there (``long``, by length, is numbered after ``keys``), or the number of all
    pieces where there is none."""
    none, width = len(keys) + len(long), matrix.shape[1]
    out, key = {}, np.zeros(matrix.shape, np.uint64)
    for n in range(1, min(PIECE_BYTES, width) + 1):
        key = (key[:, :width - n + 1] << np.uint64(8)) | matrix[:, n - 1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out[n] = np.where((keys[at] == key) & (matrix[:, n - 1:] > 0), at, none)
    first = len(keys)
    for n, same in groupby(long, len):
        if n > width:
            break
        names = np.array(list(same), f"S{n}")
        heads = np.unique(np.array([_key(x[:PIECE_BYTES]) for x in names.tolist()], np.uint64))
        begins = key[:, :width - n + 1]
        hit = heads[np.minimum(np.searchsorted(heads, begins), len(heads) - 1)] == begins
        out[n] = np.full(begins.shape, none)
        if hit.any():
            found = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(matrix, n, axis=1)[hit]).view(f"S{n}")[:, 0]
            at = np.minimum(np.searchsorted(names, found), len(names) - 1)
            out[n][hit] = np.where(names[at] == found, first + at, none)
        first += len(names)
    return out


def forward(pieces: dict[int, np.ndarray], size: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """a[word, place, language]; ``probability`` has a row per piece and a last row of zeros."""
    width = pieces[1].shape[1]
    a = np.zeros((len(size), width + 1, probability.shape[1]))
    a[:, 0] = 1.0
    for i in range(1, width + 1):
        for n, piece in pieces.items():
            if n <= i:
                a[:, i] += a[:, i - n] * probability[piece[:, i - n]]
    return a


def long_likelihood(words: list[bytes], keys: np.ndarray, long: Sequence[bytes], probability: np.ndarray) -> np.ndarray:
    """Log-likelihoods [word, language] of words of any length: the sums of the next
    places slide along, and are scaled before they vanish."""
    reach = max(PIECE_BYTES, len(long[-1]) if len(long) else 0)
    matrix, size = _matrix([w + b"\0" * reach for w in words])
    size = size - reach
    # a[n]: the sum at the place n bytes ahead
    a = np.zeros((reach + 1, len(words), probability.shape[1]))
    a[0] = 1.0
    scale, out = np.zeros(a.shape[1:]), np.zeros(a.shape[1:])
    step = max(1, LONG_PLACES // len(words))
    for begin in range(0, int(size.max()), step):
        part = np.ascontiguousarray(matrix[:, begin:begin + step + reach - 1])
        pieces = _lookup(part, keys, long)
        lengths = np.array(list(pieces))
        places = min(step, int(size.max()) - begin)
        numbers = np.stack([x[:, :places] for x in pieces.values()])
        for i in range(places):
            a[lengths] += a[0] * probability[numbers[:, :, i]]
            a = np.concatenate([a[1:], np.zeros_like(a[:1])])
            most = a.max(axis=0)
            small = (most > 0) & (most < 1e-100)
            if small.any():
                by = np.where(small, most, 1.0)
                a, scale = a / by, scale + np.log(by)
            done = np.flatnonzero(size == begin + i + 1)
            if len(done):
                with np.errstate(divide="ignore"):
                    out[done] = np.log(a[0, done]) + scale[done]
    return out


def _by_length(words: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of the words in groups of one length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        for k in range(0, len(part), 20_000):
            yield part[k:k + 20_000]


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # pieces with a probability above 0 in some language, sorted
    probability: np.ndarray  # a row per piece, a column per language; a last row of zeros
    long: Sequence[bytes] = ()  # such pieces of more than PIECE_BYTES bytes, by length; their rows follow those of keys

    def log_likelihood(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        if not self.languages:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(size <= WORD_BYTES)
        for part in _by_length([words[i] for i in short]):
            part = short[part]
            matrix, n = _matrix([words[i] for i in part])
            a = forward(_lookup(matrix, self.keys, self.long), n, self.probability)
            out[part] = np.log(a[np.arange(len(part)), n])
        rest = np.flatnonzero(size > WORD_BYTES)
        rest = rest[np.argsort(size[rest], kind="stable")]
        # groups of similar length: a word more than twice as long as the first begins another
        while len(rest):
            n = min(int(np.searchsorted(size[rest], 2 * size[rest[0]], "right")), max(1, LONG_PLACES // int(size[rest[0]])))
            out[rest[:n]] = long_likelihood([words[i] for i in rest[:n]], self.keys, self.long, self.probability)
            rest = rest[n:]
        return out


def whole_words(text: str) -> list[bytes]:
    """The words of a text as scored: letters, lower case, a space before."""
    import regex

    return [b" " + word.encode() for word in regex.findall(r"\p{L}+", text.lower())]


def split_words(text: str) -> list[bytes]:
    """The words in stretches of at most ``WORD_BYTES`` bytes."""
    return [body[k:k + WORD_BYTES] for body in whole_words(text) for k in range(0, len(body), WORD_BYTES)]


def _expected(words: list[bytes], counts: np.ndarray, keys: np.ndarray, probability: np.ndarray,
              long: Sequence[bytes] = ()) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words; sums as
    logarithms, so that those of long words do not vanish."""
    total = np.zeros(len(probability))
    with np.errstate(divide="ignore"):
        p = np.log(probability)
    for part in _by_length(words):
        matrix, _ = _matrix([words[i] for i in part])
        pieces = _lookup(matrix, keys, long)
        width = matrix.shape[1]  # words of one length in a part
        a, b = np.full((2, len(part), width + 1), -np.inf)
        a[:, 0] = b[:, width] = 0.0
        for i in range(1, width + 1):
            a[:, i] = np.logaddexp.reduce([a[:, i - n] + p[piece[:, i - n]] for n, piece in pieces.items() if n <= i])
        for i in range(width - 1, -1, -1):
            b[:, i] = np.logaddexp.reduce([b[:, i + n] + p[piece[:, i]] for n, piece in pieces.items() if i + n <= width])
        rest = (np.log(counts[part]) - a[:, width])[:, None]
        for n, piece in pieces.items():
            use = np.exp(a[:, :width - n + 1] + p[piece] + b[:, n:] + rest)
            total += np.bincount(piece.ravel(), use.ravel(), len(total))
    return total[:-1]


def fit(counts: list[tuple[str, str, int]], keys: np.ndarray, rounds: int = ROUNDS, long: Sequence[bytes] = ()) -> Model:
    """Model from rows (language, lower-case word of letters, times)."""
    languages = sorted({c[0] for c in counts})
    single = np.searchsorted(keys, np.arange(1, 256, dtype=np.uint64))
    columns = []
    for language in languages:
        words, times = [], []
        for _, word, n in (c for c in counts if c[0] == language):
            for w in whole_words(word):
                words.append(w)
                times.append(n)
        n_pieces = len(keys) + len(long)
        p = np.append(np.full(n_pieces, 1.0 / n_pieces), 0.0)
        for _ in range(rounds if words else 0):
            use = _expected(words, np.array(times, float), keys, p, long)
            use[use < 0.1] = 0.0
            use[single] += BYTE_COUNT
            p = np.append(use / use.sum(), 0.0)
        columns.append(p)
    table = np.array(columns).T if columns else np.zeros((len(keys) + len(long) + 1, 0))
    used = np.append(table[:-1].any(axis=1), True)
    return Model(languages, keys[used[:len(keys)]], np.ascontiguousarray(table[used]),
                 [x for x, u in zip(long, used[len(keys):-1], strict=True) if u])


def train(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit on about ``sample_docs`` rows of each language of ``df`` (those with text)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    # stored, so its size is known and Spark need not deal the texts by language
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # by id and text: rows with one id or none are drawn apart
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(sizes, "lang").filter(draw < sample_docs / F.col("n"))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("lang", "word").count().collect()  # the sample's distinct words
    keys, long = load_pieces(vocabulary)
    return fit([(r["lang"], r["word"], r["count"]) for r in counts], keys, rounds, long)


class _Scorer:
    """Log-likelihoods and word counts of pieces of text, cached when repeated."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.rows = np.zeros((0, len(model.languages) + 1))

    def _fresh(self, pieces: list[str]) -> np.ndarray:
        words, owner = [], []
        for k, piece in enumerate(pieces):
            mine = whole_words(piece)
            words += mine
            owner += [k] * len(mine)
        out = np.zeros((len(pieces), self.rows.shape[1]))
        if words:
            owner = np.array(owner)
            scores = self.model.log_likelihood(words)
            for k in range(scores.shape[1]):
                out[:, k] = np.bincount(owner, scores[:, k], len(pieces))
            out[:, -1] = np.bincount(owner, minlength=len(pieces))
        return out

    def of(self, pieces: list[str], counts: np.ndarray) -> np.ndarray:
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        fresh = [self._fresh([pieces[i] for i in new[k:k + SCORE_PIECES]]) for k in range(0, len(new), SCORE_PIECES)]
        rows = np.concatenate([self.rows, *fresh])
        at[new] = len(self.rows) + np.arange(len(new))
        keep = np.flatnonzero(counts[new] > 1)[:CACHE_PIECES - len(self.index)]
        self.index.update(zip((pieces[i] for i in new[keep]), range(len(self.rows), len(self.rows) + len(keep))))
        self.rows = np.concatenate([self.rows, rows[len(self.rows) + keep]])
        return rows[at]


def predict(df: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of every row, with ``lang_pred`` and ``score``; these
    names in use raise ``ValueError``."""
    if taken := {"lang_pred", "score"} & set(carry):
        raise ValueError(f"columns in use: {sorted(taken)}")
    languages, n_carried = np.array([*model.languages, UNKNOWN]), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            n = batch.num_rows
            pieces, of_doc = distinct_pieces(batch.column(text_at))
            which = pieces.indices.to_numpy()
            rows = scorer.of(pieces.dictionary.to_pylist(), np.bincount(which, minlength=len(pieces.dictionary)))
            sums = np.zeros((n, rows.shape[1]))
            for first in range(0, n, SPREAD_DOCS):
                mine = of_doc[first:first + SPREAD_DOCS + 1]
                own, doc = rows[which[mine[0]:mine[-1]]], np.repeat(np.arange(len(mine) - 1), np.diff(mine))
                for k in range(rows.shape[1]):
                    sums[first:first + len(mine) - 1, k] = np.bincount(doc, own[:, k], len(mine) - 1)
            total, words = sums[:, :-1], sums[:, -1]
            known = (words > 0) & (total.shape[1] > 0)
            best, score = np.full(n, len(model.languages)), np.zeros(n)
            if total.shape[1]:
                per_word = SHARPNESS * total / np.maximum(words, 1)[:, None]
                share = np.exp(per_word - per_word.max(axis=1, keepdims=True))
                best = np.where(known, total.argmax(axis=1), best)
                score = np.where(known, 1.0 / share.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carried], pa.array(languages[best].tolist(), pa.string()), pa.array(score)],
                                             [*carry, "lang_pred", "score"])

    carried = text_col in carry and df.schema[text_col].dataType == T.StringType()
    text_at = list(carry).index(text_col) if carried else n_carried
    rows = df.select(*carry, *([] if carried else [text_or_empty(text_col).alias("_text")]))
    schema = T.StructType([df.schema[c] for c in carry]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
