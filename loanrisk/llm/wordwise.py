"""Tokenize whole texts through the distinct pieces of a batch.

Subword tokenizers cut a text into words before any merge, so a text may be cut at
places where every such rule cuts too, and the ids of the pieces, one after
another, are the ids of the text. A batch of documents holds each piece many times;
only the distinct ones go through the tokenizers library (those seen repeatedly
once for many batches), and numpy spreads their ids out again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Repeated pieces kept from batch to batch in a Python worker (about 200 bytes each).
CACHE_PIECES = 300_000
#: Pieces given to the library at once, and documents spread out at once.
ENCODE_PIECES, SPREAD_DOCS = 50_000, 1000
#: Bytes searched for cuts at once.
SCAN_BYTES = 1 << 22

_ENCODERS: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """The worker's encoder for a tokenizer file; its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the texts may be cut; every text start is one.

    A cut is before a single space or newline between two characters that are
    printable ASCII or in U+00C0..U+00FF (two bytes, the first 0xC3), none of
    which is white space or a combining mark; or before a comma or full stop that
    follows a letter of these ranges.
    """
    flags = np.zeros(len(data) + 1, bool)
    for k in range(0, len(data), SCAN_BYTES):
        part = data[k:k + SCAN_BYTES]
        at = np.flatnonzero((part == 0x20) | (part == 0x0A) | (part == 0x2C) | (part == 0x2E)) + k
        at = at[(at > 1) & (at < len(data) - 1)]
        here, before, earlier, after = data[at], data[at - 1], data[at - 2], data[at + 1]
        latin = (before >= 0x80) & (earlier == 0xC3)
        space = (here <= 0x20) & (((before > 0x20) & (before < 0x7F)) | latin)
        space &= ((after > 0x20) & (after < 0x7F)) | (after == 0xC3)
        lower = before | 0x20
        letter = ((lower >= 0x61) & (lower <= 0x7A) & (before < 0x80)) | (latin & (before != 0x97) & (before != 0xB7))
        flags[at[space | ((here > 0x20) & letter)]] = True
    flags[offsets] = True
    return np.flatnonzero(flags)


def distinct_pieces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts, one after another, as a dictionary array, and for
    each text (and the end) the number of pieces before it. Null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    starts = piece_starts(data, offsets)
    pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data))
    return pieces.dictionary_encode(), np.searchsorted(starts, offsets)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.index: dict[str, int] = {}  # cached piece -> its number
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k in range(0, len(pieces), ENCODE_PIECES):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k:k + ENCODE_PIECES], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), np.int32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(flat)

    def _look_up(self, pieces: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(begin, size, ids)`` of each piece; the unseen ones are encoded, and
        those among them that the batch repeats are cached."""
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        sizes, flat = self._ids_of([pieces[i] for i in new])
        at[new] = len(self.index) + np.arange(len(new))
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        ids = np.concatenate([self.ids, flat])
        begin, size = starts[at], starts[at + 1] - starts[at]
        keep = new[counts[new] > 1][:CACHE_PIECES - len(self.index)]
        self.index.update(zip((pieces[i] for i in keep), range(len(self.index), len(self.index) + len(keep))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size[keep])])
        self.ids = np.concatenate([self.ids, _spread(begin[keep], size[keep], ids)])
        return begin, size, ids

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Stretches of the texts, ``(first, ids, cuts)``: text ``first + k`` has
        ``ids[cuts[k]:cuts[k + 1]]``; a null text counts as empty, and ``end_id``
        closes every text."""
        n = len(texts)
        if not n:
            return
        pieces, of_doc = distinct_pieces(texts)
        which = pieces.indices.to_numpy()
        begin, size, ids = self._look_up(pieces.dictionary.to_pylist(), np.bincount(which, minlength=len(pieces.dictionary)))
        for first in range(0, n, SPREAD_DOCS):
            mine = of_doc[first:first + SPREAD_DOCS + 1]
            own = which[mine[0]:mine[-1]]
            out = _spread(begin[own], size[own], ids)
            cuts = np.concatenate([[0], np.cumsum(size[own])])[mine - mine[0]]
            if end_id is not None:
                out = np.insert(out, cuts[1:], end_id)
                cuts = cuts + np.arange(len(cuts))
            yield first, out, cuts


def _spread(begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The stretches ``ids[begin:begin + size]``, one after another."""
    ends = np.cumsum(size)
    return ids[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])] if len(ends) else ids[:0]
