"""Order-preserving packing by dynamic programming (operator 9).

The documents of a partition, in table order and each closed by the end id, form
one stream of tokens. Windows are consecutive stretches of the stream, at most
``window`` tokens long. A window costs its padding (none when its length is a
power of two, else ``window - length``) plus a penalty for where it ends: nothing
at a document's end, ``sentence_penalty`` after a sentence, ``hard_penalty``
elsewhere, and ``window_cost`` for being a sequence. With ``pos`` the place of a
candidate cut,

    f(j) = penalty(j) + min over i of f(i) + cost(pos_j - pos_i)

The padding is linear in the length, so the best predecessor in the sliding range
``pos_j - window .. pos_j`` is the head of a monotone queue over ``f(i) + pos_i``;
the powers of two add one lookup each. Candidates are document ends, sentence
ends, and, in stretches without either, a point every ``grid`` tokens, so any text
can be cut. The programme runs over blocks of about ``block_tokens`` tokens that
end with a document: memory is bounded by a block or one document.

No shuffle: a partition is packed where it is read. The input should be a table
(same order at each reading), so a repeated task gives the same sequences.

Defined results: null text is empty (the end id alone), equal or null ids are
separate documents, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.llm.common import text_or_empty
from loanrisk.llm.wordwise import encoder

WINDOW = 1024
#: Shortest length below ``WINDOW`` at which a sequence may stay unpadded.
LEAST_POWER = 64
SENTENCE_PENALTY = 4.0
HARD_PENALTY = 24.0
WINDOW_COST = 8.0
GRID = 16
BLOCK_TOKENS = 1 << 20

PIECE_SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
                "sequence_length long, ids binary")

_SENTENCE_ENDS: dict[str, np.ndarray] = {}


def sentence_ends(path: str) -> np.ndarray:
    """By id: whether the token closes a sentence or a line."""
    if path not in _SENTENCE_ENDS:
        t = encoder(path).tokenizer
        texts = t.decode_batch([[i] for i in range(t.get_vocab_size())], skip_special_tokens=False)
        _SENTENCE_ENDS[path] = np.array([x.endswith((".", "!", "?", "\n")) for x in texts])
    return _SENTENCE_ENDS[path]


def candidates(doc_ends: np.ndarray, soft: np.ndarray, grid: int, sentence: float, hard: float):
    """Cut positions (0 first, the stream's end last) and their penalties."""
    kind = np.zeros(int(doc_ends[-1]) + 1, np.int8)  # by position: 0 no cut, 1 hard, 2 sentence, 3 document
    kind[soft] = 2
    kind[doc_ends] = kind[0] = 3
    ends = np.flatnonzero(kind)
    gaps = np.diff(ends)
    wide = np.flatnonzero(gaps > grid)
    more = (gaps[wide] - 1) // grid
    kind[np.repeat(ends[wide], more) + grid * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0.0, hard, sentence, 0.0])[kind[at]]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, least_power: int = LEAST_POWER,
              window_cost: float = WINDOW_COST) -> np.ndarray:
    """Indices into ``at`` of the cheapest cuts, first and last included."""
    powers = []
    p = least_power
    while p < window:
        k = np.searchsorted(at, at - p)
        k[k == len(at)] = 0
        powers.append(np.where((at >= p) & (at[k] == at - p), k, -1).tolist())
        p *= 2
    pos, pen = at.tolist(), penalty.tolist()
    n = len(pos)
    cost, back = [0.0] * n, [0] * n
    queue, keys = deque([0]), [0.0] * n  # keys: f(i) + pos_i, smallest at the head
    for j in range(1, n):
        least = pos[j] - window
        while pos[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        best = keys[i] - least
        for table in powers:
            k = table[j]
            if k >= 0 and cost[k] < best:
                best, i = cost[k], k
        best += pen[j] + window_cost
        cost[j], back[j] = best, i
        key = keys[j] = best + pos[j]
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return np.array(cuts[::-1])


def pack(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, least_power: int = LEAST_POWER, sentence_penalty: float = SENTENCE_PENALTY,
         hard_penalty: float = HARD_PENALTY, window_cost: float = WINDOW_COST, grid: int = GRID,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece (a stretch of one document in one sequence) with its ids
    as little-endian u32 bytes. ``sequence_id`` is the partition's number times
    2**36 plus the sequence's number in it."""

    def block(names, ids, ends, first_sequence):
        starts = np.concatenate([[0], ends[:-1]])
        soft = np.flatnonzero(sentence_ends(tokenizer)[ids]) + 1
        at, penalty = candidates(ends, soft, min(grid, window), sentence_penalty, hard_penalty)
        cuts = at[best_cuts(at, penalty, window, least_power, window_cost)]
        begin = np.union1d(starts, cuts[:-1])
        stop = np.append(begin[1:], ends[-1])
        doc = np.searchsorted(starts, begin, "right") - 1
        sequence = np.searchsorted(cuts, begin, "right") - 1
        bounds = pa.py_buffer(np.append(begin, ends[-1]).astype(np.int64) * 4)
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, bounds, pa.py_buffer(ids.astype("<u4"))])
        columns = [begin - starts[doc], stop - begin, (ends - starts)[doc], first_sequence + sequence, begin - cuts[sequence],
                   np.diff(cuts)[sequence]]
        out = pa.RecordBatch.from_arrays(
            [names.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in columns), body.cast(pa.binary())],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"])
        return out, len(cuts) - 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal sequence, held, size
            names = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            out, n = block(names, np.concatenate([h[1] for h in held]), np.cumsum(sizes), sequence)
            sequence, held, size = sequence + n, [], 0
            return out

        for batch in batches:
            for first, ids, cuts in encoder(tokenizer).encode(batch.column(1), end_id):
                k, n = 0, len(cuts) - 1
                while k < n:
                    stop = max(k + 1, min(n, int(np.searchsorted(cuts, cuts[k] + block_tokens - size))))
                    held.append((batch.column(0).slice(first + k, stop - k), ids[cuts[k]:cuts[stop]], np.diff(cuts[k:stop + 1])))
                    size += int(cuts[stop] - cuts[k])
                    k = stop
                    if size >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(pieces, PIECE_SCHEMA)
