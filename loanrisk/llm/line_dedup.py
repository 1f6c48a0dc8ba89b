"""Line dedup over range-partitioned hashes (operator 12).

A text is split at ``\\n``. A line's key is the line without the characters
``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in lower case. A key of at least
``min_chars`` code points that at least ``min_docs`` documents hold loses all its
lines but those of the last document (largest ``doc_id``) that holds it.

1. *Hashes.* One pass over the texts writes a narrow table: for each line with a
   long enough key its 128-bit BLAKE2b hash, document and position, and a row with
   the number of lines for each document. Equal hashes stand for equal keys.
2. *Order.* These rows are dealt by ranges of (hash, document descending) and sorted
   by (hash, document descending, position). Rows of a hot line lie in many ranges;
   those of one line in one document never part.
3. *Stream.* A pass over each range meets a key's documents from the last on: lines
   of its first document stay, others go as soon as ``min_docs`` documents were met.
   Until then the lines of at most ``min_docs - 1`` documents are held.
   Keys at a range's ends may go on in another: a summary row tells their documents
   there (number, first), two a range; rows that a range can't decide alone are put
   out as open, and decided by the sums of the summaries.
4. *Bitmaps.* The dropped positions of a document become a bitmap with a bit for
   each line (1: stays), compressed by zlib. It is what ``keep_bitmaps`` returns;
   ``dedup_lines`` also joins it to the texts, by document, and cuts the lines out.

Defined results: null and empty texts are one empty line; rows with equal or null ids
are documents of their own, in the order of their places in the files (null ids
first); repeated rows too; an empty table gives no rows; a document that loses all
lines has an empty text left; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.llm.common import SPACES, ids_are_unique, text_or_empty, written
from loanrisk.llm.exact_dedup import located
from loanrisk.llm.sharding import places

MIN_CHARS, MIN_DOCS = 40, 5
HASH_BYTES = 16

_SPACES = SPACES.encode()
_CONTINUATION = bytes(range(0x80, 0xC0))

LINES = "hash binary, doc long, position long"
#: Of a row of the streaming pass.
DROPPED, OPEN, SUMMARY = 0, 1, 2
VERDICTS = "kind int, hash binary, doc long, position long"
NAMES = ["kind", "hash", "doc", "position"]


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACES).lower()  # of bytes: A-Z alone


def key_hash(key: bytes) -> bytes:
    return blake2b(key, digest_size=HASH_BYTES).digest()


def _is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, _CONTINUATION)) >= min_chars)


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, doc_id, text``: ``doc`` is unique and orders documents as the id does.
    It is the id, or where ids are null or repeat, the place in (id, file, row)."""
    if ids_are_unique(df, id_col):
        return df.select(F.col(id_col).cast("long").alias("doc"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = located(df).select(F.col(id_col).cast("long").alias("id"), F.col(id_col).alias("doc_id"),
                              text_or_empty(text_col).alias("text"), "_at")
    order = [F.col("id"), F.col("_at.file"), F.col("_at.row")]
    return written(places(rows, order, [], "line-order").select(F.col("_place").alias("doc"), "doc_id", "text"), "line-docs")


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line with a long enough key; and one without a hash for each
    document, whose ``position`` is its number of lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, doc, position = [], [], []
            for name, body in zip(batch["doc"].to_pylist(), batch["body"]):
                lines = body.as_py().split(b"\n")
                for k, line in enumerate(lines):
                    key = line_key(line)
                    if _is_long(key, min_chars):
                        hashes.append(key_hash(key))
                        position.append(k)
                hashes.append(None)
                position.append(len(lines))
                doc += [name] * (len(hashes) - len(doc))
                if len(doc) > 100_000:
                    yield _rows(hashes, doc, position)
                    hashes, doc, position = [], [], []
            yield _rows(hashes, doc, position)

    def _rows(hashes, doc, position):
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(doc, pa.int64()), pa.array(position, pa.int64())],
                                          ["hash", "doc", "position"])

    return docs.select("doc", F.col("text").cast("binary").alias("body")).mapInArrow(run, LINES)


class KeyStream:
    """Verdicts over rows sorted by (hash, document descending). Holds the lines of
    at most ``min_docs - 1`` documents of the key that it is in."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key = None  # of the last row
        self.in_first_key = True
        self.n_docs, self.first_doc, self.last_doc = 0, None, None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # undecided lines of that key

    def take(self, hashes: np.ndarray, doc: np.ndarray, position: np.ndarray) -> Iterator[pa.RecordBatch]:
        changed = np.ones(len(doc), bool)
        changed[0] = self.key is not None and hashes[0].tobytes() != self.key
        changed[1:] = (hashes[1:] != hashes[:-1]).any(1)
        run = np.cumsum(changed)  # 0: the key before goes on, or the first begins
        new_doc = changed.copy()
        new_doc[0] |= self.key is None or doc[0] != self.last_doc
        new_doc[1:] |= doc[1:] != doc[:-1]
        n_docs = np.bincount(run, new_doc, run[-1] + 1).astype(np.int64)
        n_docs[0] += self.n_docs
        first_doc = np.concatenate([[doc[0] if self.key is None else self.first_doc], doc[changed]])
        enough = n_docs >= self.min_docs
        open_ = np.zeros(len(n_docs), bool)
        if self.in_first_key:  # decided by the summaries
            open_[0] = True
            if run[-1]:
                yield self._summary(self.key or hashes[0].tobytes(), n_docs[0], first_doc[0])
        elif enough[0]:
            yield from self._decided()
        if run[-1]:
            self.held = []
        rows = np.flatnonzero(open_[run])
        if len(rows):
            yield _verdicts(OPEN, doc[rows], position[rows], hashes[0].tobytes())
        others = doc != first_doc[run]
        rows = np.flatnonzero(others & enough[run] & ~open_[run])
        yield _verdicts(DROPPED, doc[rows], position[rows])
        if not enough[-1] and not open_[-1]:
            rows = np.flatnonzero(others & (run == run[-1]))
            self.held.append((doc[rows], position[rows]))
        self.in_first_key &= not run[-1]
        self.key, self.last_doc = hashes[-1].tobytes(), doc[-1]
        self.n_docs, self.first_doc = int(n_docs[-1]), first_doc[-1]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield self._summary(self.key, self.n_docs, self.first_doc)
            for doc, position in self.held:
                yield _verdicts(OPEN, doc, position, self.key)

    def _decided(self) -> Iterator[pa.RecordBatch]:
        for doc, position in self.held:
            yield _verdicts(DROPPED, doc, position)
        self.held = []

    @staticmethod
    def _summary(key: bytes, n_docs: int, first_doc: int) -> pa.RecordBatch:
        return _verdicts(SUMMARY, np.array([first_doc]), np.array([n_docs]), key)


def _verdicts(kind: int, doc: np.ndarray, position: np.ndarray, key: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array([key] * len(doc), pa.binary()),
                                       pa.array(doc, pa.int64()), pa.array(position, pa.int64())], NAMES)


def _streamed(rows: DataFrame, min_docs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = KeyStream(min_docs)
        for batch in batches:
            if batch.num_rows:
                hashes = np.frombuffer(b"".join(batch["hash"].to_pylist()), np.uint64).reshape(-1, HASH_BYTES // 8)
                yield from stream.take(hashes, batch["doc"].to_numpy(), batch["position"].to_numpy())
        yield from stream.end()

    return rows.mapInArrow(run, VERDICTS)


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, position`` of the lines to drop, from ``hash, doc, position``."""
    ranges = ["hash", F.desc("doc")]
    order = [*ranges, "position"]
    found = written(_streamed(lines.repartitionByRange(*ranges).sortWithinPartitions(*order), min_docs), "line-verdicts")
    # of two summaries a range
    keys = (found.filter(F.col("kind") == SUMMARY).groupBy("hash").agg(F.sum("position").alias("n_docs"), F.max("doc").alias("first_doc"))
            .filter(F.col("n_docs") >= min_docs))
    late = (found.filter(F.col("kind") == OPEN).join(F.broadcast(keys), "hash").filter("doc <> first_doc"))
    return found.filter(F.col("kind") == DROPPED).select("doc", "position").unionByName(late.select("doc", "position"))


def pack_bits(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


BITMAPS = "doc long, n_lines long, n_dropped long, bitmap binary"


def _bitmaps(sizes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_dropped, bitmap = [], []
            for n, dropped in zip(batch["n_lines"].to_pylist(), batch["dropped"]):
                at = np.zeros(0, np.int64) if dropped.values is None else dropped.values.to_numpy()
                n_dropped.append(len(at))
                bitmap.append(pack_bits(n, at))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["n_lines"], pa.array(n_dropped, pa.int64()), pa.array(bitmap, pa.binary())],
                                             ["doc", "n_lines", "n_dropped", "bitmap"])

    return sizes.mapInArrow(run, BITMAPS)


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """A row per document: ``doc`` (as ``numbered`` gives it), ``n_lines``,
    ``n_dropped`` and ``bitmap``, zlib-compressed, the first line in the highest bit."""
    return _bitmaps_of(numbered(df, id_col, text_col), min_chars, min_docs)


def _bitmaps_of(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    rows = written(_line_rows(docs, min_chars), "line-hashes")
    dropped = dropped_lines(rows.filter("hash IS NOT NULL"), min_docs)
    by_doc = dropped.groupBy("doc").agg(F.collect_list("position").alias("dropped"))
    sizes = rows.filter("hash IS NULL").select("doc", F.col("position").alias("n_lines"))
    return _bitmaps(sizes.join(by_doc, "doc", "left").select("doc", "n_lines", "dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """A row per document: ``doc_id, n_lines, n_dropped, bitmap`` and ``kept``, the
    lines that stay, joined by ``\\n``."""
    docs = numbered(df, id_col, text_col)
    joined = docs.join(_bitmaps_of(docs, min_chars, min_docs), "doc").select("doc_id", "n_lines", "n_dropped", "bitmap", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for n, n_dropped, bitmap, text in zip(*(batch[c].to_pylist() for c in ("n_lines", "n_dropped", "bitmap", "text"))):
                kept.append("\n".join(compress(text.split("\n"), unpack_bits(bitmap, n))) if n_dropped else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kept, pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", "bitmap", "kept"])

    types = dict(joined.dtypes)
    return joined.mapInArrow(run, f"doc_id {types['doc_id']}, n_lines long, n_dropped long, bitmap binary, kept string")
