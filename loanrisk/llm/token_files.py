"""Token-ID files with fixed-width bit packing (operator 4).

Each id takes the minimum number of bits for the vocabulary. A file is a Parquet
table of *segments*, one row each: whole documents in ascending ``doc_id`` order
with their ids in one payload

    ``BPK1`` | bits u8 | block_ids u32 | n_ids u64 | block offsets u64[] | packed ids

(little endian). Ids are packed in blocks of ``block_ids``; every block begins on
a byte, and its offset in the table makes a range of ids readable by touching
only its blocks, with numpy and no loop over ids.

Documents are dealt by ranges of ``doc_id`` and sorted inside each range, so the
order over (part, segment) is the global order. Only a total per part goes to the
driver. Spark's committer writes the table, so lost or repeated tasks leave
nothing behind.

Defined results: null text is empty (its document has the end id alone), rows
with equal or null ``doc_id`` stay apart (nulls first, then by text hash), an
empty table gives an empty table, columns other than id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanrisk.llm.common import text_or_empty
from loanrisk.llm.wordwise import encoder

MAGIC = b"BPK1"
HEAD = struct.Struct("<4sBIQ")
#: Ids in a block: a multiple of 8, so blocks of any width end on a byte.
BLOCK_IDS = 4096
#: A segment is closed when it holds so many ids; a longer document has its own.
SEGMENT_IDS = 1 << 20

SEGMENT_SCHEMA = ("part long, segment long, first_in_part long, n_ids long, "
                  "doc_ids array<long>, doc_sizes array<long>, payload binary")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def _pack_bits(ids: np.ndarray, bits: int) -> bytes:
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little").tobytes()


def pack(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The payload of ``ids``; an id that does not fit raises."""
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id does not fit {bits} bits")
    if block_ids % 8:
        raise ValueError("block_ids must be a multiple of 8")
    body = (ids.astype(f"<u{bits // 8}").tobytes() if bits in (8, 16, 32)
            else b"".join(_pack_bits(ids[k:k + (1 << 18) // block_ids * block_ids or block_ids], bits)
                          for k in range(0, len(ids), (1 << 18) // block_ids * block_ids or block_ids)))
    n_blocks = -(-len(ids) // block_ids)
    offsets = np.arange(n_blocks + 1, dtype="<u8") * (block_ids * bits // 8)
    offsets[-1] = len(body)
    return HEAD.pack(MAGIC, bits, block_ids, len(ids)) + offsets.tobytes() + body


def unpack(payload: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from position ``start`` on, as u32; reads only their blocks."""
    magic, bits, block_ids, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a packed payload")
    stop = n if count is None else min(n, start + count)
    if not 0 <= start <= n:
        raise IndexError(start)
    if stop <= start:
        return np.zeros(0, "<u4")
    n_blocks = -(-n // block_ids)
    offsets = np.frombuffer(payload, "<u8", n_blocks + 1, HEAD.size)
    body = HEAD.size + offsets.nbytes
    first, last = start // block_ids, -(-stop // block_ids)
    data = np.frombuffer(payload, np.uint8, int(offsets[last] - offsets[first]), body + int(offsets[first]))
    skip = start - first * block_ids
    if bits in (8, 16, 32):
        ids = data.view(f"<u{bits // 8}")
        return ids[skip:skip + stop - start].astype("<u4")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = (skip + np.arange(stop - start, dtype=np.int64)) * bits
    words = np.zeros(len(at), np.uint64)
    for k in range((bits + 14) // 8):  # the bytes that a value may touch
        words |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def write_token_files(df: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS,
                      segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text and write the segment table to ``path``."""
    bits = bits_for(vocabulary)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        names, sizes, ids = [], [], []

        def close():
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "segment": pa.array([number], pa.int64()),
                "first_in_part": pa.array([first], pa.int64()), "n_ids": pa.array([len(flat)], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "doc_sizes": pa.array([sizes], pa.list_(pa.int64())),
                "payload": pa.array([pack(flat, bits, block_ids)], pa.binary())}), len(flat)

        held = 0
        for batch in batches:
            for at, flat, cuts in encoder(tokenizer).encode(batch.column(1), end_id):
                for k, name in enumerate(batch.column(0).slice(at, len(cuts) - 1).to_pylist()):
                    names.append(name)
                    sizes.append(int(cuts[k + 1] - cuts[k]))
                    ids.append(flat[cuts[k]:cuts[k + 1]])
                    held += sizes[-1]
                    if held >= segment_ids:
                        out, n = close()
                        yield out
                        number, first, held = number + 1, first + n, 0
                        names, sizes, ids = [], [], []
        if names:
            yield close()[0]

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
         .mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the table: ``doc_id, start, n_tokens, ids`` (the ids as
    little-endian u32 bytes; ``start`` counts the ids of all documents before)."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per part
    base, bases = 0, []
    for t in totals:
        bases.append((t["part"], base))
        base += t["n"]
    bases = spark.createDataFrame(bases, "part long, base long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, sizes = batch["doc_ids"][row].values, batch["doc_sizes"][row].values.to_numpy()
                ends = np.cumsum(sizes)
                ids = unpack(batch["payload"][row].as_buffer()).astype("<u4")
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
                    None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64)), pa.py_buffer(ids)])
                for k in range(0, len(sizes), 2000):
                    s = slice(k, k + 2000)
                    yield pa.RecordBatch.from_arrays([
                        names[s], pa.array((batch["first"][row].as_py() + ends - sizes)[s], pa.int64()),
                        pa.array(sizes[s], pa.int64()), body[s].cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return (segments.join(F.broadcast(bases), "part")
            .select((F.col("base") + F.col("first_in_part")).alias("first"), "doc_ids", "doc_sizes", "payload")
            .mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary"))
