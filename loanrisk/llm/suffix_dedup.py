"""Suffix-array dedup by bucket-pointer refinement (operator 3).

Texts are UTF-8 bytes. A byte is removed if it is covered by a string of
``length`` bytes that also starts earlier (in a smaller ``doc_id``, or in the same
document at an earlier place), judged on the input. So for every start (a *window*) it must
be known whether an equal window starts earlier.

1. *Initial buckets.* Equal windows hold the same q-grams, so each window is
   represented by its smallest q-gram under a fixed hash (leftmost among equals),
   its *anchor*; anchors stand about every 35 bytes, and the windows of an anchor
   are a run of starts. A row per run is dealt by the anchor's q-gram bucket: the
   hash of the q-gram, a hash of the run's whole context, document and starts.
2. *Equal contexts.* In a bucket sorted by (context, document, start), every row
   but the first of an equal context repeats earlier text as a whole. Repeats within
   a batch are found before the shuffle, so a group of copies ships one row a batch.
   Rows are dealt by ranges of (bucket, context), so a bucket with a row of every
   third document lies in many ranges. A bucket with one context is done; where
   contexts differ, matches begin or end inside, and the first row of each goes on.
3. *Refinement.* These contexts' bytes are fetched, and their positions' q-gram
   buckets (32 bytes) are refined by sorting on the pair of bucket identifiers at a
   position and at a later offset: (i, i + 32) gives 64 bytes, and these updated
   identifiers, reused at (i, i + length - 64), give the whole window. Only exact
   bytes decide: the initial buckets are compared byte by byte. The first window of a final
   bucket stays, the others repeat it.
   A q-gram bucket with more than ``max_bucket`` contexts is not sorted in one
   task: its windows are grouped by their bytes with a partial ``min`` instead.
4. *Removal.* The repeated windows of a document are united to spans and cut out.

Contexts are equal when their 128-bit BLAKE2b hashes are: a cryptographic hash, so that
no document can be made to lose text that it does not share.

Defined results: null text is empty; texts shorter than ``length`` lose nothing;
rows with equal or null ids are ordered by their place in the files (null first) and
stay separate rows; matches never cross documents; long texts are
read in overlapping stretches, so memory is bounded by a stretch; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.llm.common import text_or_empty, written
from loanrisk.llm.exact_dedup import located
from loanrisk.llm.sharding import places

LENGTH = 100
Q = 32
STRETCH = 1 << 20  # two of them fit the place bits below
MAX_BUCKET = 4096
#: Contexts refined together in a task.
REFINE_ROWS = 8192

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE_BITS = np.uint64(22)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view("<u8").ravel()


def _gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on."""
    h = _mix(words)
    for k, m in ((8, _A), (16, _B), (24, _A)):
        h[:-k] = _mix(h[:-k] + (words[k:] ^ np.uint64(k)) * m)
    return h


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b of ``data[begin:end]`` for each pair, as two numbers."""
    body = memoryview(np.ascontiguousarray(data))
    out = b"".join([blake2b(body[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
    return np.frombuffer(out, np.uint64).reshape(-1, 2)


def runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """Runs of windows with one anchor in texts ``data[bounds[t]:bounds[t + 1]]``:
    ``(text, first, last, bucket, context)``, places from each text's start."""
    n, width = len(data), length - Q + 1
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(np.arange(n) + length <= bounds[1:][text_of])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    grams = _gram_hash(_words(data))
    key = (grams & ~((np.uint64(1) << _PLACE_BITS) - np.uint64(1))) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= width:  # least key of ``span`` positions
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
    anchor = (key[starts] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
    anchor = anchor[cut]
    context = digests(data, first, last + length)
    text = text_of[first]
    return text, first - bounds[text], last - bounds[text], grams[anchor], context


def _stretches(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts, or pieces of long ones that overlap by ``length - 1`` bytes:
    ``(data, bounds, row, start)``."""
    pieces, rows, begin, held = [], [], [], 0
    for row, text in enumerate(texts):
        body = np.frombuffer(text.as_buffer() or b"", np.uint8)
        if len(body) < length:
            continue
        for at in range(0, len(body) - length + 1, STRETCH):
            pieces.append(body[at:at + STRETCH + length - 1])
            rows.append(row)
            begin.append(at)
            held += len(pieces[-1])
            if held >= STRETCH:
                yield np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]), np.array(rows), np.array(begin)
                pieces, rows, begin, held = [], [], [], 0
    if pieces:
        yield np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]), np.array(rows), np.array(begin)


RUN_NAMES = ["bucket", "context", "context_2", "doc", "first", "last", "repeated"]
RUN_SCHEMA = "bucket long, context long, context_2 long, doc long, first long, last long, repeated boolean"


def _run_batches(bucket, context, doc, first, last, repeated: bool) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(doc), 50_000):
        s = slice(k, k + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[s].view(np.int64)), *(pa.array(np.ascontiguousarray(context[s, k]).view(np.int64)) for k in (0, 1)),
             pa.array(doc[s]), pa.array(first[s]), pa.array(last[s]), pa.array(np.full(len(doc[s]), repeated))], RUN_NAMES)


def _run_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            parts = []
            for data, bounds, rows, begin in _stretches(batch.column(1).cast(pa.large_binary()), length):
                text, first, last, bucket, context = runs(data, bounds, length)
                parts.append((bucket, context, names[rows[text]], first + begin[text], last + begin[text]))
            if not parts:
                continue
            bucket, context, doc, first, last = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((first, doc, context[:, 1], context[:, 0], bucket))
            bucket, context, doc, first, last = (x[order] for x in (bucket, context, doc, first, last))
            repeated = np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (context[1:] == context[:-1]).all(1)])
            yield from _run_batches(bucket[~repeated], context[~repeated], doc[~repeated], first[~repeated], last[~repeated], False)
            # stretches of repeated runs become one row, dealt by document
            doc, first, last = doc[repeated], first[repeated], last[repeated]
            order = np.lexsort((first, doc))
            doc, first, last = doc[order], first[order], last[order]
            head = np.ones(len(doc), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
            begin = np.flatnonzero(head)
            doc, first, last = doc[begin], first[begin], last[np.append(begin[1:], len(head))[:len(begin)] - 1]
            yield from _run_batches(_mix(doc.astype(np.uint64)), np.zeros((len(doc), 2), np.uint64), doc, first, last, True)

    return docs.mapInArrow(run, RUN_SCHEMA)


#: Of a row of the comparing pass: repeats an earlier one as a whole; the first row of
#: its context, in a bucket with several; the same in a bucket at the end of a range,
#: which may have contexts in another; marks such a bucket that has several in this one.
REPEATED, OPEN, BORDER, SEVERAL = 0, 1, 2, 3
COMPARED_NAMES = [*RUN_NAMES[:6], "kind"]
COMPARED_SCHEMA = RUN_SCHEMA.replace("repeated boolean", "kind int")


def _compare_contexts(rows: DataFrame) -> DataFrame:
    """From rows in ranges of (repeated, bucket, context), sorted by that and (doc,
    first): the rows that repeat an earlier one, and the first row of each context in
    buckets that may have several. A pass over sorted rows: holds a batch and one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (None, None)  # bucket and context of the last row
        first_bucket = None  # of the range
        waiting = None  # the only context so far of a bucket behind it
        for batch in batches:
            known = batch["repeated"].to_numpy(zero_copy_only=False)
            if known.any():
                yield _of_kind(batch.filter(batch["repeated"]), REPEATED)
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            bucket, context = batch["bucket"].to_numpy(), np.stack([batch["context"].to_numpy(), batch["context_2"].to_numpy()], 1)
            if first_bucket is None:
                first_bucket = bucket[0]
            border = bucket == first_bucket
            new_bucket = np.concatenate([[bucket[0] != before[0]], bucket[1:] != bucket[:-1]])
            new = new_bucket | np.concatenate([[before[1] is None or (context[0] != before[1]).any()], (context[1:] != context[:-1]).any(1)])
            heads = np.flatnonzero(new)
            go = np.zeros(len(bucket), bool)
            if len(heads):
                second = ~new_bucket[heads]  # not the first context of its bucket
                also = np.append(bucket[heads[1:]] == bucket[heads[:-1]], False)
                go[heads] = second | also | border[heads]
                if waiting is not None and second[0]:
                    yield _of_kind(waiting, OPEN)
                waiting = None if go[heads[-1]] else batch.slice(heads[-1], 1)
            before = (bucket[-1], context[-1])
            yield _of_kind(batch, np.where(~new, REPEATED, np.where(border, BORDER, OPEN)).astype(np.int32)).filter(pa.array(~new | go))
            last_row = batch.slice(batch.num_rows - 1, 1)
        if waiting is not None:
            yield _of_kind(waiting, BORDER)
        elif first_bucket is not None and before[0] != first_bucket:
            yield _of_kind(last_row, SEVERAL)

    return rows.mapInArrow(run, COMPARED_SCHEMA)


def _of_kind(batch: pa.RecordBatch, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.broadcast_to(np.int32(kind), batch.num_rows))], COMPARED_NAMES)


def open_heads(compared: DataFrame) -> DataFrame:
    """The first rows of contexts in buckets with several; of those at the ends of ranges,
    the ones whose bucket has another head or several contexts elsewhere."""
    ends = compared.filter(F.col("kind") >= BORDER)
    spread = ends.groupBy("bucket").count().filter("count > 1").select("bucket")
    columns = ["bucket", "doc", "first", "last"]
    return (compared.filter(F.col("kind") == OPEN).select(*columns)
            # at most two buckets a range
            .unionByName(ends.filter(F.col("kind") == BORDER).join(F.broadcast(spread), "bucket", "left_semi").select(*columns)))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of the pairs: equal where both parts are."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]


def _gram_buckets(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of the 32 bytes at positions ``at``: sorted by hash, then
    compared byte by byte with the first of the bucket."""
    _, first, ids = np.unique(_gram_hash(words)[at], return_index=True, return_inverse=True)
    if all((words[at + k] == words[at[first[ids]] + k]).all() for k in (0, 8, 16, 24)):
        return ids
    for k in (0, 8, 16, 24):  # a hash collision: sort on the bytes themselves
        part = np.unique(words[at + k], return_inverse=True)[1]
        ids = part if k == 0 else _pairs(ids, part)
    return ids


def refine(contexts: list[np.ndarray], doc: np.ndarray, first: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of the contexts repeat an earlier one of them: a flag for each
    window of the first context, then of the second, and so on."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.cumsum(size) - size
    data = np.concatenate(contexts)
    windows = size - length + 1
    which = np.repeat(np.arange(len(size)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[which] + inside
    # initial buckets wherever a refinement will look them up
    offsets = (0, 32, length - 64, length - 32)
    needed = np.zeros(len(data) + 1, bool)
    for k in offsets:
        needed[at + k] = True
    places_ = np.flatnonzero(needed)
    ids = np.zeros(len(data) + 1, np.int64)
    ids[places_] = _gram_buckets(_words(data), places_)
    # 64 bytes at each window and at its later offset
    needed[:] = False
    needed[at] = needed[at + length - 64] = True
    places_ = np.flatnonzero(needed)
    longer = np.zeros(len(data) + 1, np.int64)
    longer[places_] = _pairs(ids[places_], ids[places_ + 32])
    whole = _pairs(longer[at], longer[at + length - 64])
    order = np.lexsort((first[which] + inside, doc[which], whole))
    repeated = np.zeros(len(at), bool)
    repeated[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    return repeated


CONTEXT_SCHEMA = "bucket long, doc long, first long, context binary"


def _fetch(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts, cut out of their documents."""
    asked = rows.groupBy("doc").agg(F.collect_list(F.struct("bucket", "first", "last")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, body, asked = batch["doc"][row].as_py(), batch["body"][row].as_py(), batch["asked"][row].values
                bucket, first, last = (asked.field(k) for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [bucket, pa.array(np.full(len(asked), doc)), first,
                     pa.array([body[a:b + length] for a, b in zip(first.to_pylist(), last.to_pylist())], pa.binary())],
                    ["bucket", "doc", "first", "context"])

    return (docs.join(asked, "doc").select("doc", F.col("text").cast("binary").alias("body"), "asked")
            .mapInArrow(cut, CONTEXT_SCHEMA))


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows as ``doc, first, last``, from contexts clustered by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(batch):
            body = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch["context"]]
            doc, first = batch["doc"].to_numpy(), batch["first"].to_numpy()
            flags = refine(body, doc, first, length)
            windows = np.fromiter(map(len, body), np.int64, len(body)) - length + 1
            which = np.repeat(np.arange(len(body)), windows)
            inside = np.arange(len(flags)) - np.repeat(np.cumsum(windows) - windows, windows)
            on = np.flatnonzero(flags)
            head = np.ones(len(on), bool)  # none, if no window of these buckets repeats
            head[1:] = (np.diff(on) != 1) | (which[on[1:]] != which[on[:-1]])
            cut = np.flatnonzero(head)
            begin, end = on[cut], on[np.append(cut[1:], len(on))[:len(cut)] - 1]
            return pa.RecordBatch.from_arrays([pa.array(doc[which[begin]]), pa.array(first[which[begin]] + inside[begin]),
                                               pa.array(first[which[begin]] + inside[end])], ["doc", "first", "last"])

        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows >= REFINE_ROWS:  # whole buckets only
                bucket = held["bucket"].to_numpy()
                ends = np.flatnonzero(bucket != bucket[-1])
                if len(ends):
                    yield spans(held.slice(0, int(ends[-1]) + 1))
                    held = held.slice(int(ends[-1]) + 1)
        if held is not None and held.num_rows:
            yield spans(held)

    return contexts.mapInArrow(run, "doc long, first long, last long")


def _by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for contexts of large buckets, grouped by the windows' bytes."""
    places_ = F.sequence(F.lit(0).cast("long"), F.octet_length("context").cast("long") - length)
    windows = (contexts.select("doc", "first", "context", F.explode(places_).alias("k"))
               .select("doc", (F.col("first") + F.col("k")).alias("at"),
                       F.expr(f"substring(context, CAST(k AS INT) + 1, {length})").alias("window")))
    earliest = windows.groupBy("window").agg(F.min(F.struct("doc", "at")).alias("e"), F.count("*").alias("n")).filter("n > 1")
    return (windows.join(earliest, "window").filter(F.struct("doc", "at") != F.col("e"))
            .select("doc", F.col("at").alias("first"), F.col("at").alias("last")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   max_bucket: int = MAX_BUCKET) -> DataFrame:
    """A row per document: ``doc_id, n_bytes, spans`` (array of start and end of the
    removed runs, in bytes) and ``kept`` (the remaining bytes)."""
    if length < 64:
        raise ValueError("length must be at least 64")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(id_col).cast("long").alias("doc_id"),
                     text_or_empty(text_col).alias("text"))
    if df.groupBy(F.col(id_col)).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count():
        # the place in the order (id, place in the files) stands for the id
        placed = located(df).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), "_at")
        docs = written(places(placed, [F.col("doc_id"), F.col("_at.file"), F.col("_at.row")], [], "suffix-order")
                       .select(F.col("_place").alias("doc"), "doc_id", "text"), "suffix-docs")
    rows = _run_rows(docs.select("doc", "text"), length)
    ranges = ["repeated", "bucket", "context", "context_2"]
    compared = written(_compare_contexts(rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges, "doc", "first")), "suffix-compared")
    open_rows = written(open_heads(compared), "suffix-open")
    contexts = _fetch(docs, open_rows, length)
    large = written(open_rows.groupBy("bucket").count().filter(F.col("count") > max_bucket).select("bucket"), "suffix-large")
    parts = [compared.filter(F.col("kind") == REPEATED).select("doc", "first", "last")]
    if large.limit(1).count():
        contexts = written(contexts, "suffix-contexts")
        parts.append(written(_by_windows(contexts.join(large, "bucket", "left_semi"), length), "suffix-large-refined"))
        contexts = contexts.join(large, "bucket", "left_anti")
    parts.append(written(_refined(contexts.repartition("bucket").sortWithinPartitions("bucket"), length), "suffix-refined"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _cut(docs, found, length)


def _cut(docs: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """Documents without the bytes that the windows ``first .. last`` cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for row in range(batch.num_rows):
                body = batch["body"][row].as_py()
                sizes.append(len(body))
                mine = batch["found"][row].values
                if mine is None or not len(mine):
                    spans.append([])
                    kept.append(body)
                    continue
                begin, end = mine.field(0).to_numpy(), mine.field(1).to_numpy() + length
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                head = np.concatenate([[True], begin[1:] > end[:-1]])
                begin, end = begin[head], end[np.append(np.flatnonzero(head)[1:], len(head)) - 1]
                spans.append([{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
                kept.append(b"".join(body[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(body)])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(spans, spans_type),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    found = windows.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return (docs.join(found, "doc", "left").select("doc_id", F.col("text").cast("binary").alias("body"), "found")
            .mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"))
