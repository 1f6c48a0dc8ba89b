"""Fill-in-middle transformation by displacement scatter (operator 11).

A text of ``n`` code points is cut twice, at ``h1 % (n + 1)`` and ``h2 % (n + 1)``;
``h1`` to ``h4`` are the first four 8-digit groups of the hex SHA-256 of
``<seed>:<id>``. ``h3`` and ``h4`` choose the form: ``plain`` (the text as it is),
``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part
behind its marker. A text that holds a marker itself stays plain, so that markers
in an output are the operator's own.

A batch of texts is one run of bytes:

1. *Scan.* Code points begin where a byte is no continuation; a running count of
   them over the bytes gives each text's ``n`` and the byte of each cut.
2. *Displacements.* All bytes of a part move by the same distance. A difference
   array holds the change of that distance where a part begins, and its cumulative
   sum is every byte's shift.
3. *Scatter.* Bytes are written to their place plus shift, markers between them.
4. *Restoring.* Markers are searched in the output. The parts' places in the text
   follow from their lengths, and the same sums give for each byte of the text the
   place in the output that it is gathered from.

Sums and index arrays are made for ``STRETCH`` bytes at a time, with the sum so far
carried on, so beside the texts and outputs of a group of rows (``GROUP`` bytes, or
one longer text) memory is constant. Nothing is shuffled.

Defined results: null text is empty, and an empty text is plain; a null id hashes
as an empty one; rows with equal ids are separate rows, cut alike where their texts
are equal; an empty table gives no rows; columns other than those asked for by
``carry`` are ignored, and carrying a name that the operator adds raises
``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanrisk.llm.common import text_or_empty

#: Marks of prefix, suffix and middle.
MARKERS = (b"<P>", b"<S>", b"<M>")
SEED, CHANGED_PERCENT, SPM_PERCENT = 1, 90, 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
GROUP, STRETCH = 4 << 20, 1 << 20

ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def hash_groups(id_col: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of an id, as numbers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def check_markers(markers: tuple[bytes, ...]) -> None:
    """Marks must be told apart wherever they stand: they share their first byte,
    which is nowhere else in them, and none begins another."""
    first = {m[:1] for m in markers}
    if len(markers) != 3 or len(first) != 1 or any(not m or m.count(m[:1]) != 1 for m in markers) or any(
            a is not b and b.startswith(a) for a in markers for b in markers):
        raise ValueError("three markers with one first byte, which is nowhere else in them")


def _groups(sizes: np.ndarray) -> Iterator[slice]:
    """Stretches of rows of about ``GROUP`` bytes."""
    begin = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > GROUP:
            yield slice(begin, k)
            begin, held = k, 0
        held += int(size)
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as one run, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)),
                                            pa.py_buffer(data)).cast(pa.string())


def _stretches(n: int) -> Iterator[tuple[int, int]]:
    for low in range(0, n, STRETCH):
        yield low, min(low + STRETCH, n)


def code_points(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Code points before each bound: a running count of the bytes that begin one."""
    before, counted = np.zeros(len(bounds), np.int64), 0
    for low, high in _stretches(len(data)):
        count = np.cumsum((data[low:high] & 0xC0) != 0x80)
        mine = slice(*np.searchsorted(bounds, [low + 1, high + 1]))
        before[mine] = counted + count[bounds[mine] - low - 1]
        counted += int(count[-1])
    return before


def bytes_of(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The byte at which the code point of each rank (over the whole run) begins;
    the end for a rank behind the last."""
    at, counted = np.full(rank.shape, len(data), np.int64), 0
    for low, high in _stretches(len(data)):
        begins = np.flatnonzero((data[low:high] & 0xC0) != 0x80)
        mine = (rank >= counted) & (rank < counted + len(begins))
        at[mine] = low + begins[rank[mine] - counted]
        counted += len(begins)
    return at


def occurrences(data: np.ndarray, bounds: np.ndarray, marker: bytes) -> np.ndarray:
    """Where ``marker`` begins inside one of the texts."""
    found = []
    for low, high in _stretches(len(data)):
        at = low + np.flatnonzero(data[low:high] == marker[0])
        at = at[at + len(marker) <= len(data)]
        for k, byte in enumerate(marker):
            at = at[data[at + k] == byte]
        found.append(at)
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    end = bounds[np.searchsorted(bounds, at, "right")] if len(at) else at
    return at[at + len(marker) <= end]


def shifts(n: int, begin: np.ndarray, move: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(low, high, shift of each byte)`` over ``n`` bytes, where the part that
    begins at ``begin[k]`` (ascending) moves by ``move[k]``: the cumulative sum of a
    difference array. Of parts at one place the last holds (those before are empty)."""
    change = np.diff(move, prepend=0)
    carried = 0
    for low, high in _stretches(n):
        difference = np.zeros(high - low, np.int64)
        mine = slice(*np.searchsorted(begin, [low, high]))
        np.add.at(difference, begin[mine] - low, change[mine])
        shift = np.cumsum(difference) + carried
        carried = int(shift[-1])
        yield low, high, shift


def _layout(form: np.ndarray, begin: np.ndarray, parts: np.ndarray, out_begin: np.ndarray, markers: tuple[bytes, ...]):
    """Where the parts (prefix, middle, suffix; their sizes in rows of ``parts``)
    begin in the texts and in the outputs: two arrays of a row a text."""
    p, m, s = parts.T
    mp, ms, mm = (len(x) for x in markers)
    source = np.stack([begin, begin + p, begin + p + m], 1)
    spm = form == SPM
    prefix = out_begin + mp + np.where(spm, ms + s, 0)
    suffix = out_begin + ms + np.where(spm, 0, mp + p)
    middle = out_begin + mp + p + ms + s + mm
    place = np.stack([prefix, middle, suffix], 1)
    plain = form == PLAIN
    place[plain] = (source - begin[:, None] + out_begin[:, None])[plain]
    return source, place


def transform_bytes(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, markers: tuple[bytes, ...] = MARKERS,
                    changed_percent: int = CHANGED_PERCENT, spm_percent: int = SPM_PERCENT):
    """``(n, form, prefix_chars, middle_chars, output, output bounds)`` of the texts
    ``data[bounds[t]:bounds[t + 1]]`` with the hashes ``h[t]``."""
    before = code_points(data, bounds)
    n = np.diff(before)
    holds = np.zeros(len(n), bool)
    for marker in markers:
        holds[np.searchsorted(bounds, occurrences(data, bounds, marker), "right") - 1] = True
    form = np.where((n == 0) | holds | (h[:, 2] % 100 >= changed_percent), PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], 1)
    inside = bytes_of(data, before[:-1][:, None] + cuts)  # a cut at the end is where the next text begins
    edge = np.concatenate([bounds[:-1, None], inside, bounds[1:, None]], 1)
    parts = np.diff(edge, axis=1)
    out_size = np.diff(bounds) + np.where(form == PLAIN, 0, sum(map(len, markers)))
    out_bounds = np.concatenate([[0], np.cumsum(out_size)])
    source, place = _layout(form, bounds[:-1], parts, out_bounds[:-1], markers)
    out = np.empty(out_bounds[-1], np.uint8)
    for low, high, shift in shifts(len(data), source.ravel(), (place - source).ravel()):
        out[np.arange(low, high) + shift] = data[low:high]
    changed = form != PLAIN
    for marker, part in zip(markers, (0, 2, 1)):  # marks of prefix, suffix, middle
        for k, byte in enumerate(marker):
            out[place[changed, part] - len(marker) + k] = byte
    return n, form, cuts[:, 0], cuts[:, 1] - cuts[:, 0], out, out_bounds


def restore_bytes(out: np.ndarray, out_bounds: np.ndarray, form: np.ndarray, markers: tuple[bytes, ...] = MARKERS):
    """``(text, bounds)`` from outputs and their forms alone."""
    changed = np.flatnonzero(form != PLAIN)
    size = np.diff(out_bounds)
    size[changed] -= sum(map(len, markers))
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.zeros((3, len(form)), np.int64)  # where the marks stand
    for row, marker in zip(at, markers):
        found = occurrences(out, out_bounds, marker)
        text = np.searchsorted(out_bounds, found, "right") - 1
        row[text] = found
        if (np.bincount(text, minlength=len(form))[changed] != 1).any():
            raise ValueError("an output holds not just one of each marker")
    p_at, s_at, m_at = at
    mp, ms, mm = (len(x) for x in markers)
    begin, end, spm = out_bounds[:-1], out_bounds[1:], form == SPM
    p = np.where(spm, m_at, s_at) - p_at - mp
    s = np.where(spm, p_at, m_at) - s_at - ms
    m = end - m_at - mm
    parts = np.stack([p, m, s], 1)
    parts[form == PLAIN] = 0
    parts[form == PLAIN, 0] = size[form == PLAIN]
    source, place = _layout(form, bounds[:-1], parts, begin, markers)
    text = np.empty(bounds[-1], np.uint8)
    for low, high, shift in shifts(len(text), source.ravel(), (place - source).ravel()):
        text[low:high] = out[np.arange(low, high) + shift]
    return text, bounds


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None,
              seed: int = SEED, changed_percent: int = CHANGED_PERCENT, spm_percent: int = SPM_PERCENT,
              markers: tuple[bytes, ...] = MARKERS) -> DataFrame:
    """A row per document: the columns ``carry`` (the id, if not given), ``n`` (code
    points), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain), ``output``."""
    check_markers(markers)
    carry = (id_col,) if carry is None else carry
    schema = df.select(*carry).schema
    added = [c.split()[0] for c in ADDED.split(", ")]
    if taken := set(added) & set(carry):
        raise ValueError(f"columns in use: {sorted(taken)}")
    k = len(carry)
    rows = df.select(*carry, *[h.alias(f"h{i}") for i, h in enumerate(hash_groups(id_col, seed))], text_or_empty(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _row_groups(batch, k + 4):
                data, bounds = _bytes(part.column(k + 4))
                h = np.stack([part.column(k + i).to_numpy() for i in range(4)], 1)
                n, form, prefix, middle, out, out_bounds = transform_bytes(data, bounds, h, markers, changed_percent, spm_percent)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:k], pa.array(n), pa.array(FORMS).take(pa.array(form)), pa.array(prefix, mask=plain),
                     pa.array(middle, mask=plain), _strings(out, out_bounds)], [*carry, *added])

    return rows.mapInArrow(run, _schema(schema, ADDED))


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", markers: tuple[bytes, ...] = MARKERS,
            restored_col: str = "restored") -> DataFrame:
    """``df`` with the text that each output was made from, by output and form alone."""
    check_markers(markers)
    names = df.columns
    if restored_col in names:
        raise ValueError(f"column in use: {restored_col}")
    at, form_at = names.index(output_col), names.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _row_groups(batch, at):
                data, bounds = _bytes(part.column(at))
                form = np.array([FORMS.index(x) for x in part.column(form_at).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(*restore_bytes(data, bounds, form, markers))],
                                                 [*names, restored_col])

    return df.mapInArrow(run, _schema(df.schema, f"{restored_col} string"))


def _schema(schema: StructType, more: str) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(more).fields)


def _row_groups(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        sizes = pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False)
        for rows in _groups(sizes):
            yield batch.slice(rows.start, rows.stop - rows.start)
