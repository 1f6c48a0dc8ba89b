"""SimHash near-dedup by pigeonhole blocks (operator 10).

Fingerprint: the text with A-Z in lower case is cut into words
``[^\\x20\\x09-\\x0D]+``; every run of ``shingle`` words, repeats included, joined
by spaces (the whole sequence when there are fewer) is hashed with XXH64 (seed
42); a bit of the fingerprint is 1 if set in over half the hashes. No words: zero,
which links like any other fingerprint.

Links: two fingerprints at ``distance`` or fewer differing bits. The 64 bits are
split into ``blocks`` blocks; of ``blocks`` blocks at most ``distance`` can differ,
so a close pair shares all bits of at least one choice of ``blocks - distance``
blocks. Every distinct fingerprint is filed once per choice under those shared
bits, and only fingerprints filed together are compared. More blocks mean longer
keys and fewer chance meetings; the number is taken from the count of distinct
fingerprints so that a key has about one of them by chance, and any number is exact.

Inside a file the components of its close pairs are found by visiting: from a
fingerprint all unvisited ones within the distance, and so on, so a dense file of
n costs far less than its n * n / 2 pairs, and a spanning forest of at most n - 1
links leaves it. Files above ``max_file`` are not compared in one task: each
member there is filed again under all its variants with up to ``distance / 2``
bits flipped outside the key; two members are within the (even) distance if and
only if they share a variant, and the members of a variant are linked to its
smallest. Every link is followed, whatever the sizes.

Defined results: null text has no words; equal texts collapse to one fingerprint
before any join; a null id takes part but never names a component unless the
component has only null ids (then null); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanrisk.llm.common import text_or_empty, written
from loanrisk.llm.components import connected_components
from loanrisk.llm.exact_dedup import located

SHINGLE, DISTANCE, SEED = 4, 4, 42
MAX_FILE = 20_000

_LOWER_AND_SPACES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned 64-bit number."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = [w for w in text.translate(_LOWER_AND_SPACES).split(b" ") if w]
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    n = max(1, len(words) - shingle + 1)
    stops = ends[-n:].tolist()
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        rows = hashes[k:k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, at, fp``: id, place in the files, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["doc_id", "at", "fp"])

    rows = located(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col("_at").alias("at"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, at struct<file: string, row: long>, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask of shared bits for each choice of ``blocks - distance`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(parts, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """Blocks for ``n`` distinct fingerprints: keys at least as long as log2(n)."""
    blocks = distance + 2
    while blocks < 2 * distance and 64 * (blocks - distance) // blocks < math.log2(max(n, 2)):
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the close pairs among distinct fingerprints (indices)."""
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= distance
            if near.any():
                found = rest[near]
                links += [(x, y) for y in found]
                queue += found.tolist()
                rest = rest[~near]
    return links


def _links_in_files(files: DataFrame, distance: int) -> DataFrame:
    """Links from files, rows ``mask_id, key, fp`` clustered and sorted by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None

        def links(masks, keys, fps):
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(masks) != 0)) + 1, [len(fps)]])
            sizes = np.diff(cuts)
            a, b = [], []
            two = cuts[:-1][sizes == 2]  # most files: no loop for them
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance
            a.append(fps[two][near])
            b.append(fps[two + 1][near])
            for k in np.flatnonzero(sizes > 2):
                part = fps[cuts[k]:cuts[k + 1]]
                if found := _forest(part, distance):
                    i, j = np.array(found).T
                    a.append(part[i])
                    b.append(part[j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if tail is not None:
                now = [np.concatenate(x) for x in zip(tail, now)]
            masks, keys, fps = now
            last = np.flatnonzero((keys != keys[-1]) | (masks != masks[-1])) if len(keys) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(masks[:cut], keys[:cut], fps[:cut])
            tail = [x[cut:] for x in now]
        if tail is not None and len(tail[0]) > 1:
            yield links(*tail)

    return files.mapInArrow(run, "a long, b long")


def _links_by_variants(files: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links from large files: members that share a variant.

    Two members at most ``distance`` apart (an even number) differ in bits outside
    the key and meet half way, at a variant with up to ``distance / 2`` of them
    flipped; members that meet are at most ``distance`` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(2).to_numpy().view(np.uint64)
            of_mask = batch.column(0).to_numpy()
            for m in np.unique(of_mask):
                bits = [1 << k for k in range(64) if not masks[m] >> k & 1]
                own = fps[of_mask == m]
                for r in range(distance // 2 + 1):
                    for flips in combinations(bits, r):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), m)), pa.array((own ^ np.uint64(sum(flips))).view(np.int64)),
                             pa.array(own.view(np.int64))], ["mask_id", "variant", "fp"])

    variants = files.mapInArrow(run, "mask_id long, variant long, fp long")
    stars = variants.groupBy("mask_id", "variant").agg(F.min("fp").alias("hub"))
    return (variants.join(stars, ["mask_id", "variant"]).filter("fp <> hub")
            .select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct())


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, blocks: int | None = None,
                      max_file: int = MAX_FILE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``fp long``) whose components
    are those of all pairs at ``distance`` or fewer bits."""
    if distance % 2:
        raise ValueError("distance must be even")
    masks = block_masks(blocks or blocks_for(fps.count(), distance), distance)
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("mask_id"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    filed = fps.select(F.explode(keys).alias("k"), "fp").select("k.mask_id", "k.key", "fp")
    large = written(filed.groupBy("mask_id", "key").count().filter(F.col("count") > max_file)
                    .select("mask_id", "key"), "simhash-large-files")
    small = filed
    any_large = large.limit(1).count() > 0
    if any_large:
        small = filed.join(large, ["mask_id", "key"], "left_anti")
    ordered = small.repartition("mask_id", "key").sortWithinPartitions("mask_id", "key")
    links = _links_in_files(ordered, distance)
    if any_large:
        links = links.unionByName(_links_by_variants(filed.join(large, ["mask_id", "key"]), masks, distance))
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, blocks: int | None = None, max_file: int = MAX_FILE) -> DataFrame:
    """A row per input row: ``doc_id, fingerprint`` (16 lowercase hex digits),
    ``component_id`` (smallest id reachable over links, its own included), ``kept``
    (one row of each component: that id's, the last in the files) and ``at`` (the
    row's place in the files)."""
    docs = written(fingerprints(df, id_col, text_col, shingle), "simhash-fingerprints")
    first = F.max(F.struct(F.bitwise_not("doc_id").alias("turned_id"), "at"))  # smallest id, nulls last
    fps = written(docs.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    labels = connected_components(fingerprint_links(fps.select("fp"), distance, blocks, max_file))
    linked = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    stays = linked.groupBy("label").agg(F.max("first").alias("stays"))
    named = linked.join(stays, "label").select("fp", "stays")
    return docs.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.bitwise_not("stays.turned_id").alias("component_id"),
        (F.col("at") == F.col("stays.at")).alias("kept"), "at")


def drop_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns; options as above."""
    rows = located(df)
    kept = near_duplicates(rows, **options).filter("kept").select(F.col("at").alias("_kept_at"))
    return rows.join(kept, rows["_at"] == kept["_kept_at"], "left_semi").drop("_at")
