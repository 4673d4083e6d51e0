"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import partitions, settle
from decretum.llm.components import connected_components

BITS = 64
#: Blocks beyond the bits that may differ: a key has so many blocks, and 26 bits at most are free in a bucket.
KEPT_BLOCKS = 3
#: Fingerprints of a bucket that are compared by pivot distances; larger buckets go by shared midpoints.
BUCKET = 4096


def fingerprint(text: str, size: int) -> int:
    """Bits set in more than half the XXH64 digests of the text's shingles of ``size`` words (fewer words: all of them; none: 0)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    last = ends[min(size, len(words)) - 1 :].tolist()
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 4096], last[at : at + 4096], strict=True)], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * votes > n).view(">u8")[0])


def references(count: int, seed: int = 42) -> np.ndarray:
    """Reference fingerprints (pivots): fixed random numbers."""
    return np.random.default_rng(seed).integers(0, 2**64, count, np.uint64, endpoint=False)


def block_masks(max_bits: int) -> list[int]:
    """Masks of all choices of ``KEPT_BLOCKS`` out of ``max_bits`` more blocks: a close pair agrees on one of them at least."""
    count = max_bits + KEPT_BLOCKS
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(kept) for kept in combinations(blocks, KEPT_BLOCKS)]


def close_pairs(prints: np.ndarray, pivots: np.ndarray, max_bits: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs that differ in ``max_bits`` or fewer bits.

    The table holds each fingerprint's Hamming distances to the pivots. By the triangle inequality
    a close pair's distances to any pivot differ by ``max_bits`` at most: pairs are
    read off the table sorted by the first pivot, those with a larger difference at any other
    pivot are discarded, and the survivors are verified bit by bit.
    """
    table = np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + max_bits, "right")
    reach = ends - np.arange(len(prints)) - 1
    at = 0
    while at < len(prints):
        to = max(at + 1, int(np.searchsorted(np.cumsum(reach[at:]), at_once)) + at)
        left = np.repeat(np.arange(at, to), reach[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(reach[at:to]) - reach[at:to], reach[at:to])
        for p in range(1, len(pivots)):
            stays = np.abs(table[left, p] - table[right, p]) <= max_bits
            left, right = left[stays], right[stays]
        close = np.bitwise_count(prints[left] ^ prints[right]) <= max_bits
        yield order[left[close]], order[right[close]]
        at = to


def spanning_links(prints: np.ndarray, pivots: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that hold each group of close fingerprints together: one per fingerprint at most."""
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for left, right in close_pairs(prints, pivots, max_bits):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            parent[root(i)] = root(j)
    signed = prints.view(np.int64).tolist()
    return [(signed[i], signed[root(i)]) for i in range(len(prints)) if root(i) != i]


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long; null texts have none of the words, so zero."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", size) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def near_links(prints: DataFrame, max_bits: int = 2, pivots: int = 24) -> DataFrame:
    """``a, b``: links that join the same groups as all pairs of the distinct ``fp`` within ``max_bits``.

    A close pair agrees on ``KEPT_BLOCKS`` of ``max_bits`` more blocks of bits, so it
    meets in a bucket of one of those block choices. A bucket is searched with a
    pivot distance table and gives links of a spanning forest, never all
    its pairs. The members of buckets above ``BUCKET`` come out marked; they are linked
    through midpoints instead: two fingerprints within two bits have one within one
    bit of either, and at most 65 fingerprints meet at a midpoint.
    """
    if max_bits != 2:
        raise ValueError("links are defined for two bits")
    table = references(pivots)
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(max_bits)]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))
    dealt = keyed.repartition(partitions(prints.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, large = None, [], False

        def flush(found: list) -> list:
            return spanning_links(np.concatenate(found).view(np.uint64), table, max_bits) if sum(map(len, found)) > 1 else []

        for batch in batches:
            mask, key, fp = (batch.column(n).to_numpy() for n in ("mask", "key", "fp"))
            starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)], strict=True):
                if (mask[a], key[a]) != last:
                    if not large:
                        out += flush(held)
                    last, held, large = (mask[a], key[a]), [], False
                if b == len(fp) or b - a > 1 or held or large:  # a single row inside a batch is alone in its bucket
                    held.append(fp[a:b].copy())
                    if large or sum(map(len, held)) > BUCKET:
                        large = True
                        out += [(f, None) for part in held for f in part.tolist()]
                        held = []
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = [] if large else flush(held)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    found = settle(dealt.mapInArrow(run, "a long, b long"))
    marked = found.where("b IS NULL").select("a").distinct()
    flips = [F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)]]
    meets = marked.select("a", F.explode(F.array(*flips)).alias("midpoint")).groupBy("midpoint").agg(F.collect_set("a").alias("all"))
    stars = meets.where(F.size("all") > 1).select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
    return found.where("b IS NOT NULL").union(stars.where("a != b"))


def simhash_components(docs: DataFrame, size: int = 3, max_bits: int = 2, pivots: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id that links reach).

    Rows of one fingerprint form a class before any search, so copies are never
    paired. Words are lower-cased in A-Z only and parted by ASCII white space; shingles
    count as often as they occur. Null and empty texts have fingerprint zero and link
    like any other; null ids take their component's smallest id, null if it has none;
    repeated rows are rows; an empty table gives an empty result; other columns are ignored.
    """
    prints = settle(fingerprints(docs, size, id_col, text_col))
    classes = settle(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_links(classes.select("fp"), max_bits, pivots))
    linked = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = settle(linked.select("fp", "root").join(least, "root").select("fp", "component"))
    final = classes.join(moved, "fp", "left").select("fp", F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(final, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
