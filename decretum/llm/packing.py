"""Best-fit decreasing packing of documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decretum.llm.common import settle
from decretum.llm.tokens import byte_encoder

PIECES = "id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, after a first one that may be shorter."""
    whole, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * whole


class BinTree:
    """Segment tree over remaining capacities 0..capacity: how many classes of open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, remaining: int, by: int) -> None:
        at = self.size + remaining
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open bin has."""
        at = self.size + length
        if self.counts[at]:
            return length
        while at > 1 and (at & 1 or not self.counts[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.size


def plan(histogram: Iterable[tuple[int, int]], capacity: int) -> np.ndarray:
    """Best-fit decreasing over all pieces, from the number of pieces of each length.

    Bins of the same content form a class: a range of sequence numbers. Equal pieces
    go to the tightest class that takes them, as many into a bin as it holds, as they
    would one by one. Rows: length, first rank, first sequence, pieces per bin, offset.
    """
    tree, classes, rows, opened = BinTree(capacity), {}, [], 0

    def put(remaining: int, base: int, count: int) -> None:
        if count and remaining:
            classes.setdefault(remaining, []).append((base, count))
            tree.add(remaining, 1)

    for length, n in sorted(histogram, reverse=True):
        rank = 0
        while rank < n:
            room = tree.tightest(length)
            if room is None:
                room, base, count = capacity, opened, -(-(n - rank) // (capacity // length))
                opened += count
            else:
                base, count = classes[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(count, (n - rank) // each)
            rows.append((length, rank, base, each, capacity - room))
            put(room - each * length, base, full)
            rank += full * each
            if full < count:
                put(room - (n - rank) * length, base + full, 1) if n > rank else put(room, base + full, 1)
                put(room, base + full + 1, count - full - 1)
                rank = n
    return np.array(rows, np.int64).reshape(-1, 5)


def _pieces(id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = byte_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ["id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encoder.encode(text.as_py() or "") + end)
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = [doc, piece, start, length, zlib.crc32(own), part, seen[length], *[np.frombuffer(own, "<u4").tolist()] * with_ids]
                    for values, value in zip(out.values(), row, strict=True):
                        values.append(value)
                    start += length
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=False)], list(out))

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (``ids`` on request).

    Pieces are counted by length, which gives at most ``capacity`` numbers for any
    input; best-fit decreasing with a segment tree turns them into a plan of ranges.
    A piece's rank among those of its length comes from its place in its partition
    and the counts of the partitions before it, and the plan gives its sequence.

    A null or empty text is one piece of the end id alone; repeated rows and null ids
    are packed like any others; an empty table gives an empty result; other columns
    are ignored.
    """
    schema = PIECES + (", ids array<long>" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    cut = settle(rows.mapInArrow(_pieces(id_col, text_col, tokenizer, capacity, end_id, with_ids), schema))
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as lengths, so never more than ``capacity``
    ranges = plan([tuple(r) for r in counts.groupBy("length").agg(F.sum("n")).collect()], capacity)
    order = np.lexsort((ranges[:, 1], ranges[:, 0]))
    lengths, firsts, bases, each, offsets = ranges[order].T
    starts = np.searchsorted(lengths, np.arange(capacity + 2))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("_before")), ["length", "part"])
    ranked = ranked.withColumn("_rank", F.col("nth") + F.col("_before")).drop("_before", "nth", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            for value in np.unique(length):
                own = length == value
                at[own] = starts[value] + np.searchsorted(firsts[starts[value] : starts[value + 1]], rank[own], "right") - 1
            nth = rank - firsts[at]
            kept = [n for n in batch.schema.names if n != "_rank"]
            sequence, offset = bases[at] + nth // each[at], offsets[at] + nth % each[at] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank"]
    placed = ranked.mapInArrow(place, ", ".join([*kept, "sequence_id long", "offset long"]))
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of pieces packed with ``with_ids``; a sequence holds no more than ``capacity`` ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda p: p["ids"])).alias("ids"))
