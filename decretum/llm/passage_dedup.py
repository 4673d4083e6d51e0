"""Removal of word sequences that a document with a smaller id has too, by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import map_arrow, partitions, settle
from decretum.llm.recompression import window_keys
from decretum.llm.winnow import gram_digests

#: Tokens that are parsed together; longer texts are parsed in parts that overlap by a window.
BLOCK = 1 << 18
#: Buckets of keys per shuffle partition: a task holds one bucket at a time.
BUCKETS = 16
#: Ids that are missing come after all others.
LAST = (1 << 63) - 1

PACKET = "bucket int, k0 long, k binary, th binary, at binary, n binary, low binary, digest binary"


def _narrow(values: np.ndarray, base: int = 0) -> bytes:
    """Non-negative integers as bytes of the smallest width that holds them all; ``_wide`` needs their number."""
    left = (values - base).astype(np.uint64)
    top = int(left.max(initial=0))
    return left.astype(next(kind for kind in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(kind).max)).tobytes()


def _wide(raw: bytes, count: int, base: int = 0) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype(np.int64) + base if count else np.zeros(0, np.int64)


class _Parsed:
    """Windows of some texts: ``text`` (number), ``start`` (in its text), ``key``, ``digest``, of all or those with wanted keys."""

    def __init__(self, width: int):
        self.width = width
        self.names, self.ends, self.first, self.offset, self.size = [], [], [], [], 0

    def add(self, words: list[bytes], offset: int) -> None:
        self.first.append(self.size)
        self.offset.append(offset)
        self.names += [xxhash.xxh3_64_intdigest(w) for w in words]
        self.names.append(0)
        self.size += len(words) + 1
        self.ends.append(self.size - 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        names, ends, first = np.array(self.names, np.uint64), np.zeros(self.size, bool), np.array(self.first, np.int64)
        ends[self.ends] = True
        starts, keys = window_keys(names, ends, self.width)
        digests = gram_digests(names, self.width)[starts] if len(starts) else np.zeros(0, np.uint64)
        text = np.searchsorted(first, starts, "right") - 1
        return text, starts - first[text] + np.array(self.offset, np.int64)[text], keys, digests


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[tuple], _Parsed]]:
    """Texts of the batches (``k``, ``th``, ``text`` and what else they have), some at a time, with their windows."""
    rows, parsed = [], _Parsed(width)
    for batch in batches:
        for row in zip(*[batch.column(name) for name in batch.schema.names], strict=True):
            words = (row[2].as_py() or "").encode("utf-8", "surrogatepass").split()
            for at in range(0, max(1, len(words) - width + 1), BLOCK):
                part = words[at : at + BLOCK + width - 1]
                if len(part) >= width:
                    rows.append((row[0].as_py(), row[1].as_py(), *[x.values.to_numpy() for x in row[3:]]))
                    parsed.add(part, at)
                if parsed.size >= BLOCK:
                    yield rows, parsed
                    rows, parsed = [], _Parsed(width)
    if rows:
        yield rows, parsed


def _symbol(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and short name of keys; the two together tell keys apart."""
    return ((keys & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64), (keys >> np.uint64(24)).astype(np.int64)


def _packets(bucket: np.ndarray, k: np.ndarray, names: np.ndarray, more: dict[str, np.ndarray] | None = None, digests: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries sorted by bucket, packed into one row per bucket. ``more['n']``: digests of each entry."""
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    out = {name: [] for name in ("bucket", "k0", "k", "th", "at", "n", "low", "digest")}
    upto = np.concatenate([[0], np.cumsum(more["n"])]) if more else None
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)], strict=False):
        base = int(k[a:b].min())
        out["bucket"].append(int(bucket[a]))
        out["k0"].append(base)
        out["k"].append(_narrow(k[a:b], base))
        out["low"].append(np.ascontiguousarray(names[a:b].astype("<u8").view("u1").reshape(-1, 8)[:, :5]).tobytes() if names is not None else None)
        for name in ("at", "n"):
            out[name].append(_narrow(more[name][a:b]) if more else None)
        out["th"].append(more["th"][a:b].astype("<i8").tobytes() if more else None)
        out["digest"].append(digests[upto[a] : upto[b]].tobytes() if digests is not None else None)
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The packets of one bucket after the other; those with a negative bucket come one by one."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["bucket"] != last or last < 0):
                yield last, held
                held = []
            last = row["bucket"]
            held.append(row)
    if held:
        yield last, held


def _dealt(packets: DataFrame) -> DataFrame:
    return packets.repartition(partitions(packets.sparkSession), "bucket").sortWithinPartitions("bucket")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k`` (the id, missing ones last), ``th`` (digest of the text), ``text``; rows equal in both have equal results."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("ids are whole numbers, as smaller ones keep what larger ones lose")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


def shared_symbols(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """``k, symbols``: for each id the keys of its windows that another id has too.

    First round. Each task names the symbols of its texts, and sends a key that several ids of a block have for
    the smallest and the largest of them only: the others know already. Keys meet by bucket, in packets of a block's entries.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parsed in _blocks(batches, width):
            text, _, keys, _ = parsed.windows()
            k = np.array([r[0] for r in rows], np.int64)[text]
            order = np.lexsort((k, keys))
            k, keys = k[order], keys[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (k[1:] != k[:-1])])[: len(k)]
            k, keys = k[new], keys[new]
            edge = np.concatenate([[True], keys[1:] != keys[:-1], [True]])
            inner = ~(edge[:-1] | edge[1:])[: len(k)]
            bucket, low = _symbol(keys, buckets)
            sent = np.flatnonzero(~inner)
            sent = sent[np.argsort(bucket[sent], kind="stable")]
            yield _packets(bucket[sent], k[sent], low[sent])
            known = np.flatnonzero(inner)
            known = known[np.argsort(bucket[known], kind="stable")]
            yield _packets(-1 - bucket[known], k[known], low[known])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packets in _by_bucket(batches):
            raw = [np.frombuffer(p["low"], "u1").reshape(-1, 5) for p in packets]
            k = np.concatenate([_wide(p["k"], len(r), p["k0"]) for p, r in zip(packets, raw, strict=True)])
            low = np.zeros((len(k), 8), "u1")
            low[:, :5] = np.concatenate(raw)
            low = low.view("<i8").ravel()
            if bucket >= 0:
                order = np.lexsort((k, low))
                k, low = k[order], low[order]
                new = np.concatenate([[True], low[1:] != low[:-1]])
                group = np.cumsum(new) - 1
                at = np.flatnonzero(new)
                shared = (k[at] != k[np.append(at[1:], len(k)) - 1])[group]
                k, low = k[shared], low[shared]
            symbol = low | np.int64((bucket if bucket >= 0 else -1 - bucket) << 40)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(symbol)], ["k", "symbol"])

    met = _dealt(texts.mapInArrow(name, PACKET)).mapInArrow(meet, "k long, symbol long")
    return met.groupBy("k").agg(F.collect_set("symbol").alias("symbols"))


def repeated_ranges(texts: DataFrame, symbols: DataFrame, width: int, buckets: int) -> DataFrame:
    """``k, th, x, y``: ranges of words whose windows a smaller id has too.

    Second round, over the windows whose symbols are shared: windows with one key and one digest are equal. Of equal windows in a
    block only those of the smallest id are sent; the others are known to go.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parsed in _blocks(batches, width):
            text, start, keys, digests = parsed.windows()
            bucket, low = _symbol(keys, buckets)
            symbol = low | (bucket << 40)
            live = np.zeros(len(text), bool)
            edges = np.searchsorted(text, np.arange(len(rows) + 1))
            for i, row in enumerate(rows):
                live[edges[i] : edges[i + 1]] = np.isin(symbol[edges[i] : edges[i + 1]], row[2])
            text, start, bucket, keys, digests = text[live], start[live], bucket[live], keys[live], digests[live]
            k, th = (np.array([r[i] for r in rows], np.int64)[text] for i in (0, 1))
            order = np.lexsort((k, digests, keys))
            new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (digests[order][1:] != digests[order][:-1])])[: len(order)]
            least = np.zeros(len(k), np.int64)
            least[order] = k[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = k > least
            for chosen, sign in ((~gone, 1), (gone, -1)):
                w = np.flatnonzero(chosen)
                fresh = np.concatenate([[True], (text[w][1:] != text[w][:-1]) | (np.diff(start[w]) != 1) | (keys[w][1:] != keys[w][:-1])])[: len(w)]
                head = np.flatnonzero(fresh)
                n = np.diff(np.append(head, len(w)))
                by = np.argsort(bucket[w[head]], kind="stable")
                one = w[head][by]
                where = bucket[one] if sign > 0 else -1 - bucket[one]
                spread = np.repeat(head[by] - np.concatenate([[0], np.cumsum(n[by])[:-1]]), n[by]) + np.arange(int(n.sum()))
                yield _packets(where, k[one], None, {"th": th[one], "at": start[one], "n": n[by]}, digests[w[spread]] if sign > 0 else None)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packets in _by_bucket(batches):
            sizes = [len(p["th"]) // 8 for p in packets]
            k = np.concatenate([_wide(p["k"], c, p["k0"]) for p, c in zip(packets, sizes, strict=True)])
            at, n = (np.concatenate([_wide(p[name], c) for p, c in zip(packets, sizes, strict=True)]) for name in ("at", "n"))
            th = np.concatenate([np.frombuffer(p["th"], "<i8") for p in packets])
            first, count = at, n
            if bucket >= 0:
                digests = np.concatenate([np.frombuffer(p["digest"], "<u8") for p in packets])
                owner = np.repeat(np.arange(len(k)), n)
                start = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((k[owner], digests))
                new = np.concatenate([[True], digests[order][1:] != digests[order][:-1]])
                least = np.zeros(len(owner), np.int64)
                least[order] = k[owner][order][np.flatnonzero(new)][np.cumsum(new) - 1]
                w = np.flatnonzero(k[owner] > least)
                head = np.flatnonzero(np.concatenate([[True], (owner[w][1:] != owner[w][:-1]) | (np.diff(start[w]) != 1)])[: len(w)])
                count = np.diff(np.append(head, len(w)))
                k, th, first = k[owner[w[head]]], th[owner[w[head]]], start[w[head]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, th, first, first + count + width - 1)], ["k", "th", "x", "y"])

    live = texts.join(symbols, "k").select("k", "th", "text", "symbols")
    return settle(_dealt(live.mapInArrow(verify, PACKET)).mapInArrow(meet, "k long, th long, x long, y long"))


def keep_words(text: str, ranges: list[dict[str, int]] | None) -> tuple[int, int, bytes]:
    """Words of the text, how many of them the ranges remove, and the others joined by single spaces."""
    words = text.encode("utf-8", "surrogatepass").split()
    kept = words
    if ranges:
        stays = np.zeros(len(words) + 1, np.int64)
        np.add.at(stays, [r["x"] for r in ranges], 1)
        np.add.at(stays, [r["y"] for r in ranges], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(stays)[:-1] == 0).tolist()]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_passages(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_removed, kept_sha256`` (``kept_text`` on request).

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id. Rounds of recompression
    give runs and pairs of words names that are the same everywhere, so equal windows have equal symbols inside. A
    symbol that one id alone has rules out its windows; the windows of shared symbols are compared by digests. Names are 64-bit
    digests, which every task can make, so no round needs a dictionary: only the keys of the highest symbols
    move, some bytes for several words, and texts move twice, to their shared symbols and to their ranges.

    Words are parted by ASCII white space and compared as they are. Null texts have no words, shorter ones than
    ``width`` lose nothing. Rows of one id are one document: they lose nothing to each other. Missing ids come
    after all others and are one document too. Ids that are not whole numbers are refused; an empty table gives an
    empty result; other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col)
    buckets = BUCKETS * partitions(docs.sparkSession)
    ranges = repeated_ranges(texts, shared_symbols(texts, width, buckets), width, buckets)
    lists = ranges.groupBy("k", "th").agg(F.collect_set(F.struct("x", "y")).alias("ranges"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = texts.join(lists, ["k", "th"], "left").select(F.when(F.col("k") != LAST, F.col("k")).cast(kind).alias("id"), "text", "ranges")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [keep_words(t.as_py(), r.as_py()) for t, r in zip(batch.column("text"), batch.column("ranges"), strict=True)]
        new = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)] + [pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
        if with_text:
            new.append(pa.array([r[2].decode("utf-8", "surrogatepass") for r in rows], pa.string()))
        return pa.RecordBatch.from_arrays([batch.column("id"), *new], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    out = map_arrow(joined, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text, cut)
    return out.withColumnRenamed("id", id_col)
