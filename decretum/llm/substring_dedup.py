"""Removal of long byte strings that occur more than once, by suffix arrays over shards of the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import bounded_broadcast, partitions, settle
from decretum.llm.suffixes import permuted_common_prefixes, suffix_array
from decretum.llm.winnow import segments

#: Bytes of the grams by whose digests segments are chosen.
GRAM = 128
#: Bytes of a suffix array at least, and contents of one digest that go into it; larger groups are split by window.
SHARD_BYTES, GROUP = 1 << 21, 4096
#: Digests above ``GROUP`` that may be broadcast; beyond that the join shuffles.
LARGE_DIGESTS = 100_000

SEGMENTS = "k long, th long, fp long, content long, a int, b int, repeats boolean"
SPANS = "fp long, content long, spans array<struct<a:int,b:int>>"


def merged(starts: np.ndarray, width: int) -> list[dict[str, int]]:
    """Maximal byte ranges covered by windows at the sorted ``starts``."""
    cuts = np.flatnonzero(np.diff(starts) > width) + 1
    firsts, lasts = starts[np.concatenate([[0], cuts])], starts[np.concatenate([cuts - 1, [len(starts) - 1]])]
    return [{"a": a, "b": b + width} for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]


def shard_spans(contents: list[bytes], window: int) -> list[list[dict[str, int]]]:
    """For each content, the ranges of windows that stand twice or more in the shard.

    The contents are put behind each other with a separator that no byte equals. Suffixes that
    follow each other in the suffix array with common prefixes of ``window`` or more start with
    the same window; of each segment only its own window starts count.
    """
    sizes = np.array([len(c) for c in contents])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = np.zeros(int(sizes.sum()) + len(contents), np.int16)
    own = np.zeros(len(codes), bool)
    for content, at in zip(contents, begins.tolist(), strict=True):
        codes[at : at + len(content)] = np.frombuffer(content, np.uint8)
        codes[at : at + len(content)] += 1
        own[at : at + len(content) - window + 1] = True
    sa = suffix_array(codes)
    common = permuted_common_prefixes(codes, sa)
    group = np.cumsum(common[sa] < window)
    mine = own[sa]
    count = np.bincount(group[mine], minlength=int(group[-1]) + 1)
    twice = np.sort(sa[mine & (count[group] > 1)])
    out = []
    for at, to in zip(begins.tolist(), (begins + sizes).tolist(), strict=True):
        starts = twice[np.searchsorted(twice, at) : np.searchsorted(twice, to)] - at
        out.append(merged(starts, window) if len(starts) else [])
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` and their key ``k, th``; rows of one key have the same text, and so the same result."""
    text, id_ = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int")
    k = F.coalesce(id_.cast("long"), F.lit(-1)) if whole else F.xxhash64(id_)
    return docs.select(id_.alias("id"), k.alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


def corpus_segments(texts: DataFrame, window: int) -> DataFrame:
    """Content-chosen segments of all texts of ``window`` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column("text")):
                own = segments(text.as_buffer().to_pybytes(), window, min(GRAM, window))
                row += [i] * len(own)
                found += own
            fp, a, b, content, repeats = ([f[k] for f in found] for k in range(5))
            at = pa.array(row, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            columns = [pa.array(v, k) for v, k in zip((fp, content, a, b, repeats), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("th").take(at), *columns], ["k", "th", "fp", "content", "a", "b", "repeats"])

    return texts.select("k", "th", "text").mapInArrow(run, SEGMENTS)


def _sorted_spans(contents: DataFrame, window: int) -> DataFrame:
    """Ranges of repeated windows in each content of ``fp, content, bytes``; a digest has ``GROUP`` contents at most."""
    dealt = contents.select("fp", "content", "bytes").repartition(partitions(contents.sparkSession), "fp").sortWithinPartitions("fp", "content")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        spans = shard_spans([r[2] for r in rows], window) if rows else []
        found = [(fp, content, s) for (fp, content, _), s in zip(rows, spans, strict=True) if s]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["fp", "content", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("fp", "content", "bytes")], strict=True):
                if shard and shard[-1][:2] == row[:2]:
                    continue  # a repeated row brings its contents again
                if size >= SHARD_BYTES and row[0] != shard[-1][0]:
                    yield solve(shard)
                    shard, size = [], 0
                shard.append(row)
                size += len(row[2])
        yield solve(shard)

    return settle(dealt.mapInArrow(run, SPANS))


def _window_spans(large: DataFrame, window: int) -> DataFrame:
    """The same for digests with more contents than one suffix array takes: digests of their windows are counted over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, content, data in zip(*[batch.column(n).to_pylist() for n in ("fp", "content", "bytes")], strict=True):
                n = len(data) - window + 1
                digests = pa.array([xxhash.xxh3_128_digest(data[s : s + window]) for s in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([fp] * n), pa.array([content] * n), pa.array(range(n), pa.int32()), digests], ["fp", "content", "s", "digest"])

    windows = settle(large.select("fp", "content", "bytes").mapInArrow(run, "fp long, content long, s int, digest binary"))
    twice = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    starts = windows.join(twice, "digest").groupBy("fp", "content").agg(F.collect_list(F.struct(F.col("s").alias("a"), (F.col("s") + window).alias("b"))).alias("spans"))
    return starts.select("fp", "content", "spans")


def keep_rest(sha: str | None, raw: pa.Scalar, ranges: list[dict[str, int]] | None) -> tuple[int, int, str, bytes | None]:
    """Removed bytes, maximal removed runs, digest of the rest, and the rest, given the sorted ranges to remove."""
    text = raw.as_py()
    if sha is not None:
        return 0, 0, sha, text
    gone, count, at, parts = 0, 0, 0, []
    for r in ranges or []:
        if r["x"] > at or not count:
            parts.append(text[at : r["x"]])
            count, at = count + 1, r["x"]
        if r["y"] > at:
            gone, at = gone + r["y"] - at, r["y"]
    left = b"".join(parts) + text[at:]
    return gone, count, hashlib.sha256(left).hexdigest(), left


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (``kept_bytes`` on request).

    A byte goes if a string of ``window`` bytes that covers it starts anywhere else too.
    Each text is cut into segments by the smallest digest of a gram in each
    window, so equal windows of any two places are in segments of the same digest. A
    digest that stands once has nothing to find. Of the others, equal segments are found by
    content; different ones of a digest go together into a shard, whose suffix array and
    common prefixes tell which windows repeat. Texts move twice: all of them to
    their segments, and those with repeats to their spans.

    A null text counts as empty; a text shorter than ``window`` loses nothing; rows equal in id
    and text repeat each other like any two documents; null ids are documents of their own
    text; an empty table gives an empty result; other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col)
    every = settle(corpus_segments(texts, window))
    differ = F.min("content") != F.max("content")
    shared = every.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), differ.alias("differ"), F.max("repeats").alias("twice")).where("n > 1 OR twice")
    found = settle(every.drop("repeats").join(shared.select("fp", F.expr("differ OR n = 1").alias("sort")), "fp"))
    place = F.struct("k", "th", "a")
    same = found.groupBy("fp", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    told = settle(found.join(same, ["fp", "content"]).withColumn("cut", F.col("sort") & (place == F.col("first"))).drop("first", "sort"))

    # all texts meet their segments: those without any are done, the others bring the contents to be sorted
    large = told.where("cut").groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("fp", F.lit(True).alias("large"))
    large = bounded_broadcast(settle(large), LARGE_DIGESTS)
    wanted = F.struct("fp", "content", "a", "b", F.coalesce("large", F.lit(False)).alias("large"))
    lists = told.join(large, "fp", "left").groupBy("k", "th").agg(F.collect_set(F.when(F.col("cut"), wanted)).alias("cuts"))
    touched = F.col("cuts").isNotNull()
    met = settle(
        texts.join(lists, ["k", "th"], "left").select(
            "id", "k", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.when(~touched, F.sha2("text", 256)).alias("sha"),
            F.when(touched | F.lit(with_text), F.col("text").cast("binary")).alias("raw"), "cuts",
        )
    )
    cuts = met.where("size(cuts) > 0").select("raw", F.explode("cuts").alias("c"))
    contents = cuts.select("c.fp", "c.content", "c.large", F.expr(f"substring(raw, c.a + 1, c.b - c.a + {window})").alias("bytes"))
    spans = _sorted_spans(contents.where("NOT large"), window).union(_window_spans(contents.where("large"), window))

    whole = told.where("n > 1").select("k", "th", F.col("a").alias("x"), (F.col("b") + window).alias("y"))
    part = told.where("n = 1").join(spans, ["fp", "content"]).select("k", "th", "a", F.explode("spans").alias("s"))
    ranges = whole.union(part.select("k", "th", F.col("a") + F.col("s.a"), F.col("a") + F.col("s.b")))
    ranges = ranges.groupBy("k", "th").agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("ranges"))
    clean = met.where("sha IS NOT NULL").select("id", "n_bytes", "sha", "raw", F.lit(None).cast("array<struct<x:int,y:int>>").alias("ranges"))
    joined = clean.union(met.where("sha IS NULL").join(ranges, ["k", "th"], "left").select("id", "n_bytes", "sha", "raw", "ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [keep_rest(*r) for r in zip(batch.column("sha").to_pylist(), batch.column("raw"), batch.column("ranges").to_pylist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: 3 + with_text])]
            names = ["n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 3 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *new], ["id", "n_bytes", *names])

    kind = joined.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text)
    return out.withColumnRenamed("id", id_col)
