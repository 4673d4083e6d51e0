"""Groups of near copies by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import bounded_broadcast, partitions, settle
from decretum.llm.components import connected_components
from decretum.llm.simhash import BITS, close_pairs, references

#: A text has ``BANDS`` keys of ``ROWS`` minima of its shingles' digests each: a pair at 0.8 misses all of them once in 4,600 times.
BANDS, ROWS = 16, 4
#: Bits by which the fingerprints of a pair may differ: at 0.8 the mean is 9.7 of 64 with a deviation of 2.9.
RADIUS = 22
#: Longs of a set's parity map: sets that differ in d shingles have maps that differ in d bits at most.
MAP_LONGS = 8
#: Members of a key that meet each other in their task; of larger keys all members stay.
SMALL = 256
#: Centres that a class meets, one for each order of the centres, before classes still apart meet each other.
CENTRES = 8
#: Classes whose keys may be broadcast to the texts.
BROADCAST_CLASSES = 50_000

_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct XXH64 digests of the text's shingles of ``size`` words (fewer words: one of all of them)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, last = np.concatenate([[0], ends[:-1] + 1])[:n], ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist(), strict=True)), np.uint64, n))


def _longs(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def parity_map(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's digests fall on each bit."""
    bits = np.bincount((found & np.uint64(64 * MAP_LONGS - 1)).astype(np.int64), minlength=64 * MAP_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles: digests of ``ROWS`` minima each, under fixed orders of all digests."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * _FACTORS[None, :]).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def set_fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed long."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 4096):
        votes += np.unpackbits(found[at : at + 4096].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(found)).view(">u8").astype(np.uint64).view(np.int64)[0])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text_digest(text).alias("digest"), text.alias("text"))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _classes(rows: DataFrame, size: int) -> DataFrame:
    """One row per distinct shingle set: ``c`` (its digest), ``least`` (smallest key), ``n``, ``fp`` (fingerprint), ``map``, ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column("text")]
            c = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            made = [pa.array(c), pa.array([len(s) for s in sets], pa.int32()), pa.array([set_fingerprint(s) for s in sets], pa.int64())]
            made += [_longs([parity_map(s) for s in sets]), _longs([band_keys(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *made], ["id", "digest", "c", "n", "fp", "map", "keys"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, digest string, c long, n int, fp long, map array<long>, keys array<long>")
    least = F.min(F.struct("id", "digest")).alias("least")
    return settle(made.groupBy("c").agg(least, *[F.first(x).alias(x) for x in ("n", "fp", "map", "keys")]))


def _sizes_fit(n, m, threshold: Fraction):
    """Sizes leave room for a pair at the threshold (numpy or Column)."""
    return (n * threshold.denominator >= m * threshold.numerator) & (m * threshold.denominator >= n * threshold.numerator)


def _members(classes: DataFrame, threshold: Fraction) -> DataFrame:
    """``s, c, fp, n, map``: keys and their classes, without classes that have no partner there.

    A key's classes meet with their fingerprints: a pair whose distances to any pivot differ by more than ``RADIUS`` is
    discarded, as is one that sizes rule out. Of keys with more than ``SMALL`` classes all stay.
    """
    pivots = references(24)
    rows = classes.select(F.explode("keys").alias("s"), "c", "fp", F.col("n").cast("long").alias("n"))
    dealt = rows.repartition(partitions(rows.sparkSession), "s").sortWithinPartitions("s", "c")

    def partnered(held: np.ndarray) -> np.ndarray:
        _, _, fp, n = held
        found = np.zeros(len(fp), bool)
        for i, j in close_pairs(fp.view(np.uint64), pivots, RADIUS):
            fits = _sizes_fit(n[i], n[j], threshold)
            found[i[fits]] = found[j[fits]] = True
        return held[:, found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, large = None, [], False

        def made(parts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate([np.zeros((4, 0), np.int64), *parts], 1)], ["s", "c", "fp", "n"])

        for batch in batches:
            rows = np.stack([batch.column(x).to_numpy() for x in ("s", "c", "fp", "n")])
            starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            ends, out = np.append(starts[1:], rows.shape[1]), []
            wanted = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == rows.shape[1]))  # a single row inside a batch is alone
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                if rows[0, a] != last:
                    out += [partnered(np.concatenate(held, 1))] if held else []
                    last, held, large = int(rows[0, a]), [], False
                held.append(rows[:, a:b].copy())
                if large or sum(x.shape[1] for x in held) > SMALL:
                    large = True
                    out += held
                    held = []
            yield made(out)
        yield made([partnered(np.concatenate(held, 1))] if held else [])

    return settle(settle(dealt.mapInArrow(run, "s long, c long, fp long, n long")).join(classes.select("c", "map"), "c"))


def _sets(members: DataFrame, classes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """``c, found``: the whole shingle sets of the classes that have a partner."""
    used = settle(members.select("c").distinct().join(classes.select("c", "least.id", "least.digest"), "c"))
    texts = rows.join(bounded_broadcast(used, BROADCAST_CLASSES), ["id", "digest"]).select("c", "text").dropDuplicates(["c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("c"), _longs([shingle_set(t.as_py(), size) for t in batch.column("text")])], ["c", "found"])

    return settle(texts.mapInArrow(run, "c long, found array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Those of the pairs ``a, b`` whose exact similarity reaches the threshold."""
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = pairs.join(sets.toDF("a", "fa"), "a").join(sets.toDF("b", "fb"), "b")
    shared = F.size(F.array_intersect("fa", "fb")).cast("long")
    p, q = threshold.numerator, threshold.denominator
    return settle(both.where(shared * (p + q) >= (F.size("fa") + F.size("fb")) * p).select("a", "b"))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of keys that hold more than one group, with their ``root`` and the key's largest group ``main``."""
    known = members.join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    groups = known.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k"))
    main = groups.groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return settle(known.join(main.drop("groups"), "s"))


def _near(x: str, y: str, threshold: Fraction) -> Column:
    """Fingerprints, sizes and parity maps leave room for a pair at the threshold."""
    p, q = threshold.numerator, threshold.denominator
    close = F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= RADIUS
    odd = sum((F.bit_count(F.col(f"{x}.map")[i].bitwiseXOR(F.col(f"{y}.map")[i])) for i in range(MAP_LONGS)), F.lit(0))
    return close & _sizes_fit(F.col(f"{x}.n"), F.col(f"{y}.n"), threshold) & (odd * (p + q) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (q - p))


def _stars(members: DataFrame, threshold: Fraction) -> DataFrame:
    """For each class at most ``CENTRES`` pairs: in each of so many orders, the first of its keys' first members.

    Large groups share most keys, so their classes meet the same few centres, and hardly one meets none that is near.
    """
    body = F.struct("c", "fp", "n", "map")
    firsts = [F.min_by(body, F.struct(F.xxhash64("c", F.lit(turn)), "c")) for turn in range(CENTRES)]
    centres = members.groupBy("s").agg(F.array(*firsts).alias("centres"))
    each = members.join(centres, "s").select(body.alias("x"), F.posexplode("centres").alias("turn", "y"))
    each = each.where((F.col("x.c") != F.col("y.c")) & _near("x", "y", threshold))
    return each.groupBy(F.col("x.c").alias("a"), "turn").agg(F.min_by("y.c", F.struct(F.xxhash64("y.c", "turn"), "y.c")).alias("b")).select("a", "b")


def _left_apart(apart: DataFrame, threshold: Fraction) -> DataFrame:
    """All pairs in different groups, of members outside their key's largest group with the others, that sizes and fingerprints do not rule out."""
    x, y = apart.where("root != main").alias("x"), apart.alias("y")
    other = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.c") < F.col("y.c")))
    return x.join(y, (F.col("x.s") == F.col("y.s")) & other & _near("x", "y", threshold)).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def near_copies(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of near copies: ``id, digest`` of its first row (smallest id, then smallest ``text_digest``).

    Two texts are near copies if their sets of shingles of ``size`` words have a Jaccard similarity of ``threshold`` at
    least; groups are what such pairs connect. Texts of one set are one class before any search. Candidates
    share one of ``BANDS`` keys of shingle minima, are within ``RADIUS`` bits of each other's SimHash by pivot
    distance tables, and are verified on the whole sets: no pair below the threshold links, and at 0.8 a pair is missed
    about three times in ten thousand (never, if another text links its ends). Each class first meets a few
    centres of its keys, so large groups join without their pairs; then classes that are still in different groups meet.

    Words are lower-cased in A-Z only and parted by ASCII white space; null and empty texts have no
    shingles and are one class, texts with fewer words have one shingle; null ids sort
    first; an empty table gives an empty result.
    """
    share = Fraction(str(threshold))
    if not 0 < share <= 1:
        raise ValueError("the threshold is a share above 0")
    rows = _keyed(docs, id_col, text_col)
    classes = _classes(rows, size)
    members = _members(classes, share)
    sets = _sets(members, classes, rows, size)
    links = _verified(_stars(members, share), sets, share)
    roots = connected_components(links)
    apart = _apart(members, roots)
    if not apart.isEmpty():
        roots = connected_components(links.union(_verified(_left_apart(apart, share), sets, share)))
    grouped = classes.select("c", "least").join(roots.toDF("c", "root"), "c", "left")
    return grouped.groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("least").alias("least")).select("least.id", "least.digest")
