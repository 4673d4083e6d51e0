"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of them ends together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import settle, small_batches
from decretum.llm.tokens import CUT, both_encoder

#: Characters of texts that are aligned at once; longer texts are aligned in parts, cut where both tokenizers must cut.
PART = 1 << 18
#: Documents of an Arrow batch, which a task holds as a whole, and links that are joined to their counts at once.
BATCH_ROWS, LINKS = 500, 1 << 18
SPACE = "\u2581"


@lru_cache(maxsize=2)
def token_bytes(path_a: str, path_b: str) -> tuple[pa.Array, pa.Array]:
    """The bytes of every token id of either tokenizer."""
    encoder = both_encoder(path_a, path_b)
    return pa.array(encoder.bytes_a, pa.binary()), pa.array(encoder.bytes_b, pa.binary())


def possible_pairs(path_a: str, path_b: str) -> int:
    """Pairs of tokens that can end together: the bytes of one end with those of the other. No corpus has more."""
    a, b = ([t for t in side.to_pylist() if t] for side in token_bytes(path_a, path_b))
    count = {side: {} for side in "ab"}
    for side, tokens in (("a", a), ("b", b)):
        for t in tokens:
            count[side][t] = count[side].get(t, 0) + 1
    longer_a = sum(count["b"].get(t[i:], 0) for t in a for i in range(len(t)))
    return longer_a + sum(count["a"].get(t[i:], 0) for t in b for i in range(1, len(t)))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    """Token ids of parts."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])))


def _spelled(tokens: pa.ListArray, spelling: pa.Array, parts: list[bytes]) -> list[bool]:
    """Which parts their tokens' bytes spell exactly."""
    joined = spelling.take(tokens.values)
    ends = np.frombuffer(joined.buffers()[1], "<i4", len(joined) + 1)[np.asarray(tokens.offsets)].tolist()
    data = joined.buffers()[2].to_pybytes() if len(joined) else b""
    return [b - a == len(p) and data[a:b] == p for a, b, p in zip(ends, ends[1:], parts, strict=False)]


def _ends(tokens: pa.ListArray, spelling: pa.Array) -> pa.Table:
    """Each token with its part and the byte of the part at which it ends: a sum that starts anew with each part."""
    flat, part = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pc.binary_length(spelling.take(flat)).cast(pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(tokens.offsets.slice(0, len(tokens)))
    return pa.table({"part": part, "end": pc.subtract(total, before.take(part)), "token": flat, "at": pa.array(np.arange(len(flat), dtype=np.int64))})


def _written(tokens: pa.Array, closes: np.ndarray) -> pa.Array:
    """The tokens of each group in decimal digits; ``closes`` marks a group's last token."""
    offsets = np.concatenate([[0], np.flatnonzero(closes) + 1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens.cast(pa.string())), ",")


def align_parts(a: pa.ListArray, b: pa.ListArray, bytes_a: pa.Array, bytes_b: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
    """For each part the pairs of tokens that end together, as ``a * tokens of B + b``, and its groups in writing.

    Both sides of a part spell the same bytes. No token is empty, so of each side one token at most ends at a byte.
    """
    left, right = _ends(a, bytes_a), _ends(b, bytes_b)
    links = left.join(right, ["part", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    at, at_b = links["at"].to_numpy(), links["at_b"].to_numpy()
    linked, linked_b = np.zeros(len(left), bool), np.zeros(len(right), bool)
    linked[at], linked_b[at_b] = True, True
    pair = np.zeros(len(left), np.int64)
    pair[at] = links["token"].to_numpy().astype(np.int64) * len(bytes_b) + links["token_b"].to_numpy()
    of_part = np.concatenate([[0], np.cumsum(linked)])[np.asarray(a.offsets)]
    offsets = pa.array(of_part, pa.int32())
    groups = pc.binary_join_element_wise(_written(pc.list_flatten(a), linked), _written(pc.list_flatten(b), linked_b), "|")
    return pa.ListArray.from_arrays(offsets, pa.array(pair[linked])), pa.ListArray.from_arrays(offsets, groups)


def _parts(text: str | None) -> list[str]:
    """A text in parts of about ``PART`` characters, each cut at a single space, which goes to neither."""
    out, at = [], 0
    while text and len(text) - at > PART:
        cut = CUT.search(text, at + PART)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]] if text else []


class _Document:
    """What the parts of a document add up to."""

    def __init__(self, valid: bool):
        self.valid, self.digest, self.pairs, self.groups = valid, hashlib.sha256(), [], []
        self.a = self.b = 0

    def add(self, a: int, b: int, pairs: np.ndarray, groups: str, keep: bool) -> None:
        if self.pairs:
            self.digest.update(b";")
        self.digest.update(groups.encode())
        self.a, self.b = self.a + a, self.b + b
        self.pairs.append(pairs)
        if keep:
            self.groups.append(groups)

    def row(self) -> tuple:
        if not self.valid or not self.pairs:
            return 0, 0, "", np.zeros(0, np.int64), ""
        return self.a, self.b, self.digest.hexdigest(), np.concatenate(self.pairs), ";".join(self.groups)


def _align(texts: list[str | None], path_a: str, path_b: str, keep: bool) -> list[tuple]:
    """``n_a, n_b, groups' SHA-256, pairs, groups`` of each text."""
    spelling = token_bytes(path_a, path_b)
    encoder = both_encoder(path_a, path_b)
    owner, parts = [], []
    for i, text in enumerate(texts):
        own = _parts(text)
        owner += [i] * len(own)
        parts += own
    documents = [_Document(True) for _ in texts]
    at = 0
    checked: list[tuple[int, pa.ListArray, pa.ListArray]] = []
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= PART):
            size, to = size + len(parts[to]), to + 1
        # a text that spells the second tokenizer's sign for a space cannot come back from its pieces
        a, b = map(_lists, encoder.encode(["" if SPACE in p else p for p in parts[at:to]]))
        raw = [b" " + p.encode() for p in parts[at:to]]
        for i, x, y in zip(owner[at:to], _spelled(a, spelling[0], raw), _spelled(b, spelling[1], raw), strict=True):
            documents[i].valid &= x and y
        checked.append((at, a, b))
        at = to
    for at, a, b in checked:
        valid = np.array([documents[i].valid for i in owner[at : at + len(a)]])
        a, b = (pc.if_else(pa.array(valid), x, pa.scalar([], pa.list_(pa.int32()))) for x in (a, b)) if not valid.all() else (a, b)
        pairs, groups = align_parts(a, b, *spelling)
        written = pc.binary_join(groups, ";").to_pylist()
        flat, offsets = pairs.values.to_numpy(), np.asarray(pairs.offsets).tolist()
        sizes = zip(pc.list_value_length(a).to_pylist(), pc.list_value_length(b).to_pylist(), strict=True)
        for i, (n_a, n_b), text, lo, hi in zip(owner[at : at + len(a)], sizes, written, offsets, offsets[1:], strict=False):
            if documents[i].valid:
                documents[i].add(n_a, n_b, flat[lo:hi], text, keep)
    return [d.row() for d in documents]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, groups_sha256, pairs`` (and ``groups``): each document's tokens and links.

    A pair is ``a * tokens of B + b``. Nulls, empty texts and texts that either tokenizer does not spell
    byte by byte (after a space) have no tokens.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fits = np.prod([len(s) for s in token_bytes(path_a, path_b)], dtype=np.int64) < 1 << 31
    code, kind = (pa.int32(), "int") if fits else (pa.int64(), "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(), 0
            upto = np.cumsum(size)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART, "right")))
                part = batch.slice(at, to - at)
                found = _align(part.column("text").to_pylist(), path_a, path_b, with_groups)
                offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in found])])
                pairs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[3] for r in found])).cast(code))
                links = pc.list_value_length(pairs).cast(pa.int64())
                columns = [part.column("id"), *[pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)], links, links, pa.array([r[2] for r in found]), pairs]
                if with_groups:
                    columns.append(pa.array([r[4] for r in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "groups"][: len(columns)])
                at = to
            pa.default_memory_pool().release_unused()

    id_kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>"
    return rows.mapInArrow(run, schema + ", groups string" * with_groups)


def pair_counts(found: DataFrame, tokens_b: int) -> DataFrame:
    """``pair, n, best``: links of each pair in all documents, and whether no other pair of its second token has more.

    Tasks count what they read; the counts of tasks are added up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pa.table({"pair": pc.list_flatten(batch.column("pairs")).cast(pa.int64())})
            some = pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            yield from some.rename_columns(["pair", "n"]).to_batches()

    counts = settle(found.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy((F.col("pair") % tokens_b).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("pair") % tokens_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per input row: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (``groups`` on request).

    ``path_a`` is a byte-level BPE file, ``path_b`` a piece model; both read the text after a space, special tokens' strings
    as plain text. Tokens of both that end at the same byte are linked, and their ends cut the tokens
    into groups. ``count_sum`` adds up, over a document's links, how many links of the
    corpus hold the pair; ``n_best`` counts the links whose pair is the most frequent of its second token, ties included.

    Everything inside a task is Arrow: lists of tokens are flattened, sums of byte lengths start anew with each document, joins on
    (document, end) find the links, and grouped counts leave the task. The table of pairs, which tasks get
    whole, has at most ``possible_pairs`` rows, whatever the corpus. A document's tokens are made once and kept as pairs.

    Nulls, empty texts and texts that do not come back byte by byte have zeros and ''; repeated rows and ids are rows,
    each counts; an empty table gives an empty result; other columns are ignored.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        found = settle(aligned(docs, path_a, path_b, id_col, text_col, with_groups))
        counts = pair_counts(found, len(token_bytes(path_a, path_b)[1])).toArrow()
    if counts.num_rows > possible_pairs(path_a, path_b):
        raise AssertionError("more pairs of tokens than can end together")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column("pairs")).to_numpy())
            out, at = np.zeros((2, batch.num_rows), np.int64), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, "right")))
                pairs = batch.column("pairs").slice(at, to - at)
                links = pa.table({"row": pc.list_parent_indices(pairs), "pair": pc.list_flatten(pairs).cast(pa.int64())})
                known = links.join(counts, "pair", join_type="inner", use_threads=False)
                sums = known.group_by("row", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
                for i, name in enumerate(("best_sum", "n_sum")):
                    out[i, at + sums["row"].to_numpy()] = sums[name].to_numpy()
                at = to
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out[0]), pa.array(out[1])], [*names, "n_best", "count_sum"])
            pa.default_memory_pool().release_unused()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*names).schema)
    out = found.mapInArrow(score, f"{kinds}, n_best long, count_sum long")
    order = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    return out.select(*order).withColumnRenamed("id", id_col)
