"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decretum.llm.common import fold, labelled_sample

STEP = 4  # bytes from one position of a filter to the next; a filter is two steps wide
SEGMENT = 16  # positions that are pooled first
CHUNK, OVERLAP = 8, 1  # segments of a chunk (512 bytes), and those it shares with the next one
PAD = 256
CHUNK_BYTES = STEP * SEGMENT * CHUNK
ADVANCE = STEP * SEGMENT * (CHUNK - OVERLAP)


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the overlapping chunks that cover ``n`` bytes; at least one."""
    return np.arange(max(1, -(-(n - STEP * SEGMENT * OVERLAP) // ADVANCE))) * ADVANCE


@dataclass
class ByteNet:
    """Byte embedding, filters over two neighbouring steps, and weights of the pooled responses."""

    embed: np.ndarray  # (257, d)
    first: np.ndarray  # (STEP * d, filters)
    second: np.ndarray
    bias: np.ndarray
    dense: np.ndarray  # (2 * filters,): of the largest and of the mean chunk response
    offset: float

    @classmethod
    def start(cls, dims: int = 8, filters: int = 32, seed: int = 42) -> ByteNet:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (257, dims)).astype(np.float32)
        embed[PAD] = 0
        size = STEP * dims
        first, second = (r.normal(0, size**-0.5, (size, filters)).astype(np.float32) for _ in range(2))
        return cls(embed, first, second, np.zeros(filters, np.float32), np.zeros(2 * filters, np.float32), 0.0)

    def chunk_pools(self, raw: bytes, block: int = 1 << 12) -> np.ndarray:
        """Largest response of each filter in each chunk: ``(chunks, filters)``; memory is bounded by ``block`` segments."""
        chunks = len(chunk_starts(len(raw)))
        segments = (chunks - 1) * (CHUNK - OVERLAP) + CHUNK
        size = segments * SEGMENT * STEP + STEP
        codes = np.full(size, PAD, np.int16)
        codes[: len(raw)] = np.frombuffer(raw, np.uint8)[:size]
        pooled = np.empty((segments, self.bias.size), np.float32)
        for at in range(0, segments, block):
            to = min(segments, at + block)
            x = self.embed[codes[at * SEGMENT * STEP : to * SEGMENT * STEP + STEP]].reshape(-1, self.first.shape[0])
            response = x[:-1] @ self.first
            response += x[1:] @ self.second
            pooled[at:to] = response.reshape(-1, SEGMENT, self.bias.size).max(1)
        windows = np.lib.stride_tricks.sliding_window_view(pooled, CHUNK, 0)[:: CHUNK - OVERLAP]
        return np.maximum(windows.max(2) + self.bias, 0)

    def score(self, raw: bytes) -> float:
        pools = self.chunk_pools(raw)
        z = float(np.concatenate([pools.max(0), pools.mean(0)]) @ self.dense) + self.offset
        return 1 / (1 + np.exp(-z))


def _adam(params: dict[str, np.ndarray], grads: dict[str, np.ndarray], state: dict, rate: float) -> None:
    state["t"] = t = state.get("t", 0) + 1
    for name, g in grads.items():
        m, v = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        state[name] = (m, v)
        params[name] = (params[name] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def train_net(chunks: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 42) -> ByteNet:
    """Fit the network to ``chunks`` (byte codes, one row each, ``CHUNK_BYTES + STEP`` long) of documents ``owner`` (ascending) with labels ``y``."""
    net = ByteNet.start(seed=seed)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    p = {"embed": net.embed, "first": net.first, "second": net.second, "bias": net.bias, "dense": net.dense, "offset": np.array([np.log(share / (1 - share))], np.float32)}
    r, state = np.random.default_rng(seed), {}
    begin = np.searchsorted(owner, np.arange(len(y) + 1))
    filters, dims = net.bias.size, net.embed.shape[1]
    steps = epochs * -(-len(y) // batch)
    done = 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for docs in np.array_split(order, -(-len(y) // batch)):
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            sizes = begin[docs + 1] - begin[docs]
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            codes = chunks[rows]
            x = p["embed"][codes].reshape(len(rows), -1, STEP * dims)
            z = x[:, :-1] @ p["first"] + x[:, 1:] @ p["second"]
            at = z.argmax(1)
            pool = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + p["bias"], 0)
            top, mean = np.maximum.reduceat(pool, heads), np.add.reduceat(pool, heads) / sizes[:, None]
            logit = np.concatenate([top, mean], 1) @ p["dense"] + p["offset"]
            error = ((1 / (1 + np.exp(-logit)) - y[docs]) / len(docs)).astype(np.float32)
            spread = np.repeat(np.arange(len(docs)), sizes)
            is_top = pool == top[spread]
            is_top = is_top / np.add.reduceat(is_top, heads)[spread]
            g = error[spread, None] * (is_top * p["dense"][:filters] + p["dense"][filters:] / sizes[spread, None]) * (pool > 0)
            lead = np.arange(len(rows))[:, None]
            left, right = x[lead, at], x[lead, at + 1]
            grads = {
                "dense": np.concatenate([top, mean], 1).T @ error + 1e-4 * p["dense"],
                "offset": np.array([error.sum()]),
                "bias": g.sum(0),
                "first": np.einsum("cf,cfk->kf", g, left),
                "second": np.einsum("cf,cfk->kf", g, right),
            }
            grid = codes.reshape(len(rows), -1, STEP)
            embed = np.zeros_like(p["embed"])
            for part, shift in (("first", 0), ("second", 1)):
                own = grid[lead, at + shift].reshape(-1)
                flow = (g[:, :, None] * p[part].T[None]).reshape(-1, dims)
                for d in range(dims):
                    embed[:, d] += np.bincount(own, flow[:, d], 257)
            embed[PAD] = 0
            grads["embed"] = embed
            _adam(p, grads, state, rate * (1 - done / steps))
            done += 1
    return ByteNet(p["embed"], p["first"], p["second"], p["bias"], p["dense"], float(p["offset"][0]))


def _chunks(raw: bytes) -> list[bytes]:
    return [raw[s : s + CHUNK_BYTES + STEP] for s in chunk_starts(len(raw)).tolist()]


def train_quality_net(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_bytes: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality"
) -> ByteNet:
    """Fit on all chunks of at most ``sample_rows`` labelled documents of ``sample_bytes`` together, all outside the held-out fold.

    Rows are taken whole, in the order of their ids' digests, as long as they fit (the first one always). Executors cut the
    chunks, which overlap. Without two classes the network scores every text with the labels' mean (1 without labels).
    """
    sample = labelled_sample(docs, labels, label, sample_rows, id_col, text_col).select("id", "label", "text")
    order = Window.orderBy(F.md5(F.col("id").cast("string")), "id", "text")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = sample.withColumn("_before", before).where(F.col("_before") + F.when(F.col("_before") > 0, F.octet_length("text")).otherwise(0) <= sample_bytes).drop("_before")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_chunks(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.list_(pa.binary()))], ["id", "label", "chunks"])

    schema = f"id {sample.schema['id'].dataType.simpleString()}, label int, chunks array<binary>"
    rows = sample.mapInArrow(cut, schema).groupBy("id").agg(F.min_by(F.struct("label", "chunks"), "chunks").alias("r")).orderBy("id").select("r.*").collect()
    y = np.array([float(r["label"] > 0) for r in rows])
    if len(set(y)) < 2:
        net = ByteNet.start()
        net.offset = 30.0 if not len(y) or y[0] else -30.0
        return net
    codes = np.full((sum(len(r["chunks"]) for r in rows), CHUNK_BYTES + STEP), PAD, np.int16)
    owner, at = np.empty(len(codes), np.int64), 0
    for d, r in enumerate(rows):
        for chunk in r["chunks"]:
            codes[at, : len(chunk)] = np.frombuffer(chunk, np.uint8)
            owner[at] = d
            at += 1
    return train_net(codes, owner, y)


def quality_scores(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_col, held_out, score, predicted`` for each row: every chunk of the whole text counts.

    A null text counts as empty and is scored as one chunk of padding; a null id is hashed
    as ''; repeated rows are scored each; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), fold(F.col(id_col)).alias("fold"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([net.score((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fold"), pa.array(score)], ["id", "fold", "score"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fold int, score double")
    return scored.select(F.col("id").alias(id_col), (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
