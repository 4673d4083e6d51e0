"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import labelled_sample, settle

WORDS = re.compile(rb"[a-z\x80-\xff]+")

# Words that tell kinds of toxic documents apart when links are trained; scoring does not look them up.
KINDS = {
    "insult": ("idiot", "moron", "clown", "loser", "scum", "fool", "jerk", "imbecile", "dunce", "creep", "pig", "rat"),
    "contempt": ("stupid", "pathetic", "worthless", "disgusting", "trash", "garbage", "useless", "dumb", "vile", "filthy"),
}


#: Lengths in bytes of the word beginnings that are features beside the words: inflected and compound forms share them.
BEGINNINGS = (4, 5, 6, 7, 8)


def text_features(text: str | None) -> set[bytes]:
    """Distinct words of a whole text, A-Z lower-cased, and their beginnings (marked by a star)."""
    words = set(WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower()))
    return words.union(*[{w[:n] + b"*" for w in words if len(w) >= n} for n in BEGINNINGS])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Chain:
    """Linear models in a row: each sees the features and the probabilities of all links before it."""

    names: tuple[str, ...]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]
    offsets: list[float]

    def matrix(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        known = self.vocabulary.keys()
        for i, text in enumerate(texts):
            for word in known & text_features(text):
                out[i, self.vocabulary[word]] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """``(rows, links)``."""
        earlier = np.zeros((len(x), 0))
        for w, b in zip(self.weights, self.offsets, strict=True):
            p = sigmoid(np.concatenate([x, earlier], 1) @ w + b)
            earlier = np.concatenate([earlier, p[:, None]], 1)
        return earlier


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; the offset is not penalised."""
    full = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(full.shape[1])
    share = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 0.5
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(full @ w)
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def train_chain(x: np.ndarray, y: np.ndarray, names: Sequence[str], vocabulary: Mapping[bytes, int], folds: int = 5) -> Chain:
    """Fit the links in order of the columns of ``y``.

    A link is trained on its predecessors' out-of-fold probabilities, as they are for
    texts those links have not seen; the link that stays is fitted on all rows.
    """
    part = np.arange(len(x)) % folds
    earlier, weights, offsets = np.zeros((len(x), 0)), [], []
    for j in range(y.shape[1]):
        full = np.concatenate([x, earlier], 1)
        w, b = fit_linear(full, y[:, j])
        weights.append(w)
        offsets.append(b)
        unseen = np.empty(len(x))
        for k in range(folds):
            own_w, own_b = fit_linear(full[part != k], y[part != k, j])
            unseen[part == k] = sigmoid(full[part == k] @ own_w + own_b)
        earlier = np.concatenate([earlier, unseen[:, None]], 1)
    return Chain(tuple(names), dict(vocabulary), weights, offsets)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    kinds: Mapping[str, Sequence[str]] | None = None,
    sample_rows: int = 12_000,
    vocabulary_size: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
) -> Chain:
    """Chain of one link per kind (toxic documents with one of its words) and a last one for ``label``.

    Fitted on at most ``sample_rows`` labelled documents outside the held-out fold. Its
    features are the ``vocabulary_size`` words and beginnings of the sample whose presence
    differs most between the classes (chi-squared, in five documents or more).
    """
    kinds = kinds if kinds is not None else KINDS
    lists = {k: {w.encode() for w in v} for k, v in kinds.items()}
    sample = labelled_sample(docs, labels, label, sample_rows, id_col, text_col).select("id", "label", "text")
    key = f"id {sample.schema['id'].dataType.simpleString()}, label int"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(text_features(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.list_(pa.binary()))], ["id", "label", "words"])

    held = settle(sample.mapInArrow(words, f"{key}, words array<binary>").groupBy("id").agg(F.min_by(F.struct("label", "words"), "words").alias("r")).select("id", "r.*"))
    n, n1 = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = held.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("c1")).where("c >= 5")
    gap = F.col("c1") * F.lit(float(n)) - F.col("c") * F.lit(float(n1))
    chi = gap * gap / (F.col("c") * (F.lit(float(n) + 1) - F.col("c")))
    top = [bytes(r["word"]) for r in counts.orderBy(chi.desc(), "word").limit(vocabulary_size).collect()]
    vocabulary = {w: i for i, w in enumerate(top)}
    names = [*kinds, label]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set(w) for w in batch.column("words").to_pylist()]
            y = batch.column("label").to_pylist()
            own = [[int(bool(v and f & s)) for s in lists.values()] + [v] for f, v in zip(found, y, strict=True)]
            cols = [sorted(vocabulary[w] for w in vocabulary.keys() & f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(cols, pa.list_(pa.int32())), batch.column("id")], ["y", "cols", "id"])

    rows = held.mapInArrow(reduce, f"y array<int>, cols array<int>, {key.split(',')[0]}").orderBy(F.md5(F.col("id").cast("string"))).collect()
    x = np.zeros((len(rows), len(top)))
    for i, r in enumerate(rows):
        x[i, r["cols"]] = 1
    y = np.array([r["y"] for r in rows], float).reshape(len(rows), len(names))
    return train_chain(x, y, names, vocabulary)


def toxicity_scores(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, a probability ``p_<name>`` per link, and ``toxic`` (the last one at ``threshold`` or more) for each row.

    The whole text counts. A null or empty text has no words and gets the links' offsets;
    repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                p = chain.probabilities(chain.matrix([t.as_py() for t in part.column("text")]))
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c) for c in p.T]], ["id", *names])

    scored = rows.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{n} double" for n in names]]))
    return scored.select(F.col("id").alias(id_col), *names, (F.col(names[-1]) >= threshold).alias("toxic"))
