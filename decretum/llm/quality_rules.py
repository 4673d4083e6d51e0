"""Quality rules: document statistics and a gradient-boosted verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import labelled_sample
from decretum.llm.trees import Forest, train_forest

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and the way the score may go as each one grows.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "pipe_share": -1,
    "distinct_share": 0,
    "top_word_share": 0,
    "same_next_share": -1,
    "letter_share": 0,
}
WINDOW = 8

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, list(b" \t\n\x0b\x0c\r"))
_TAIL = (_BYTES & 0xC0) == 0x80
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC0)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = np.isin(_BYTES, list(b"!?.,;:"))


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text has twice or more, the first one included.

    Equal windows have equal digests, so a text without equal digests has none; else
    windows are numbered exactly, by pairs of halves.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    digests = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = digests[:n].copy()
    for k in range(1, size):
        window *= np.uint64(0x9E3779B97F4A7C15)
        window += digests[k : n + k]
    window.sort()
    if not (window[1:] == window[:-1]).any():
        return 0
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    step = 1
    while step < size:
        number = np.unique(number[:-step] * (number.max() + 1) + number[step:], return_inverse=True)[1]
        step *= 2
    repeated = np.flatnonzero(np.bincount(number)[number] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + size, -1)
    return int((change.cumsum() > 0).sum())


def text_statistics(text: str) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``FEATURES`` of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars, symbols = int(seen[~_TAIL].sum() - seen[_SPACE].sum()), int(seen[_SYMBOL].sum())
    lines, n_lines, dup_lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            dup_lines += line in lines
            lines.add(line)
    repeats, n = repeat_words(words), len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    per, total = max(n, 1), max(chars, 1)
    letters = seen[_LETTER].sum()
    features = [
        np.log1p(n), chars / per, symbols / total, dup_lines / max(n_lines, 1), repeats / per, seen[_UPPER].sum() / max(letters, 1),
        seen[_DIGIT].sum() / total, seen[_MARK].sum() / per, seen[ord("|")] / per, len(counts) / per, max(counts.values(), default=0) / per,
        same / per, letters / total,
    ]
    return [n, chars, symbols, dup_lines, repeats], features


def _statistics(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    found = [text_statistics(t.as_py() or "") for t in batch.column(text_col)]
    counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([f for _, f in found], np.float64).reshape(-1, len(FEATURES))


def train_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Forest | None:
    """Trees fitted on at most ``sample_rows`` labelled documents; None where there are fewer than two classes."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _statistics(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    sample = labelled_sample(docs, labels, label, sample_rows, id_col, text_col).select("id", "label", "text")
    schema = f"id {sample.schema['id'].dataType.simpleString()}, label int, x array<double>"
    rows = sample.mapInArrow(features, schema).groupBy("id").agg(F.min_by(F.struct("label", "x"), "x").alias("r")).orderBy("id").select("r.*").collect()
    y = np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    return train_forest(np.array([r["x"] for r in rows]), y, np.array(list(FEATURES.values())))


def apply_rules(
    docs: DataFrame, forest: Forest | None, text_col: str = "text", threshold: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30
) -> DataFrame:
    """The documents with ``COUNTS``, ``base_failed``, ``quality_score`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent``
    of the words in repeated windows. Others are kept at a score of ``threshold`` or
    more; without trees all others are kept.

    A null text counts as empty and fails; an empty table gives an empty result;
    columns of the documents stay, except those named as the new ones.
    """
    names = [*COUNTS, "base_failed", "quality_score", "kept"]
    rest = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = _statistics(batch, text_col)
            score = forest.score(x) if forest else np.ones(len(x))
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
            new = [*[pa.array(c) for c in counts.T], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema], *[f"{c} long" for c in COUNTS]])
    return rest.mapInArrow(run, schema + ", base_failed boolean, quality_score double, kept boolean")
