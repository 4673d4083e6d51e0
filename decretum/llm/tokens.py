"""Token ids of texts by a public byte-level BPE file, unit by unit with a bounded memory."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

#: Fixed value: the pattern by which the vocabulary's texts are split before merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single space between two characters that are not white space always starts a new token.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Below this, letters and digits mean the same to all libraries that split texts.
LATIN = "ɐ"


class _Kept(dict):
    """Values of ``make``, kept for the first ``limit`` keys."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


#: A piece that stands for one byte.
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[int, int]:
    """The character that shows each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


class ByteEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The strings of added tokens give those tokens, as the tokenizer's file says.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.split = regex.compile(SPLIT)
        self.words = _Kept(self._word, limit)
        self.units = _Kept(self._inner, limit)

    def _word(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if unit.isascii() or max(unit) < LATIN:
            return b"".join([self.words[w] for w in self.split.findall(unit)])
        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()

    def _inner(self, piece: str) -> bytes | None:
        """Ids of a piece after a space; None if white space at its ends could join with what stands beside it."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self._unit(" " + piece)

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join([self.added.get(part) or self._text(part) for part in self.between.split(text)])
        return self._text(text)

    def _text(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            found = [self.units[p] for p in rest]
            if None not in found:
                return self._unit(first) + b"".join(found)
        first, *rest = CUT.split(text)
        return self._unit(first) + b"".join([self._unit(" " + p) for p in rest])


class BothEncoder:
    """Ids of texts after a space by a byte-level BPE file and by a piece model, special tokens' strings as plain text.

    The first one's merges are in the order of their ids, which ``tiktoken`` runs on without Python's help.
    """

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)
        added = {t["content"] for t in vocabulary["added_tokens"]}
        back = {chr(shown): b for b, shown in byte_letters().items()}
        entries = {i: e for e, i in vocabulary["model"]["vocab"].items()} | {t["id"]: t["content"] for t in vocabulary["added_tokens"]}
        self.bytes_a = [e.encode() if (e := entries.get(i, "")) in added else bytes(back[c] for c in e) for i in range(max(entries) + 1)]
        ranks = {spelled: i for i, spelled in enumerate(self.bytes_a) if spelled and entries[i] not in added}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("\u2581", " ").encode() for p in pieces]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a.encode_ordinary(" " + t) for t in texts], self.b.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def both_encoder(path_a: str, path_b: str) -> BothEncoder:
    """One encoder per worker process, as ``byte_encoder``."""
    return BothEncoder(path_a, path_b)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder per worker process; its memory goes on from task to task."""
    return ByteEncoder(path)
