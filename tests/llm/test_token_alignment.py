"""Alignment of two tokenizers against loops over fresh tokenizers."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from test_operators import DOCS, EDGE
from tokenizers import Tokenizer

from decretum.llm import queries, token_alignment
from decretum.llm.queries import tokenizer_path
from decretum.llm.token_alignment import _parts, align_tokenizers, possible_pairs
from decretum.llm.tokens import both_encoder

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "a", " ", "  ", "a b", "a  b", " a", "a ", "it's\n\n we'll\tgo", "日本 語 と 한국어", "é ́ ﬁ ½", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ a", "x▁y",
    "nul \x00 \x1c \x85 end", "😀😀 👍🏽 ok", "A" * 300, "http://x.y/z?a=1&b=2", "　wide space", "pneumonoultramicroscopic", "0 00 000 0000", "ab" * 40,
]


def ends(pieces):
    at, out = 0, []
    for p in pieces:
        at += len(p)
        out.append(at)
    return out


def brute(rows):
    tok, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs, counts = [], collections.Counter()
    for i, text in rows:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        spelled_a = [bytes(letters[c] for c in tok.id_to_token(x)) for x in a]
        names = [sp.id_to_piece(x) for x in b]
        spelled_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            docs.append((i, [], [], [], ""))
            continue
        end_a, end_b = ends(spelled_a), ends(spelled_b)
        of_b = dict(zip(end_b, b, strict=True))
        links = [(x, of_b[e]) for x, e in zip(a, end_a, strict=True) if e in of_b]
        common = set(end_a) & set(end_b)
        sides = []
        for ids, at in ((a, end_a), (b, end_b)):
            sides.append([[]])
            for x, e in zip(ids, at, strict=True):
                sides[-1][-1].append(str(x))
                if e in common:
                    sides[-1].append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)][:-1]
        counts.update(links)
        docs.append((i, a, b, links, ";".join(groups)))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = collections.Counter()
    for i, a, b, links, groups in docs:
        best = sum(counts[x] == most[x[1]] for x in links)
        out[i, len(a), len(b), groups.count(";") + 1 if a else 0, len(links), best, sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if a else ""] += 1
    return out


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("part", [1 << 19, 40])
def test_alignment_equals_brute_force(spark, monkeypatch, part):
    """Short and long texts, whole and in parts; workers are forked from this process with its part size."""
    monkeypatch.setattr(token_alignment, "PART", part)
    r = random.Random(5)
    rows = list(enumerate(TEXTS)) + [(i, t) for i, t, *_ in EDGE if t is None or len(t) < 1000]
    rows += [(100 + i, " ".join(r.choice(TEXTS[:20]) for _ in range(12))) for i in range(30)] + [(3, "a b")] * 3
    found = collections.Counter()
    for i, text in rows:  # in this process, where the part size holds
        if text:
            assert " ".join(_parts(text)) == text
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({c: F.lit("x") for c in ("id", "pairs", "n", "best", "groups")})
    found.update(tuple(x[n] for n in NAMES) for x in align_tokenizers(docs, A, B).collect())
    assert found == brute(rows)


def test_parts_of_one_text_add_up(monkeypatch):
    whole = token_alignment._align([" ".join(TEXTS[3:10]), TEXTS[12] + " a" * 50, " ".join(["word"] * 100)], A, B, True)
    monkeypatch.setattr(token_alignment, "PART", 16)
    cut = token_alignment._align([" ".join(TEXTS[3:10]), TEXTS[12] + " a" * 50, " ".join(["word"] * 100)], A, B, True)
    assert [(x[:3], x[3].tolist(), x[4]) for x in whole] == [(x[:3], x[3].tolist(), x[4]) for x in cut]
    assert whole[1][:3] == (0, 0, "")


def test_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    rows = align_tokenizers(docs, A, B, with_groups=True).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") and r.n_links == r.n_groups
    assert all((r.n_a, r.count_sum) == (0, 0) for r in rows if r.doc_id in (3, 4)) and {r.n_links for r in rows if r.doc_id in (6, 7)} != {0}
    empty = align_tokenizers(spark.createDataFrame([], DOCS), A, B)
    assert empty.count() == 0 and tuple(empty.columns) == NAMES


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_a_fresh_tokenizers(text):
    """Both sides give what the libraries give on their own."""
    texts = [text, f"{text} {text}", f"x {text}"]
    a, b = both_encoder(A, B).encode(texts)
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    assert a == [tok.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert b == SentencePieceProcessor(model_file=B).encode(texts)


def test_pairs_are_bounded_by_the_vocabularies(spark):
    sf = "/root/testdata/sf0.001"
    found = token_alignment.aligned(queries.table(spark, sf, "documents"), A, B)
    assert 0 < found.select(F.explode("pairs")).distinct().count() <= possible_pairs(A, B) < 10**6


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    found = collections.Counter(tuple(r[n] for n in NAMES) for r in queries.op13_cross_tokenizer_alignment(spark, sf).collect())
    assert found == brute(rows)
