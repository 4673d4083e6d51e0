"""Operators for training data on small tables: edge cases and brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from decretum.llm import simhash, substring_dedup
from decretum.llm.byte_net import chunk_starts, quality_scores, train_quality_net
from decretum.llm.components import connected_components
from decretum.llm.exact_dedup import exact_dedup
from decretum.llm.line_dedup import line_dedup
from decretum.llm.mixing import mix, mix_budgets, take_copies
from decretum.llm.packing import pack, plan, sequences
from decretum.llm.quality_rules import FEATURES, apply_rules, repeat_words, text_statistics, train_rules
from decretum.llm.queries import tokenizer_path
from decretum.llm.substring_dedup import remove_repeats
from decretum.llm.suffixes import permuted_common_prefixes, suffix_array
from decretum.llm.tokens import byte_encoder
from decretum.llm.toxicity import fit_linear, toxicity_scores, train_toxicity
from decretum.llm.trees import train_forest
from decretum.llm.warc import fetch_records, read_bundles, seek_table, warc_folder, write_bundles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGE = [
    (1, "a  b\tc", "en", "s1", 6),
    (2, "a b c", "en", "s1", 5),
    (2, "a b c", "en", "s1", 5),
    (3, None, "en", "s1", None),
    (4, "", None, None, 0),
    (5, "  ", "de", "s2", 2),
    (None, "a b c", None, "s2", 5),
    (None, None, None, None, None),
    (6, LONG, "en", "s2", len(LONG)),
    (7, LONG, "fr", None, len(LONG)),
    (8, "nul \x00 and é ́ 日本 <|endoftext|>", "xx", "s3", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark, docs, empty):
    rows = exact_dedup(docs.withColumn("kept", F.lit(1)).withColumn("sha", F.lit(2)).withColumn("_salt", F.lit(3))).collect()
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in EDGE:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    want = collections.Counter()
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        order = known + [None] * (len(ids) - len(known))
        for n, i in enumerate(order):
            want[(i, order[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, rows)) == want
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_with_a_hot_text(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}", "en", "s", 1) for i in range(3000)]
    found = exact_dedup(spark.createDataFrame(rows, DOCS)).where("group_size > 1").collect()
    assert len(found) == 1000 and {r.keep_id for r in found} == {0} and [r.doc_id for r in found if r.kept] == [0]


def test_line_dedup(spark, docs, empty):
    pages = [(i, f"head\nline {i}\n\nfoot {i % 2}", "en", "s" if i < 20 else None, 9) for i in range(22)]
    found = {r.doc_id: r for r in line_dedup(spark.createDataFrame(pages, DOCS).withColumn("n_lines", F.lit("x")), ratio=0.6).collect()}
    assert found[3].text == "line 3\n\nfoot 1" and (found[3].n_lines, found[3].n_lines_removed) == (4, 1)
    assert found[20].text == pages[20][1]  # two pages without a site are fewer than min_pages
    edge = line_dedup(docs, ratio=0.1, min_pages=1).collect()
    assert len(edge) == len(EDGE)
    assert [(r.n_lines, r.text) for r in edge if r.doc_id == 3] == [(0, None)]
    assert [(r.n_lines, r.text) for r in edge if r.doc_id == 4] == [(1, "")]
    assert [r.text for r in edge if r.doc_id == 1] == [""]
    assert line_dedup(empty).count() == 0


def test_mix(spark, docs, empty):
    leaves = [("a", "en", "x", 100), ("a", "en", "y", 10), ("a", "de", "z", 10), ("b", "en", "x", 1000)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mix_budgets(frame, {"domain": {"a": 1, "b": 1}, "lang": {}, "source": {}}, 200, 1).collect()}
    # a's half is 100: de can give 10, so en gives 90, of which y 10
    assert got == {("a", "de", "z"): 10, ("a", "en", "x"): 80, ("a", "en", "y"): 10, ("b", "en", "x"): 100}
    short = {(r.domain, r.lang, r.source): r.budget for r in mix_budgets(frame, {}, 400, 1).collect()}
    assert sum(short.values()) == 400 and short[("b", "en", "x")] == 280  # a's 120 do not fill its half
    mixed = mix(docs.withColumn("mix_copies", F.lit("old")), {}, None, 2, 1, F.lit("d"))
    rows = mixed.collect()
    assert len(rows) == len(EDGE) and sum(r.mix_tokens * r.mix_copies for r in rows) <= sum(r.mix_tokens for r in rows)
    copies = take_copies(mixed)
    assert copies.columns == docs.columns and copies.count() == sum(r.mix_copies for r in rows)
    assert mix(empty, {}).count() == 0


def test_mix_takes_a_prefix(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "en", "s", 1) for i in range(500)]
    found = mix(spark.createDataFrame(rows, DOCS), {}, 700, 3, 5).collect()
    order = sorted(found, key=lambda r: hashlib.md5(f"5:0:{r.doc_id}".encode()).hexdigest())
    total, taken = 0, []
    for r in order:
        total += r.mix_tokens
        taken.append(int(total <= 700))
    assert [r.mix_copies for r in order] == taken


def brute_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 16, 100, 1024])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 300))]
    rows, filled = plan(collections.Counter(lengths).items(), capacity), collections.defaultdict(list)
    for n, count in collections.Counter(lengths).items():
        own = rows[rows[:, 0] == n]
        own = own[np.argsort(own[:, 1])]
        for k in range(count):
            _, first, base, each, offset = own[np.searchsorted(own[:, 1], k, "right") - 1]
            filled[base + (k - first) // each].append((offset + (k - first) % each * n, n))
    for items in filled.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(filled) == brute_bins(lengths, capacity)


def test_pack(spark, docs, empty):
    encoder = Tokenizer.from_file(tokenizer_path())
    pieces = pack(docs, tokenizer_path(), capacity=64, with_ids=True)
    rows = pieces.collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
    for doc_id, text, *_ in EDGE:
        if doc_id not in (2, None):
            own = sorted(by_doc[doc_id], key=lambda r: r.piece)
            ids = [i for r in own for i in r.ids]
            assert ids == [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and all(r.length == 64 for r in own[1:])
    assert len(by_doc[2]) == 2 and len(by_doc[None]) == 2
    whole = {r.sequence_id: len(r.ids) for r in sequences(pieces).collect()}
    assert sum(whole.values()) == sum(r.length for r in rows) and max(whole.values()) <= 64
    assert len(whole) == brute_bins([r.length for r in rows], 64)
    assert pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize(
    "text",
    ["", " ", "  a", "a  b", "a \n b ", "it's we'll  don't", "日本 語 a", "<|endoftext|> x", "a\x1cb c", "\x85 a", "½ ⅷ x²", "a <|endoftext|> b", "<|endoftext|>",
     "x<|endoftext|><|endoftext|>  y \n", "<|endoftext", "a <|endoftext|>"],
)
def test_token_ids_equal_a_fresh_tokenizers(text):
    fresh = Tokenizer.from_file(tokenizer_path())
    assert np.frombuffer(byte_encoder(tokenizer_path()).encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_text_statistics():
    r = random.Random(3)
    for _ in range(200):
        words = [r.choice("ab") * r.randint(1, 2) for _ in range(r.randint(0, 60))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
        assert repeat_words([w.encode() for w in words]) == len(covered)
    counts, _ = text_statistics("é#  <b>\n\nx y\nx y\n x y")
    assert counts == [8, 11, 3, 1, 0]


def test_forest_is_monotone():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + r.normal(0, 0.2, 2000) < 0.5).astype(float)
    forest = train_forest(x, y, np.array([-1, 0, 0]), rounds=30)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    for row in x[:50]:
        line = np.repeat(row[None], 40, 0)
        line[:, 0] = np.linspace(0, 1, 40)
        assert (np.diff(forest.score(line)) <= 1e-12).all()


def labelled(spark, label):
    r, rows, marks = random.Random(1), [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [r.choice(["river", "stone", "light", "walks", "under"]) + str(r.randint(0, 9)) for _ in range(40)]
        if bad:
            words = [w + "###" for w in words] if label == "quality" else [*words, "idiot,"]
        rows.append((i, " ".join(words), "en", "s", 1))
        marks.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_rules(spark, docs, empty):
    train, labels = labelled(spark, "quality")
    forest = train_rules(train, labels)
    kept = {r.doc_id: r.kept for r in apply_rules(train.withColumn("kept", F.lit("x")), forest).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in kept)
    edge = apply_rules(docs, forest)
    rows = edge.collect()
    assert len(rows) == len(EDGE) and all(r.base_failed and not r.kept for r in rows if r.text is None or len(r.text) < 40)
    assert [r.n_words for r in rows if r.doc_id == 6] == [30_000]
    assert train_rules(empty, labels) is None and apply_rules(empty, None).count() == 0
    assert len(FEATURES) == forest.feature.max() + 1 or forest.feature.max() < len(FEATURES)


def test_quality_classifier(spark, docs, empty):
    train, labels = labelled(spark, "quality")
    rows = quality_scores(train, train_quality_net(train, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.9 * len(held)
    edge = quality_scores(docs.withColumn("score", F.lit("x")), train_quality_net(docs, labels)).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    assert quality_scores(empty, train_quality_net(empty, labels)).count() == 0


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 512, 513, 960, 961, 5000):
        starts = chunk_starts(n)
        assert starts[0] == 0 and starts[-1] + 512 >= n and (np.diff(starts) == 448).all()


def test_toxicity(spark, docs, empty):
    train, labels = labelled(spark, "toxic")
    chain = train_toxicity(train, labels)
    assert chain.names == ("insult", "contempt", "toxic") and [len(w) for w in chain.weights] == [len(chain.vocabulary) + k for k in range(3)]
    rows = toxicity_scores(train, chain).collect()
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in rows)
    edge = toxicity_scores(docs.withColumn("toxic", F.lit("x")), chain).collect()
    assert len(edge) == len(EDGE) and not any(r.toxic for r in edge)
    assert toxicity_scores(empty, train_toxicity(empty, labels)).count() == 0
    x = np.random.default_rng(0).random((500, 2))
    w, _ = fit_linear(x, (x[:, 0] > x[:, 1]).astype(float))
    assert w[0] > 1 and w[1] < -1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (2, None, "x"), (3, "http://a/\r\nX: y", None), (None, "u", ""), (None, None, None), (7, "v", "é" * 90_000)]
    index = write_bundles(pages(spark, rows).withColumn("record_type", F.lit(1)), warc_folder(spark), frame_bytes=100)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_bundles(index).collect())
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, "x", "revisit", 2), (2, "x", "response", None), (2, "x", "revisit", 2), (3, "", "response", None), (None, "", "revisit", 3), (None, "", "revisit", 3), (7, "é" * 90_000, "response", None)]
    assert got == collections.Counter((p, len(s.encode()), digest(s), kind, to) for p, s, kind, to in want)
    back = {r.page_id: bytes(r.payload) for r in fetch_records(index.where("page_id IN (2, 7)")).where("record_type = 'response'").collect()}
    assert back == {2: b"x", 7: ("é" * 90_000).encode()}
    first = index.orderBy("bundle").first().bundle
    import pyarrow as pa
    import zstandard

    fs, path = pa.fs.FileSystem.from_uri(first)
    with fs.open_input_file(path) as file:
        table, data = seek_table(file), fs.open_input_file(path).read()
    plain = b"".join(zstandard.ZstdDecompressor().decompress(data[s : s + n]) for s, n, p in table if p)
    assert sum(p for *_, p in table) == len(plain) and plain.startswith(b"WARC/1.1\r\n")
    assert write_bundles(pages(spark, []), warc_folder(spark)).count() == 0


def test_warc_min_bytes_and_hot_payload(spark):
    rows = [(i, "u", "same") for i in range(600)] + [(1000 + i, "u", f"p{i}") for i in range(900)]
    found = read_bundles(write_bundles(pages(spark, rows), warc_folder(spark))).collect()
    same = [r for r in found if r.page_id < 600]
    assert [r.page_id for r in same if r.record_type == "response"] == [599] and {r.refers_to for r in same} == {599, None} and len(found) == 1500
    assert {r.record_type for r in read_bundles(write_bundles(pages(spark, rows[:9]), warc_folder(spark), min_revisit_bytes=5)).collect()} == {"response"}


@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_array(monkeypatch, small):
    monkeypatch.setattr("decretum.llm.suffixes.SMALL_ALPHABET", small)
    r = np.random.default_rng(5)
    for t in range(120):
        codes = r.integers(0, int(r.integers(1, 6)), int(r.integers(1, 100)))
        codes = np.tile(codes[:7], 15) if t % 5 == 0 else codes
        text = codes.tolist()
        sa = suffix_array(codes)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = [0] * len(text)
        for a, b in zip(sa, sa[1:], strict=False):
            while max(a, b) + common[b] < len(text) and text[a + common[b]] == text[b + common[b]]:
                common[b] += 1
        assert permuted_common_prefixes(codes, sa).tolist() == common


def brute_repeats(texts, window):
    count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        rest = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 1])
def test_remove_repeats(spark, docs, empty, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    r, words = random.Random(7), [f"w{i}é" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) for _ in range(40)]
    texts += [t + passage[i * 3 :] + t[::-1] for i, t in enumerate(texts[:15])] + ["ab" * 150, "c" * 3000, texts[3], texts[3], "", "c" * 49]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {row[0]: tuple(row[1:]) for row in remove_repeats(frame.withColumn("raw", F.lit(1)).withColumn("k", F.lit(1)), window=50).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 50)
    edge = remove_repeats(docs, with_text=True).collect()
    want = brute_repeats([(t or "").encode() for _, t, *_ in EDGE if t is None or len(t) < 1000], 400)
    assert collections.Counter(tuple(e[1:5]) for e in edge if e.n_bytes < 1000) == collections.Counter(want)
    assert {(e.n_bytes, e.n_removed, e.n_spans) for e in edge if e.doc_id in (6, 7)} == {(len(LONG), len(LONG), 1)}
    assert remove_repeats(empty).count() == 0


def brute_fingerprint(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    out = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = out[i], out[j]
                out = [min(a, b) if c in (a, b) else c for c in out]
    return out


def test_simhash_components(spark, docs, empty):
    r, words = random.Random(2), [f"Wort{i}" for i in range(50)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(150)]
    long = [" ".join(r.choice(words) for _ in range(400)) for _ in range(4)]
    texts += long + [t + " end" for t in long] + ["", "ONE Two", "one two"]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {row.doc_id: row for row in simhash.simhash_components(frame.withColumn("fp", F.lit(1))).collect()}
    prints = [brute_fingerprint(t, 3) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints and all(len(g.fingerprint) == 16 for g in got.values())
    comps = brute_components(prints)
    least = {c: min(i for i in range(len(texts)) if comps[i] == c) for c in set(comps)}
    assert [got[i].component_id for i in range(len(texts))] == [least[c] for c in comps]
    edge = simhash.simhash_components(docs).collect()
    assert len(edge) == len(EDGE) and {row.component_id for row in edge if int(row.fingerprint, 16) == 0} == {3}
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_near_links_join_all_close_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r, prints = random.Random(4), set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(30):
            prints.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    groups = collections.defaultdict(set)
    for row in connected_components(simhash.near_links(frame)).collect():
        groups[row.root].add(row.node & (2**64 - 1))
    want = collections.defaultdict(set)
    for p, c in zip(prints, brute_components(prints), strict=True):
        want[c].add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5), (None, 3), (7, None)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).groupBy("root").count().collect()
    assert sorted(r["count"] for r in found) == [50, 201]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
