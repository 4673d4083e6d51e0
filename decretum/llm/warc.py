"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decretum.llm.common import hot_keys, partitions, settle, shared_folder, with_salt

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_bytes int, record_start int, record_bytes int"
RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, content: str, nth: int) -> str:
    """A record's name, from its page, its content's digest and its number among equal pairs."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{content}|{nth}'.encode()).digest())}>"


def warc_record(fields: dict[str, str | None], payload: bytes | None, size: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [f"{k}: {v}" for k, v in {**fields, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}.items() if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, payload, start and end of each record in a decompressed frame."""
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:head].decode().split("\r\n")[1:])
        start, size = head + 4, int(fields["Content-Length"])
        block = data[start : start + size]
        yield fields, block[block.index(b"\r\n\r\n") + 4 :], at, start + size + 4
        at = start + size + 4


class BundleWriter:
    """One bundle: frames of whole records, an index of the records, and the seek table as footer."""

    def __init__(self, folder: str, name: str, frame_bytes: int):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.draft = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.uri = f"{folder.rstrip('/')}/{name}"
        self.out = self.fs.open_output_stream(self.draft)
        self.frame_bytes, self.size, self.frames = frame_bytes, 0, []
        self.records: list[tuple] = []
        self.held, self.held_bytes, self.lines = [], 0, []

    def add(self, name: str, page_id: int | None, data: bytes) -> None:
        self.held.append((name, page_id, self.held_bytes, len(data), data))
        self.held_bytes += len(data)
        if self.held_bytes >= self.frame_bytes:
            self._flush()

    def _write(self, data: bytes, plain: int) -> None:
        self.out.write(data)
        self.frames.append((len(data), plain))
        self.size += len(data)

    def _flush(self) -> None:
        if not self.held:
            return
        data = zstandard.ZstdCompressor(level=3).compress(b"".join([h[4] for h in self.held]))
        for name, page_id, start, length, _ in self.held:
            self.records.append((name, page_id, self.uri, len(self.frames), self.size, len(data), start, length))
            self.lines.append(f"{name}\t{len(self.frames)}\t{start}\t{length}\n")
        self._write(data, self.held_bytes)
        self.held, self.held_bytes = [], 0

    def close(self) -> list[tuple]:
        """Finish the file, give it its name, and return its index rows."""
        self._flush()
        index = zstandard.ZstdCompressor().compress("".join(self.lines).encode())
        self._write(struct.pack("<II", INDEX_FRAME, len(index)) + index, 0)
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()
        self.fs.move(self.draft, self.final)  # a task that is run again replaces the file with an equal one
        return self.records


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """``start, compressed bytes, plain bytes`` of each frame of an open bundle."""
    total = file.size()
    count, _, magic = struct.unpack("<IBI", file.read_at(9, total - 9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the file")
    entries = struct.unpack(f"<{2 * count}I", file.read_at(8 * count, total - 9 - 8 * count))
    out, at = [], 0
    for packed, plain in zip(entries[::2], entries[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27) -> DataFrame:
    """Write a record per row of ``page_id, url, html`` and return the index: record ids with frame-relative offsets.

    Payloads go once through a shuffle by their content digest, so copies meet in one
    task, largest page id first: it becomes the response, the others revisit it
    without a payload. A content with very many copies is dealt to salts by page id; its largest page
    id is then known from a count of digests, in a table of at most four rows per partition.

    A null html is an empty payload; a null page id sorts last and a response of one
    is referred to as null; of rows equal in page and payload one is the response; a
    null url leaves out its header; other columns are ignored; an empty table writes
    no bundle. Payloads under ``min_revisit_bytes`` are all responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("sha"),
        F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"),
    )
    hot = hot_keys(rows.select("sha", "page_id"), "sha", {"_winner": F.max("page_id")})
    salted = with_salt(rows, hot, "sha", F.xxhash64("page_id")).withColumn("hot", F.col("_salts").isNotNull() & (F.col("bytes") >= min_revisit_bytes))
    is_winner = F.col("page_id").eqNullSafe(F.col("_winner"))
    salted = salted.withColumn("html", F.when(~F.col("hot") | is_winner, F.col("html")))
    dealt = salted.select("page_id", "url", "html", "sha", "sha1", "bytes", "hot", "_winner", "_salt")
    dealt = dealt.repartition(partitions(pages.sparkSession), "sha", "_salt").sortWithinPartitions("sha", F.col("page_id").desc_nulls_last(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, None
        sha = first = None
        last, nth = None, 0

        def rows_of(records: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in records], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for r in batch.to_pylist():
                nth = nth + 1 if (r["sha"], r["page_id"]) == last else 0
                last = (r["sha"], r["page_id"])
                leads = r["sha"] != sha
                if leads:
                    sha, first = r["sha"], r["page_id"]
                target = r["_winner"] if r["hot"] else first
                response = r["bytes"] < min_revisit_bytes or (leads and r["page_id"] == target)
                name, refers = record_id(r["page_id"], sha, nth), None if response else target
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"]) if r["url"] is not None else None
                fields = {
                    "WARC-Type": "response" if response else "revisit", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": url,
                    "WARC-Payload-Digest": f"sha1:{base32_sha1(r['sha1'])}", "WARC-Refers-To": None if response else record_id(target, sha, 0),
                    "WARC-Profile": None if response else PROFILE, "X-Page-Id": None if r["page_id"] is None else str(r["page_id"]),
                    "X-Refers-To-Page": None if refers is None else str(refers),
                }
                if bundle is None:
                    bundle = BundleWriter(folder, f"part-{part:05d}-{number:04d}.warc.zst", frame_bytes)
                bundle.add(name, r["page_id"], warc_record(fields, r["html"].encode() if response else None, r["bytes"]))
                if bundle.size >= bundle_bytes:
                    yield rows_of(bundle.close())
                    bundle, number = None, number + 1
        if bundle is not None:
            yield rows_of(bundle.close())

    return settle(dealt.mapInArrow(run, INDEX))


def _row(fields: dict[str, str], payload: bytes, with_payload: bool) -> tuple:
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base32_sha1(hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return (
        fields["WARC-Record-ID"], page and int(page), fields.get("WARC-Target-URI"), kind, refers and int(refers),
        len(payload) if kind == "response" else None, digest, payload if with_payload and kind == "response" else None,
    )


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RECORDS.split(", ")])


def _http_length(block_head: bytes) -> int:
    return int(re.search(rb"Content-Length: (\d+)", block_head)[1])


def _frames(bundles: DataFrame) -> DataFrame:
    """``bundle, frame`` of all frames that hold records, from an index or from the bundles' seek tables."""
    named = bundles.where("bundle IS NOT NULL")
    if "frame" in bundles.columns:
        return named.select("bundle", "frame").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as file:
                    held = [i for i, (_, _, plain) in enumerate(seek_table(file)) if plain]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(held), pa.string()), pa.array(held, pa.int32())], ["bundle", "frame"])

    return named.select("bundle").distinct().mapInArrow(run, "bundle string, frame int")


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the bundles in column ``bundle``, each once.

    Frames, not files, are dealt to tasks, so a large bundle is read by many; a task holds one frame at a time. Responses are
    checked against their digests; a revisit's ``payload_bytes`` is the length its stored HTTP header names.
    Null bundles are left out, repeated ones are read once, an empty table gives an empty result; a bundle that
    is missing or damaged is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file, table = None, None, []
        for batch in batches:
            for uri, frame in zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                if uri != last:
                    if file is not None:
                        file.close()
                    fs, path = pa.fs.FileSystem.from_uri(uri)
                    last, file = uri, fs.open_input_file(path)
                    table = seek_table(file)
                start, packed, _ = table[frame]
                data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, start))
                rows = []
                for fields, payload, _, end in parse_records(data):
                    row = list(_row(fields, payload, with_payload))
                    if row[5] is None:
                        row[5] = _http_length(data[end - 4 - int(fields["Content-Length"]) : end])
                    rows.append(tuple(row))
                yield _record_batch(rows)
        if file is not None:
            file.close()

    # dealt without a key: a key's exchange would be dropped after the distinct, and its few rows merged into one task
    dealt = _frames(bundles).repartition(partitions(bundles.sparkSession)).sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(run, RECORDS)


def fetch_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows, each by one seek to its frame.

    Rows without a bundle are left out, repeated rows give their record again, an empty index gives an empty result;
    a bundle that is missing or damaged is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, data = [], None, b""
            for r in batch.to_pylist():
                if (r["bundle"], r["frame"]) != last:
                    fs, path = pa.fs.FileSystem.from_uri(r["bundle"])
                    with fs.open_input_file(path) as file:
                        start, packed, _ = seek_table(file)[r["frame"]]
                        data, last = zstandard.ZstdDecompressor().decompress(file.read_at(packed, start)), (r["bundle"], r["frame"])
                fields, payload, _, _ = next(parse_records(data, r["record_start"]))
                rows.append(_row(fields, payload, True))
            yield _record_batch(rows)

    return index.where("bundle IS NOT NULL").repartition(partitions(index.sparkSession), "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(run, RECORDS)


def warc_folder(spark: SparkSession) -> str:
    """A new folder for bundles under the shared one."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
