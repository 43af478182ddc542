"""WARC records in seekable Zstandard bundles, written by tasks and read back through their seek tables.

A bundle is a row of independent frames, each holding some whole records, and ends in a skippable
frame with the sizes of all frames (the public seekable format).  Next to the bundles stands an index:
record id, bundle, frame, and the record's place inside the uncompressed frame, so one record costs one
ranged read and the decoding of one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, scratch_path

# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX_TYPE = (
    "record_id string, page_id long, bundle string, frame int, frame_start long, frame_bytes long, "
    "record_start long, record_bytes long"
)
RECORD_TYPE = (
    "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary"
)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the response's HTTP head but no body."""
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base32(sha1_hex)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            head += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in an uncompressed frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(head["Content-Length"])
        yield head, raw[end + 4 : stop]
        at = stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing frame: (compressed, uncompressed) bytes of every frame before it."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed, uncompressed bytes) of each frame, from the end of an open bundle."""
    source.seek(source.size() - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 128 else 8
    source.seek(source.size() - 9 - width * count)
    raw, start, out = source.read(width * count), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, width * i)
        out.append((start, packed, plain))
        start += packed
    return out


class _Bundle:
    """An open bundle; it gets its name when it is whole, so a lost task leaves no bundle behind."""

    def __init__(self, folder: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        self.draft, self.final = f"{path}/{name}.draft", f"{path}/{name}.warc.zst"
        self.uri = f"{folder.rstrip('/')}/{name}.warc.zst"
        self.out, self.size = self.fs.open_output_stream(self.draft), 0
        self.sizes: list[tuple[int, int]] = []
        self.frame: list[bytes] = []
        self.pending: list[tuple] = []
        self.filled = 0
        self.index: list[tuple] = []

    def add(self, page_id, raw: bytes) -> None:
        self.pending.append((page_id, self.filled, len(raw)))
        self.frame.append(raw)
        self.filled += len(raw)
        if self.filled >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.frame:
            return
        data = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(self.frame))
        self.out.write(data)
        self.index += [
            (record_id(p), p, self.uri, len(self.sizes), self.size, len(data), at, n) for p, at, n in self.pending
        ]
        self.sizes.append((len(data), self.filled))
        self.size += len(data)
        self.frame, self.pending, self.filled = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        self.fs.move(self.draft, self.final)
        return self.index


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1, refers_to, revisit for each page.

    Of pages with equal payloads of at least `least_bytes` the one with the smallest page_id is the
    response.  A null html is an empty payload.  Rows without a page_id count as larger than any; where
    all have none, and where a row is repeated whole, each of them is a response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    facts = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    first = (
        facts.filter(F.octet_length("html") >= least_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first is not null")
        .select("sha1", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return facts.join(first, "sha1", "left").select(
        "page_id", "url", "html", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_bundles(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes every page as a record into bundles under `folder` and returns the index, as a written table."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, types = None, [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        names = [x.split()[0] for x in INDEX_TYPE.split(", ")]

        def rows(index: list[tuple]) -> pa.RecordBatch:
            columns = zip(*index, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for page, url, html, sha1, refers, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    bundle = bundle or _Bundle(folder)
                    bundle.add(page, record(page, url, html.encode(), sha1, refers, revisit))
                    if bundle.size >= BUNDLE_BYTES:
                        yield rows(bundle.close())
                        bundle = None
        if bundle:
            yield rows(bundle.close())

    return cut(with_originals(pages, least_bytes).mapInArrow(write, INDEX_TYPE))


def _rows(records: Iterator[tuple[dict[str, str], bytes]], with_payload: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    for head, block in records:
        revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size = int(head["X-Payload-Length"]) if revisit else len(payload)
        if not revisit and base32(hashlib.sha1(payload).hexdigest()) != digest:
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        page, refers = (int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
        kept = None if revisit or not with_payload else payload
        out.append(
            (head["WARC-Record-ID"], page, head.get("WARC-Target-URI"), head["WARC-Type"], refers, digest, size, kept)
        )
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*out, strict=True)) or [[]] * len(types)
    names = [x.split()[0] for x in RECORD_TYPE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_bundles(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles an index names, read frame by frame through each bundle's own seek table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    for start, packed, plain in read_seek_table(source):
                        source.seek(start)
                        raw = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)
                        yield _rows(parse(raw), with_payload)

    bundles = cut(index.select("bundle").distinct())
    return bundles.repartition(max(1, bundles.count())).mapInArrow(read, RECORD_TYPE)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in `wanted`: one ranged read and one frame decoded for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, packed, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    source.seek(start)
                    raw = zstandard.ZstdDecompressor().decompress(source.read(packed))
                yield _rows(parse(raw[at : at + n]), True)

    hits = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    places = hits.select("bundle", "frame_start", "frame_bytes", "record_start", "record_bytes")
    return places.mapInArrow(read, RECORD_TYPE)
