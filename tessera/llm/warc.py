"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

`write` puts records into monolithic archives (one gzip stream a file). `normalise`
inflates each such file once, as a stream, rewrites every record as a gzip member of its
own and puts a sidecar index (offset, length, type, record id; one line a record) beside
it. `read` reads records back by that index. Files are written through pyarrow's file
systems into a folder that driver and executors share, under names that no other attempt
of the task uses; only files of attempts that Spark committed are listed.

Edge cases: a null payload is an empty one; a null URL leaves the target header out; a
null id leaves the record id's number empty and reads back as null; rows that repeat give
records each (of rows of equal payload and equal largest id, all are responses); an empty
table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, stash

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROTATE_BYTES = 32 << 20
STEP = 1 << 18
INDEXED = "archive string, records long"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None, is_revisit: bool) -> bytes:
    number = lambda x: "" if x is None else str(x)
    block = HTTP if is_revisit else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{number(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        lines += [f"WARC-Refers-To: <urn:page:{number(response)}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, response: of equal payloads of at least `least` bytes the largest page_id; null for others."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    copies = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    return rows.join(copies, "digest", "left").drop("digest")


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Monolithic archives of the pages (page_id, url, html); a table of their paths."""

    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        made: list[tuple[str, int]] = []
        out = packer = None
        size = count = 0

        def close() -> None:
            out.write(packer.flush())
            out.close()
            made[-1] = (made[-1][0], count)

        for batch in batches:
            for page_id, url, payload, response in zip(*(batch.column(x) for x in ("page_id", "url", "payload", "response")), strict=True):
                if out is None:
                    made.append((f"{folder}/{uuid.uuid4().hex}.warc.gz", 0))
                    out, packer, size, count = store.open_output_stream(f"{root}/{made[-1][0].rpartition('/')[2]}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                number, first = page_id.as_py(), response.as_py()
                data = record(number, url.as_py(), payload.as_py(), first, first is not None and number != first)
                out.write(packer.compress(data))
                size, count = size + len(data), count + 1
                if size >= ROTATE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["archive", "records"])

    return stash(with_revisits(pages, least).mapInArrow(dump, INDEXED), "warc-written")


def dealt(archives: DataFrame) -> DataFrame:
    """A task for each archive or a few; the plan's own coalescing would put such short rows into one task."""
    return archives.select("archive").repartition(max(1, min(archives.count(), 20_000)), "archive")


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(STEP):
        while data:
            if piece := unpack.decompress(data):
                yield piece
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers (names in lower case), block and raw bytes of each record of an inflated stream."""
    held = bytearray()
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(pieces, None)
            if piece is None:
                ended = True
            else:
                held.extend(piece)
        return len(held) >= n

    while True:
        fill(1)
        if not held:
            return
        seen = 0
        while (cut := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's header is cut off")
        names = (line.partition(":") for line in bytes(held[:cut]).decode("utf-8").split("\r\n")[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in names}
        n = int(headers["content-length"])
        if not fill(total := cut + 4 + n + 4):
            raise ValueError("a record's block is cut off")
        raw = bytes(held[:total])
        del held[:total]
        yield headers, raw[cut + 4 : cut + 4 + n], raw


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Archives (column archive) rewritten with a member for each record and an index beside; a table of the new paths."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_store, root = opened(folder)
        out_store.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name, offset, index = f"{uuid.uuid4().hex}.warc.gz", 0, []
                in_store, path = opened(source)
                with in_store.open_input_stream(path, compression=None) as stream, out_store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for headers, _, raw in split_records(inflated(stream)):
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        index.append(f"{offset} {len(member)} {headers.get('warc-type', '-')} {headers.get('warc-record-id', '-')}")
                        offset += len(member)
                with out_store.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
                    out.write(("\n".join(index) + "\n").encode())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"], pa.string()), pa.array([len(index)], pa.int64())], ["archive", "records"])

    return stash(dealt(archives).mapInArrow(rewrite, INDEXED), "warc-normalised")


def read(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each inflated from its own member by the sidecar index."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                store, path = opened(source)
                with store.open_input_stream(f"{path}.idx", compression=None) as f:
                    index = [x.split(" ") for x in f.read().decode().splitlines()]
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for offset, length, *_ in index:
                        f.seek(int(offset))
                        headers, block, _ = next(split_records(iter([zlib.decompress(f.read(int(length)), 31)])))
                        rows.append(parsed(headers, block))
                        held += len(block)
                        if held >= STEP * 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt(archives).mapInArrow(load, RECORD)


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(n) if (n := x.rpartition(":")[2].rstrip(">")) else None
    page_id, url, kind = number(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"]
    if kind == "revisit":
        return page_id, url, kind, None, int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"), number(headers["warc-refers-to"])
    payload = block.partition(b"\r\n\r\n")[2]
    if (digest := base32_sha1(payload)) != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"record {page_id}: the payload does not have the digest in its header")
    return page_id, url, kind, payload, len(payload), digest, None


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to monolithic archives, normalised, and read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(normalise(write(pages, f"{folder}/monolithic", least), f"{folder}/members"))
