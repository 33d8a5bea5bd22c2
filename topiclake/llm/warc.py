"""WARC archives with a Zstandard dictionary: written, and read back, one file at a time per task.

An archive begins with a skippable frame that holds the dictionary; a frame for each record follows,
so records can be read alone once the dictionary is known. The dictionary is built from a bounded
sample of the records that go into the archives. A payload is stored once: of the records with equal
payloads one is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.llm.sampling import least_rows
from topiclake.session import new_path, stage

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SAMPLE_RECORDS = 512
SAMPLE_BYTES = 32 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 1 << 30


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1 of binary values: ten digits of 40 bits are eight letters, four times."""
    hexed = F.sha1(payload)
    letters = []
    for part in range(4):
        bits = F.conv(F.substring(hexed, 10 * part + 1, 10), 16, 10).cast("long")
        for i in range(8):
            place = F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), place.cast("int"), F.lit(1)))
    return F.concat(*letters)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of too few samples the last bytes themselves, of none nothing."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def record(kind: str, page: str, url: str, digest: str, payload: bytes, length: int, date: str,
           refers: str = "", refers_url: str = "") -> bytes:
    """One record: its headers, the HTTP headers, and for responses the payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {length}\r\n\r\n"
    ).encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>",
            f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Date: {date}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def frames(file: io.RawIOBase, step: int = 1 << 20) -> Iterator[bytes]:
    """Contents of an archive's frames, with the dictionary of its first, skippable frame."""
    start = file.read(8)
    if not start:
        return
    dictionary, rest = b"", start
    magic, size = struct.unpack("<II", start)
    if magic == SKIPPABLE:
        dictionary, rest = file.read(size), b""
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while True:
        rest = rest or file.read(step)
        if not rest:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = file.read(step)
            if not rest:
                raise ValueError("the archive ends inside a frame")
        yield b"".join(parts)


def _one_line(url: str | None, page: str) -> str:
    if not url:
        return f"urn:page:{page}"
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)


def plan_records(pages: DataFrame, key: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """Rows to write: page, address, payload, digest, and the response that a revisit refers to."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).alias("_page"), F.col(url).alias("_url"), payload.alias("_payload")
    ).withColumn("_digest", base32_sha1(F.col("_payload")))
    first = (
        rows.groupBy("_digest")
        .agg(F.max(F.struct("_page", "_url")).alias("_r"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
        .select("_digest", F.col("_r._page").alias("_refers"), F.col("_r._url").alias("_refers_url"))
    )
    joined = rows.join(first, "_digest", "left")
    other = (
        F.col("_refers").isNotNull()
        & ~F.col("_page").eqNullSafe(F.col("_refers"))
        & (F.octet_length("_payload") >= least_bytes)
    )
    return joined.withColumn("_revisit", other)


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per page; returns the written table (archive, records, bytes).

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the greatest key is
    a response; repeated rows of the greatest key are all responses. Null payloads are empty, null
    keys are written as ``null`` and are the least, a null address is replaced by one made of the
    key. Each task writes archives of its own under names that no other attempt uses; only those in
    the returned table count, what a lost attempt left is never read.
    """
    spark = pages.sparkSession
    rows = plan_records(pages, key, url, html, least_bytes)
    bodies = pages.select(F.encode(F.col(html), "UTF-8").alias("p")).filter(F.octet_length("p") > 0)
    sample = least_rows(bodies, F.xxhash64("p"), SAMPLE_RECORDS)
    sample = sample.select(F.substring("p", 1, SAMPLE_BYTES).alias("p"))
    dictionary = build_dictionary(
        [
            record("response", "0", "http://host/", "A" * 32, bytes(r.p), len(r.p), date)
            for r in sorted(sample.collect())
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=6, dict_data=known)
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, path, count, size = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [path], "records": [count], "bytes": [size]})

        for batch in batches:
            for page, address, payload, digest, refers, refers_url, revisit in zip(
                *(batch.column(i).to_pylist() for i in range(7))
            ):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, count, size = files.open_output_stream(path, compression=None), 0, 0
                    if dictionary:
                        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                        size = 8 + len(dictionary)
                name = "null" if page is None else str(page)
                target = "null" if refers is None else str(refers)
                frame = writer.compress(
                    record(
                        "revisit" if revisit else "response", name, _one_line(address, name), digest,
                        payload, len(payload), date, target, _one_line(refers_url, target),
                    )
                )
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    chosen = rows.select("_page", "_url", "_payload", "_digest", "_refers", "_refers_url", "_revisit")
    return stage(chosen.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives: page, address, type, digest, sizes, and what they refer to.

    The digest and size of responses are taken from the payload that was read, and must be those of
    the record's headers; revisits have them in their headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(path, compression=None) as file:
                    for data in frames(file):
                        rows.append(_row(data))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [
            ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
        ]
    )
    paths = archives.select("archive")
    return paths.repartition(max(1, paths.count())).mapInArrow(
        run,
        "page string, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to string",
    )


def _id(value: str | None) -> str | None:
    name = value.removeprefix("<urn:page:").removesuffix(">") if value else None
    return None if name == "null" else name


def _row(data: bytes) -> dict:
    fields, block = parse(data)
    http, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), found) != (length, digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} was damaged")
    return {
        "page": _id(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
        "refers_to": _id(fields.get("WARC-Refers-To")),
    }


def archive_folder(df: DataFrame) -> str:
    """A fresh folder in the shared place that the session names."""
    return new_path(df.sparkSession, "warc")
