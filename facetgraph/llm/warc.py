"""WARC archives compressed with a Zstandard dictionary, written and read back.

A task writes one archive: the dictionary, built from the first records it archives (``SAMPLE`` bytes of them at
most), stands in a leading skippable frame; each record follows as a frame of its own. Files are written under a
name of the task attempt and renamed when whole, so a task that is run again leaves one archive. Payloads equal to
an earlier page's (by SHA-256, from ``least`` bytes) become revisit records that refer to the smallest page id.

Defined results: a null html is an empty payload; a null url has no target header; a page without id is a response
and no other page refers to it; of rows that share the smallest page id all are responses; extra columns are
ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mapped, salted_left_join, sliced, stored, texts_of, work_dir

# Fixed values of the file format.
SKIPPABLE = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100
SAMPLE = 2 << 20
DICT = 64 << 10
LEVEL = 3
PAGE = "urn:page:"


def file_system(uri: str):
    """Arrow file system and path of a URI; the same from the driver and every executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:/", uri) else (fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Headers and payload of a record; a payload that its digest doesn't fit is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    x = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(x["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n" or len(body) != int(x["Content-Length"]):
        raise ValueError("a record is cut short")
    http, _, payload = body.partition(b"\r\n\r\n")
    x["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if x["WARC-Type"] == "response" and (len(payload) != x["payload_bytes"] or "sha256:" + hashlib.sha256(payload).hexdigest() != x["WARC-Payload-Digest"]):
        raise ValueError(f"the payload of {x['WARC-Record-ID']} is not as archived")
    return x | {"payload": payload}


def dictionary(samples: list[bytes], size: int = DICT) -> bytes:
    """A trained dictionary, or the samples' end where there are too few to train on."""
    import zstandard

    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8, steps=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _dict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def frames(records: Iterator[bytes], sample: int = SAMPLE, level: int = LEVEL) -> Iterator[bytes]:
    """The archive's frames: dictionary, then one of each record."""
    import zstandard

    held, size, records = [], 0, iter(records)
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample:
            break
    if not held:
        return
    raw = dictionary([r[:65536] for r in held])
    yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    c = zstandard.ZstdCompressor(level=level, dict_data=_dict(raw), write_content_size=True, write_checksum=True)
    for r in held:
        yield c.compress(r)
    for r in records:
        yield c.compress(r)


def read_frames(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one frame at a time."""
    import zstandard

    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    d = zstandard.ZstdDecompressor(dict_data=_dict(stream.read(size)))
    left = b""
    while True:
        left = left or stream.read(block)
        if not left:
            return
        out, o = [], d.decompressobj()
        while not o.eof:
            if not left and not (left := stream.read(block)):
                raise ValueError("the archive is cut short")
            out.append(o.decompress(left))
            left = o.unused_data if o.eof else b""
        yield b"".join(out)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) with digest and refers_to; html passes one shuffle, dealt by digest and salt."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    first = p.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    p = salted_left_join(p, first, "digest", "page_id")
    later = (F.col("n") >= least) & (F.col("page_id") > F.col("first"))
    return p.select("page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes with_revisits' rows, an archive per partition, and returns their list: path, records, bytes."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        t, n = TaskContext.get(), [0]

        def rows():
            for b in sliced(batches, 256):
                c = {k: b.column(k).to_pylist() for k in ("page_id", "url", "digest", "refers_to")}
                for p, u, h, d, r in zip(c["page_id"], c["url"], texts_of(b.column("html")), c["digest"], c["refers_to"], strict=True):
                    n[0] += 1
                    yield record(p, u, h, d, r)

        made = frames(rows())
        first = next(made, None)
        if first is None:
            return
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name, part = f"{path}/part-{t.partitionId():06d}.warc.zst", f"{path}/.part-{t.partitionId():06d}-{t.taskAttemptId()}"
        size = 0
        with fs.open_output_stream(part, compression=None) as out:
            for x in (y for z in ([first], made) for y in z):
                size += len(x)
                out.write(x)
        fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{t.partitionId():06d}.warc.zst"], "records": pa.array(n, pa.int64()), "bytes": pa.array([size], pa.int64())})

    return stored(mapped(records, run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """A row per record of the archives listed by ``path``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = file_system(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    number = lambda s: int(s) if (s := s[1 + len(PAGE) : -1]) != "null" else None
                    slim = ((number(x["WARC-Record-ID"]), x["payload_bytes"], x["WARC-Payload-Digest"].removeprefix("sha256:"), x["WARC-Type"], number(x["WARC-Refers-To"]) if "WARC-Refers-To" in x else None) for x in map(parsed, read_frames(f)))
                    while rows := list(islice(slim, 4096)):
                        a, n, d, k, r = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict({"page_id": pa.array(a, pa.int64()), "payload_bytes": pa.array(n, pa.int64()), "payload_digest": d, "record_type": k, "refers_to": pa.array(r, pa.int64())})

    n = max(1, archives.count())
    return mapped(archives.select("path").repartition(n), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to archives under folder (the shared one by default) and reads them back."""
    return read(write(with_revisits(pages), folder or f"{work_dir(spark)}/warc"))
