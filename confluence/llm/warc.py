"""WARC archives in Zstandard frames, with a dictionary in a leading skippable frame.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame per
record.  The reader loads the dictionary, decodes frame by frame with bounded memory, and validates
each record's version line, headers, declared length, trailer and digest.

Archives are rows (archive, content), as ``spark.read.format("binaryFile")`` gives them, so they
live in any store that Spark reaches, and one archive holds at most ARCHIVE_BYTES of payload
(or one larger payload).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.common import written

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 16 << 10
#: Pages from which the dictionary is trained, and bytes of each: a bounded sample.
SAMPLE, SAMPLE_BYTES = 400, 8 << 10
ARCHIVE_BYTES = 4 << 20
#: Shorter payloads are always stored whole.
LEAST_REVISIT = 100
#: A payload that over a HEAVYth of all pages have is looked up in a broadcast of fewer than HEAVY rows.
HEAVY = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6f2d1e0a-5a36-4d0e-9f43-1b8f6f5f2a11")


class BadRecord(ValueError):
    """An archive or a record that isn't as its format says."""


def record_id(page_id) -> str:
    """A page's record id: its number is in the last group, so equal pages get equal ids in any run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page_id))}>"


def record(page_id, url: str | None, payload: bytes, digest: str, first=None, first_url=None) -> bytes:
    """One WARC/1.1 record; with ``first`` a revisit of that page's record, without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    clean = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Writer:
    """Builds one archive."""

    def __init__(self, dictionary: bytes):
        self.parts = [struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary]
        self.compressor = zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)

    def add(self, data: bytes) -> None:
        self.parts.append(self.compressor.compress(data))

    def content(self) -> bytes:
        return b"".join(self.parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-case names) and block; raises BadRecord unless all of it is sound."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not cut or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadRecord(f"no header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    if not headers["content-length"].isdigit():
        raise BadRecord("a content-length that is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"a block of {len(rest) - 4} bytes instead of {length}")
    return headers, rest[:length]


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    view, at, dictionary = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", view, 4)[0]
        if at > len(view):
            raise BadRecord("a dictionary frame beyond the end")
        data = bytes(view[8:at])
        if data[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=64 << 20)
        dictionary = zstandard.ZstdCompressionDict(data) if data else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        if struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        one = reader.decompressobj()
        parts = []
        while not one.eof:
            if at >= len(view):
                raise BadRecord("a frame beyond the end")
            chunk = view[at : at + (64 << 10)]
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def http_payload(block: bytes) -> tuple[int, bytes]:
    """The length that the HTTP header declares and the payload there is."""
    head, cut, payload = block.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        raise BadRecord("no HTTP header")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), payload
    return len(payload), payload


def dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary trained on at most SAMPLE pages of SAMPLE_BYTES bytes each; empty where they are too few."""
    some = pages.filter(F.length(html) > 200).select(F.substring(html, 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE).collect()
    samples = [r.html.encode() for r in some]
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, size, first): each page's payload digest, and the smallest page_id that
    has the payload, where it is long enough and other pages have it too."""
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    named = pages.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html")})
    long = F.col("size") >= LEAST_REVISIT
    firsts = (
        named.filter(long & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    firsts = written(firsts)
    # Short payloads, all empty ones among them, have no group, and payloads of over a HEAVYth of all pages (fewer than
    # HEAVY) look theirs up in a broadcast: neither is sent by its digest, so no digest fills a task of the other join.
    heavy = F.col("n") * HEAVY > pages.count()
    large, small = (firsts.filter(x).drop("n") for x in (heavy, ~heavy))
    common = named.filter(long).join(F.broadcast(large), "digest")
    others = named.filter(long).join(F.broadcast(large.select("digest")), "digest", "left_anti").join(small, "digest", "left")
    short = named.filter(~long).withColumn("first", F.lit(None).cast("long"))
    return short.unionByName(common).unionByName(others)


def archives(pages: DataFrame, **names: str) -> DataFrame:
    """(archive, content): all pages as archives; each task packs what it holds.

    A page whose own id is its digest's smallest is the response."""
    trained = dictionary(pages.select(F.col(names.get("html", "html")).cast("string").alias("html")))

    def run(source):
        task, writer, size, n = f"{TaskContext.get().partitionId():06d}", None, 0, 0
        for batch in source:
            for page_id, url, html, digest, first, fresh in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "fresh"))):
                payload = html.encode()
                if writer is not None and size + len(payload) > ARCHIVE_BYTES:
                    yield one(f"{task}-{n}.warc.zst", writer)
                    writer, size, n = None, 0, n + 1
                writer = writer or Writer(trained)
                writer.add(record(page_id, url, payload, digest, None if fresh else first))
                size += len(payload)
        if writer is not None:
            yield one(f"{task}-{n}.warc.zst", writer)

    def one(name, writer):
        return pa.record_batch([pa.array([name]), pa.array([writer.content()], pa.binary())], ["archive", "content"])

    plan = planned(pages, **names)
    fresh = F.col("first").isNull() | F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    return plan.select("page_id", "url", "html", "digest", "first", fresh.alias("fresh")).mapInArrow(run, "archive string, content binary")


SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def records(archived: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (archive, content), validated (columns as in SCHEMA).

    A response's digest is computed from its payload and must be the one that its header names; a
    revisit's comes from its header.  ``payload`` is null for revisits, or where ``payloads`` is false.
    """

    def run(source):
        for batch in source:
            for content in batch.column("content"):
                rows = []
                held = 0
                for data in frames(content.as_buffer()):
                    headers, block = parsed(data)
                    declared, payload = http_payload(block)
                    kind = headers["warc-type"]
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (declared != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                        raise BadRecord(f"a payload that isn't the declared one: {headers['warc-record-id']}")
                    if kind == "revisit" and payload:
                        raise BadRecord("a revisit with a payload")
                    page, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, headers.get("warc-target-uri"), kind, declared, digest, int(first) if first else None, payload if payloads and kind == "response" else None))
                    held += len(payload)
                    if held > ARCHIVE_BYTES or len(rows) >= 2000:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    def table(rows):
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return archived.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload.  Of equal payloads of at least LEAST_REVISIT bytes the smallest page_id's
    record is the response; a null page_id revisits it too, if some page of that payload has an id.  Rows
    that share a page_id keep a record each, and the response's copies are responses.  An empty table gives
    an empty result; other columns are ignored.
    """
    stored = written(archives(pages, **names))
    return records(stored, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def sql() -> str:
    """The same rows over ``pages`` in DuckDB's SQL."""
    return f"""
with named as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, min(page_id) as refers_to from named where payload_bytes >= {LEAST_REVISIT} group by payload_digest)
select n.page_id, n.payload_bytes, n.payload_digest, case when f.refers_to is null or f.refers_to = n.page_id then 'response' else 'revisit' end as record_type,
  case when f.refers_to <> n.page_id then f.refers_to end as refers_to
from named n left join firsts f on f.payload_digest = n.payload_digest and n.payload_bytes >= {LEAST_REVISIT}"""
