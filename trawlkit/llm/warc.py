"""WARC archives: writing with segmentation and revisits, and reading back with reassembly.

Writing. Each record is an HTTP response with chunked transfer framing. A block
longer than ``segment_bytes`` is cut into a first record (segment 1) and
``continuation`` records that name it as their origin; the last one carries the
total length. Of equal payloads of at least ``least_bytes`` bytes, only the one
with the smallest key is stored; the others are revisit records of the
identical-payload-digest profile. Records go through Spark's text writer with
``CRLF CRLF`` as the line end, which is exactly the record separator, so archives
land on any file system Spark can write to, through its commit protocol. Segments
and records a file are bounded, hence files are.

Reading. Files are decompressed piece by piece and parsed record by record by
their Content-Length, so payloads may hold any bytes; gzip is recognised per file
or per record. Continuations are grouped by origin, ordered by segment number,
joined and checked against the total length, then the chunked framing is undone.
Records whose segments all lie in one file are reassembled where they are read;
segments that lie apart, or are more than a task may hold, are shuffled and
grouped. Revisits get size and digest from the response of their payload digest,
as it was decoded.

Keys. A page's key is in its record id (``urn:page``, percent-encoded); a record
of another writer has its record id as key.

Defined cases: null payloads are empty; null keys stay null; a missing or
repeated segment, a wrong total, broken framing, a digest that differs, a header
that cannot be read, a truncated record or a revisit of no response give
``valid`` false and no payload, never an error; damaged gzip members and padding
are skipped; repeated keys are separate records; an empty table gives an empty
archive and result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.llm.common import frugal, saved, scratch_path

SEGMENT_BYTES, CHUNK_BYTES, LEAST_BYTES, FILE_RECORDS = 1 << 11, 1 << 10, 100, 16_000
#: Bytes of unfinished records that a task holds before it hands them to the shuffle.
HELD_BYTES = 16 << 20
_END = b"\r\n\r\n"
_MAGIC = b"\x1f\x8b\x08"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    at = 0
    while at < len(payload):
        upto = _boundary(payload, at, size)
        out += [b"%x\r\n" % (upto - at), payload[at:upto], b"\r\n"]
        at = upto
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """The payload, or None where the framing is broken. Chunk extensions and trailers are skipped."""
    out = []
    at = 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        size = framed[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return None
        n = int(size, 16)
        at = end + 2
        if n == 0:
            return b"".join(out) if framed[at : at + 2] == b"\r\n" or framed.find(_END, at) >= 0 else None
        if framed[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(framed[at : at + n])
        at += n + 2


def _boundary(data: bytes, at: int, size: int) -> int:
    """End of the next piece: at most ``size`` bytes, not inside a UTF-8 character."""
    upto = min(len(data), at + max(size, 4))
    while upto < len(data) and data[upto] & 0xC0 == 0x80:
        upto -= 1
    return upto


def record_key(key: str | None, row: int) -> str:
    """The record id of a page; ``row`` tells pages of equal key apart."""
    return f"urn:page:{'n' if key is None else 'k' + quote(key, safe='', errors='surrogatepass')}:{row}"


def key_of(record_id: str | None) -> str | None:
    m = re.fullmatch(r"<?urn:page:(?:n|k([^:]*)):\d+>?", record_id or "")
    if not m:
        return record_id
    return None if m[1] is None else unquote(m[1], errors="surrogatepass")


def _record(kind: str, record_id: str, block: bytes, **fields) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block


def page_records(key: str | None, row: int, url: str | None, payload: bytes, digest: str, revisit: bool, *, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of one page."""
    own = record_key(key, row)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    shared = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha-256:{digest}", "Content_Type": "application/http;msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        yield _record("revisit", own, http + b"\r\n", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **shared)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    cuts = [0]
    while cuts[-1] < len(block):
        cuts.append(_boundary(block, cuts[-1], segment_bytes))
    several = len(cuts) > 2
    yield _record("response", own, block[: cuts[1]], WARC_Segment_Number=1 if several else None, **shared)
    for n in range(2, len(cuts)):
        total = len(block) if n == len(cuts) - 1 else None
        yield _record("continuation", f"{own}:{n}", block[cuts[n - 1] : cuts[n]], WARC_Segment_Origin_ID=f"<{own}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The file's bytes, decompressed, in pieces of bounded size; an empty one where some were lost."""
    if data[:3] != _MAGIC:
        for at in range(0, len(data), 1 << 20):
            yield data[at : at + (1 << 20)]
        return
    at = 0
    while 0 <= at < len(data):
        d = zlib.decompressobj(31)
        lost = False
        fed = at
        while fed < len(data) and not d.eof and not lost:
            try:
                piece = d.decompress(data[fed : fed + (1 << 16)])
            except zlib.error:
                piece, lost = b"", True
            fed += 1 << 16
            if piece:
                yield piece
        if lost or not d.eof:
            yield b""
            at = data.find(_MAGIC, at + 1)
        else:
            rest = min(fed, len(data)) - len(d.unused_data)
            at = data.find(_MAGIC, rest)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(headers by lower-case name, block, whether it is whole) of every record in a file, plain or gzipped."""
    pieces = _pieces(data)
    held, at = bytearray(), 0

    def more() -> bool:
        piece = next(pieces, b"")
        held.extend(piece)
        return bool(piece)

    while True:
        if at > 1 << 20:
            del held[:at]
            at = 0
        start = held.find(b"WARC/", at)
        end = held.find(_END, start) if start >= 0 else -1
        if end < 0:
            if start < 0:
                at = max(at, len(held) - 4)
            elif len(held) - start > 1 << 20:  # no header is so long
                at = start + 5
                continue
            if more():
                continue
            if start >= 0:
                yield {}, b"", False
            held.clear()
            at = 0
            if not more():
                return
            continue
        head: dict[str, str] = {}
        for line in held[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        n = _number(head.get("content-length"))
        if n is None:
            yield head, b"", False
            at = end + 4
            continue
        stop = end + 4 + n
        while len(held) < stop and more():
            pass
        yield head, bytes(held[end + 4 : stop]), len(held) >= stop
        at = min(stop, len(held))


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def payload_of(segments: list[tuple[int | None, int | None, bytes]]) -> bytes | None:
    """Joins a record's segments (number, total length if last, bytes) and undoes HTTP framing; None if anything is amiss."""
    if any(n is None for n, _, _ in segments):
        return None
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != [*range(1, len(segments) + 1)]:
        return None
    block = b"".join(s[2] for s in segments)
    totals = [s[1] for s in segments if s[1] is not None]
    if len(segments) > 1 and totals != [len(block)] or len(segments) == 1 and totals not in ([], [len(block)]):
        return None
    head, end, body = block.partition(_END)
    if not end:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n")) else body


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = LEAST_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes one response or revisit for each row."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload")})
    same = rows.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first", F.lit(True).alias("copied"))
    revisit = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("key"))
    dealt = rows.join(same, "digest", "left").select(F.col("key").cast("string").alias("key"), "url", "payload", F.lower(F.hex("digest")).alias("digest"), revisit.alias("revisit"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            held = 0
            for k, u, p, d, again, n in zip(*(batch.column(i) for i in range(6))):
                for r in page_records(k.as_py(), n.as_py(), u.as_py(), p.as_py().encode("utf-8", "surrogatepass"), d.as_py(), again.as_py(), segment_bytes=segment_bytes, chunk_bytes=chunk_bytes):
                    out.append(r.decode("utf-8", "surrogatepass"))
                    held += len(r)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string())], names=["value"])

    dealt.mapInArrow(frugal(run), "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


_READ = "origin string, key string, uri string, kind string, digest string, number int, total long, part binary, payload_bytes long, payload_digest string, payload binary"
_READ_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.rsplit(" ", 1) for x in _READ.split(", "))])


def _decoded(payload: bytes | None, keep: bool) -> dict:
    """What is told of a payload; -1 bytes where there is none."""
    if payload is None:
        return {"payload_bytes": -1, "payload_digest": None, "payload": None}
    return {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if keep else None}


def file_rows(content: bytes, keep_payload: bool, held_bytes: int = HELD_BYTES) -> Iterator[dict]:
    """A row for each record: decoded responses, revisits, and the segments (``part``) of records that this file does not complete."""
    unfinished: dict[str, list[dict]] = {}
    held = 0
    for head, block, whole in records(content):
        kind, own = head.get("warc-type"), head.get("warc-record-id")
        if kind not in ("response", "revisit", "continuation") and (whole or kind):
            continue
        digest = head.get("warc-payload-digest", "").lower()
        row = {"origin": head.get("warc-segment-origin-id", own) or "", "key": key_of(own), "uri": head.get("warc-target-uri"), "kind": kind or "unreadable", "digest": digest.removeprefix("sha-256:").removeprefix("sha256:") or None}
        number, total = _number(head.get("warc-segment-number")), _number(head.get("warc-segment-total-length"))
        row |= {"number": None if number is None or number > 1 << 30 else number, "total": total}
        if kind == "revisit":
            yield row
        elif not whole or kind is None:
            yield row | _decoded(None, keep_payload)
        elif kind == "response" and "warc-segment-number" not in head:
            yield row | _decoded(payload_of([(1, total, block)]), keep_payload)
        else:
            parts = unfinished.setdefault(row["origin"], [])
            parts.append(row | {"part": block})
            held += len(block)
            last = next((p["number"] for p in parts if p["total"] is not None), None)
            if last == len(parts) and (first := next((p for p in parts if p["kind"] == "response"), None)):
                payload = payload_of([(p["number"], p["total"], p["part"]) for p in parts])
                if payload is not None:
                    held -= sum(len(p["part"]) for p in unfinished.pop(row["origin"]))
                    yield first | {"part": None, "number": None, "total": None} | _decoded(payload, keep_payload)
            if held > held_bytes:
                for parts in unfinished.values():
                    yield from parts
                unfinished, held = {}, 0
    for parts in unfinished.values():
        yield from parts


def read_records(spark: SparkSession, path: str, keep_payload: bool = False, held_bytes: int = HELD_BYTES, glob: str = "part-*") -> DataFrame:
    """:func:`file_rows` of every file under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                held = 0
                for row in file_rows(content.as_py(), keep_payload, held_bytes):
                    rows.append(row)
                    held += len(row.get("part") or b"") + len(row.get("payload") or b"")
                    if held > 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").mapInArrow(frugal(run), _READ)


def read_archive(spark: SparkSession, path: str, keep_payload: bool = False, **options) -> DataFrame:
    """A row per page: key, uri, kind, refers (a revisit's response), digest, payload_bytes, payload_digest, valid and, if asked for, payload (responses only)."""
    each = saved(read_records(spark, path, keep_payload, **options), "records")
    first = lambda c: F.max(F.when(F.col("kind") == "response", F.col(c))).alias(c)
    apart = each.filter("part is not null").groupBy("origin").agg(*map(first, ("key", "uri", "kind", "digest")), F.collect_list(F.struct("number", "total", "part")).alias("parts"))
    names = ["key", "uri", "kind", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_decoded(payload_of([(s["number"], s["total"], s["part"]) for s in parts.as_py()]), keep_payload) for parts in batch.column(4)]
            cols = [pa.array([r[c] for r in rows], type=t) for c, t in (("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *cols], names=[*names, "payload_bytes", "payload_digest", "payload"])

    joined = apart.select(*names, "parts").mapInArrow(frugal(run), "key string, uri string, kind string, digest string, payload_bytes long, payload_digest string, payload binary")
    columns = [*names, "payload_bytes", "payload_digest", "payload"]
    responses = each.filter("part is null and kind != 'revisit'").select(*columns).unionByName(joined)
    sound = F.coalesce((F.col("kind") == "response") & (F.col("payload_digest") == F.coalesce("digest", "payload_digest")), F.lit(False))
    responses = saved(responses.withColumn("valid", sound), "responses")
    stored = responses.filter("valid").groupBy("payload_digest").agg(F.min(F.struct("key", "payload_bytes")).alias("r")).select("payload_digest", F.col("r.key").alias("refers"), F.col("r.payload_bytes").alias("payload_bytes"), F.lit(True).alias("valid"))
    again = each.filter("kind = 'revisit'").select(*names).join(stored, F.col("digest") == F.col("payload_digest"), "left")
    again = again.select("key", "uri", "kind", "refers", "digest", F.coalesce("payload_bytes", F.lit(-1)).alias("payload_bytes"), "payload_digest", F.lit(None).cast("binary").alias("payload"), F.coalesce("valid", F.lit(False)).alias("valid"))
    # what cannot be trusted is not handed on
    told = responses.select("key", "uri", "kind", F.lit(None).cast("string").alias("refers"), "digest", F.when(F.col("valid"), F.col("payload_bytes")).otherwise(-1).cast("long").alias("payload_bytes"), *(F.when(F.col("valid"), F.col(c)).alias(c) for c in ("payload_digest", "payload")), "valid")
    out = told.unionByName(again)
    return out if keep_payload else out.drop("payload")


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all ``pages`` and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    found = read_archive(pages.sparkSession, path)
    kind = dict(pages.dtypes)["page_id"]
    return found.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))
