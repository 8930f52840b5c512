"""Legacy ARC archives converted to WARC.

An ARC stream opens with a ``filedesc:`` record whose body names the version and the fields of the
header lines that follow; every record is one header line, a body of the length that line declares,
and a newline.  The converter reads each version's own fields and synthesises what ARC lacks: record
identifiers from (url, date, payload, place), ISO timestamps, record types, SHA-1 digests of payload and
block, and the HTTP block that a response or revisit holds.  Archives are
binary segments of bounded size in a table on the shared folder, written with Spark's commit protocol,
so a lost executor loses nothing.  The id of a record's source row travels beside an ARC segment,
in record order, and in an extension field of the WARC record.

Which records revisit others is found from digests alone.  The few marks of a segment come back to it in a
join of segments with marks, for which Spark broadcasts the marks' table only if its files are below the
session's threshold; payloads are never shuffled one by one.

Null payloads are empty; null or blank urls read as ``urn:none``; a date that is no date is kept in an extension
field and read as 1970-01-01.  A null id is never referred to; an empty table gives an empty one; other columns
are ignored, whatever their names.  A record that is cut short, or whose header line has
another number of fields than its version, raises :class:`ArcError` with its offset.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Payload bytes of a segment unless one record is longer.
SEGMENT_BYTES = 4 << 20
#: Payloads from this size on are stored once.
LEAST_BYTES = 1000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArcError(ValueError):
    pass


def _url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url and url.strip() else "urn:none"


def arc_open(version: int, name: str, date: str) -> bytes:
    body = (f"{version} 0 Origin\n" + " ".join(FIELDS[version]) + "\n").encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, date: str, payload: bytes, name: str, offset: int) -> bytes:
    values = {"URL": _url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Offset": str(offset), "Filename": name, "Archive-length": str(len(payload))}
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + payload + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of each record after the opening one."""
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"the header line at {at} does not end")
        parts = data[at:end].decode("utf-8", "replace").split(" ")
        names = FIELDS[1] if fields is None and len(parts) == 5 else FIELDS[2] if fields is None else fields
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArcError(f"the header line at {at} has {len(parts)} fields")
        length = int(parts[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ArcError(f"the record at {at} is cut short")
        at = end + 1 + length
        if fields is None:
            version = body.split(b" ", 1)[0]
            if not parts[0].startswith("filedesc:") or version not in (b"1", b"2"):
                raise ArcError("the archive does not open with a filedesc record of version 1 or 2")
            fields = FIELDS[int(version)]
            continue
        yield dict(zip(names, parts, strict=True)), body


#: What a short ARC date leaves out: first month, first day, midnight.
_REST = "00000101000000"


def _iso(date: str) -> str | None:
    """ISO form of an ARC date of 4 to 14 digits, an even number of them; None if it is no date."""
    if not (date.isascii() and date.isdigit() and 4 <= len(date) <= 14 and len(date) % 2 == 0):
        return None
    try:
        at = datetime.datetime.strptime(date + _REST[len(date) :], "%Y%m%d%H%M%S")
    except ValueError:
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")


def record_id(url: str, date: str, digest: str, source: int | None, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {digest} {source} {place}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: dict[str, str], body: bytes, source: int | None, refers: tuple[int, str] | None, place: str = "") -> bytes:
    """One gzip member; a revisit, of (source id, record id), keeps the payload's digest and length but not its bytes."""
    url, given, length = fields["URL"], fields["Archive-date"], len(body)
    date, digest = _iso(given), _sha1(body)
    status = fields.get("Result-code", "200")
    block = f"HTTP/1.1 {status if status.isdigit() else '200'} OK\r\nContent-Type: {fields['Content-type']}\r\nContent-Length: {length}\r\n\r\n".encode()
    if refers is None:
        block += body
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(url, given, digest, source, place)),
        ("WARC-Date", date or "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", fields["IP-address"]),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
        ("X-Payload-Length", str(length)),
        ("X-Source-Id", "" if source is None else str(source)),
    ]
    if date is None:
        head.append(("X-Archive-Date", given))
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[1]), ("X-Refers-To-Source-Id", str(refers[0]))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record of a gzip member stream or a plain one; an HTTP block's payload follows its own header."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ArcError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        length = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ArcError(f"the record at {at} is cut short")
        if "WARC-Block-Digest" in head and head["WARC-Block-Digest"] != _sha1(block):
            raise ArcError(f"the block at {at} differs from its digest")
        if head.get("Content-Type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield head, block
        at = end + 4 + length + 4


def _to_arc(batches):
    """(id, url, html) as numbered ARC segments, of either version in turn, with the ids of their records."""
    context = TaskContext.get()
    turn, parts, ids, size = 0, [], [], 0

    def segment():
        number = ((context.partitionId() if context else 0) << 32) + turn
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b"".join(parts)], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["segment", "arc", "ids"])

    for batch in batches:
        for source, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            version, name = 1 + turn % 2, f"part-{turn}.arc"
            payload = html or b""
            if not parts:
                parts, size = [arc_open(version, name, "20240101000000")], 0
            parts.append(arc_record(version, url, "20240101000000", payload, name, size))
            ids.append(source)
            size += len(parts[-1])
            if size >= SEGMENT_BYTES:
                yield segment()
                turn, parts, ids = turn + 1, [], []
    if parts:
        yield segment()


def _placed(batch):
    """(segment, place in it, source id, fields, body) of every record."""
    for number, data, ids in zip(*(batch.column(c) for c in ("segment", "arc", "ids")), strict=True):  # one segment in memory at a time
        number, data, ids = number.as_py(), data.as_py(), ids.as_py()
        for at, (source, (fields, body)) in enumerate(zip(ids, arc_records(data), strict=True)):
            yield number, at, source, fields, body


def _digests(batches):
    for batch in batches:
        rows = []
        for number, at, source, fields, body in _placed(batch):
            if source is not None and len(body) >= LEAST_BYTES:
                rows.append((number, at, source, hashlib.sha1(body).digest(), record_id(fields["URL"], fields["Archive-date"], _sha1(body), source, f"{number}:{at}")))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["segment", "at", "id", "sha1", "record"])


def _to_warc(batches):
    """One WARC segment of every ARC segment and its marks (place, source id, record id)."""
    for batch in batches:
        marks = {}
        for number, own in zip(batch.column("segment").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            for m in own or ():
                marks[number, m["at"]] = (m["refers_to"], m["refers_record"])
        parts, last = [], None
        for number, at, source, fields, body in _placed(batch):
            if parts and number != last:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["warc"])
                parts = []
            last = number
            parts.append(warc_record(fields, body, source, marks.get((number, at)), f"{number}:{at}"))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["warc"])


def _read_back(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            rows = []
            for head, body in warc_records(data):
                digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                if head["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
                    raise ArcError("a payload differs from its digest")
                refers = head.get("X-Refers-To-Source-Id")
                rows.append((int(head["X-Source-Id"]) if head["X-Source-Id"] else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(refers) if refers else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def to_arc(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """(segment long, arc binary, ids array<long>) segments of a page table.

    Segments are numbered by task: write them before they are read twice.
    """
    source = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.col(payload_column).alias("html"))
    return source.mapInArrow(_to_arc, "segment long, arc binary, ids array<long>")


def to_warc(arcs: DataFrame, ws: Workspace) -> DataFrame:
    """(warc binary) segments from written (segment, arc, ids) segments; equal long payloads are stored once, under the largest id.

    Rows that repeat the response's id are responses too; a revisit names the one with the largest record id.
    """
    hashed = ws.save(arcs.mapInArrow(_digests, "segment long, at int, id long, sha1 binary, record string"), "digests")
    chosen = hashed.groupBy("sha1").agg(F.max(F.struct("id", "record")).alias("to"), F.count("*").alias("n")).where("n > 1").select("sha1", F.col("to.id").alias("refers_to"), F.col("to.record").alias("refers_record"))
    revisits = hashed.select("segment", "at", "id", "sha1").join(chosen, "sha1").where("id <> refers_to")
    marks = ws.save(revisits.groupBy("segment").agg(F.collect_list(F.struct("at", "refers_to", "refers_record")).alias("marks")), "marks")
    ws.drop(hashed)
    return arcs.join(marks, "segment", "left").mapInArrow(_to_warc, "warc binary")


def archived(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Every page's record as read back from WARC segments converted from ARC segments."""
    ws = Workspace(pages.sparkSession)
    arcs = ws.save(to_arc(pages, id_column, url_column, payload_column), "arc")
    warcs = ws.save(to_warc(arcs, ws), "warc")
    ws.drop(arcs)
    return warcs.mapInArrow(_read_back, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("id", id_column)
