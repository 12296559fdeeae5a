"""WARC archives: a writer with revisit records and a reader that salvages what it can.

Writing: every task writes its own gzip archives, one member per record, under
names that hold the task attempt; the archives that count are those named in the
table which the finished job returns, so a repeated or lost attempt leaves no
record twice. Reading: a record is checked (version line, header, length, end
mark, digest). Where a check fails, the reader looks for the next gzip member or
version line that starts a valid record, goes on there, and returns the bytes
between as a quarantined gap. Members may hold one record or many.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import materialize, scratch_dir, small

#: Bytes after which a task begins its next archive; bytes that are inflated at a time; copies from which on a payload's revisits are found without an exchange.
ARCHIVE, SLICE, LARGE = 8_000_000, 65_536, 1_000
_VERSION = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"
#: Names of pages are this and their number.
NAME = "urn:page:"

RECORD_DDL = "file string, offset long, inner long, kind string, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary, reason string"
_RECORD = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("inner", pa.int64()), ("kind", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string())])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP header with the payload's length, and not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', uri)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + _END + block + _END


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(rows: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Write ``rows`` (record_id, uri, payload binary, refers_to) below ``folder``; the table of archives: file, n_records, n_bytes.

    Every row is a record, also repeated ones. Nulls: an empty uri, an empty
    payload; a null record_id is written as an empty name. Eager: when it
    returns, the archives are there.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        own = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, names, k = None, [], 0
        n = size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                record_id, uri, payload, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                if out is None:
                    names.append(f"{own}-{k:04d}.warc.gz")
                    out, n, size, k = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0, 0, k + 1
                data = gzip_member(encode_record(record_id or "", uri or "", payload or b"", refers_to))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive:
                    out.close()
                    yield _made(names[-1], n, size)
                    out = None
        if out is not None:
            out.close()
            yield _made(names[-1], n, size)

    return materialize(rows.select("record_id", "uri", "payload", "refers_to").mapInArrow(write, "file string, n_records long, n_bytes long"), "archives")


def _made(name: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "n_records", "n_bytes"])


#: A length: decimal digits of a number that 64 bits hold.
_SIZE = re.compile(r"[0-9]{1,18}")


def _header(data: bytes, pos: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header at ``pos`` and where its block starts."""
    if data[pos : pos + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        return None
    end = data.find(_END, pos)
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in data[pos:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            return None
        fields.setdefault(name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip())
    return fields, end + 4


def parse_record(data: bytes, pos: int) -> tuple[dict, int] | str:
    """The record at ``pos`` and where it ends, or what is wrong with it."""
    head = _header(data, pos)
    if head is None:
        return "no valid header"
    fields, start = head
    size = fields.get("content-length", "")
    if not _SIZE.fullmatch(size):
        return "no valid length"
    stop = start + int(size)
    if data[stop : stop + 4] != _END:
        return "block cut short or without end mark"
    block = data[start:stop]
    http, sep, payload = block.partition(_END)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = fields.get("warc-type", "")
    stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http) if sep else None
    length = int(stated[1]) if stated and len(stated[1]) <= 18 else None
    if kind == "response" and sep:
        if digest and sha1_base32(payload) != digest:
            return "payload does not have its digest"
        if stated and length != len(payload):
            return "payload does not have its length"
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return {
        "record_type": kind, "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"), "uri": fields.get("warc-target-uri"),
        "payload_bytes": len(payload if sep else block) if length is None else length, "payload_digest": digest,
        "payload": None if kind == "revisit" else payload if sep else block,
    }, stop + 4


def _inflate(data: bytes, pos: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``pos`` holds, and where it ends; null if it is cut or damaged, with what came before the damage."""
    z, out, at = zlib.decompressobj(31), [], pos
    for size in (SLICE, 4_096, 256, 16, 1):  # smaller steps up to the damage
        while at < len(data):
            before = z.copy()
            try:
                out.append(z.decompress(data[at : at + size]))
            except zlib.error:
                z = before
                break
            at = min(at + size, len(data))
            if z.eof:
                return b"".join(out), at - len(z.unused_data)
    return b"".join(out), None


def _records(data: bytes, offset: int, trusted: bool) -> Iterator[tuple[str, int, object]]:
    """Records and gaps of the inflated member at ``offset``. What is not ``trusted`` needs its digest, or to be followed by another record."""
    pos, start, reason = 0, None, ""
    while pos < len(data):
        got = parse_record(data, pos)
        if isinstance(got, str) or not (trusted or got[0]["payload_digest"] or got[0]["record_type"] == "revisit" or data[got[1] : got[1] + 7] == _VERSION):
            start, reason = (pos, got if isinstance(got, str) else "not to be trusted") if start is None else (start, reason)
            pos = data.find(_VERSION, pos + 1)
            pos = len(data) if pos < 0 else pos
            continue
        if start is not None:
            yield "gap", offset, (pos - start, reason, start)
            start = None
        yield "record", offset, got[0] | {"inner": pos}
        pos = got[1]
    if start is not None and trusted:
        yield "gap", offset, (len(data) - start, reason, start)


def _read(data: bytes, pos: int) -> tuple[list, int | None, str]:
    """Records and inner gaps at ``pos``, where what holds them ends (null: damaged), and what is wrong if there is no record."""
    if data[pos : pos + 3] == _MEMBER:
        inside, end = _inflate(data, pos)
        found = [*_records(inside, pos, end is not None)]
        if end is None:
            return [x for x in found if x[0] == "record"], None, "damaged gzip member"
        return (found if any(k == "record" for k, *_ in found) else []), end, "no valid record in a gzip member"
    got = parse_record(data, pos)
    return ([], None, got) if isinstance(got, str) else ([("record", pos, got[0] | {"inner": 0})], got[1], "")


def _starts_record(data: bytes, pos: int) -> bool:
    if data[pos : pos + 3] == _MEMBER:
        try:  # a look at the first bytes is enough here; _read() checks all
            return zlib.decompressobj(31).decompress(memoryview(data)[pos : pos + 512], 7) == _VERSION
        except zlib.error:
            return False
    return data[pos : pos + 7] == _VERSION


def salvage(data: bytes) -> Iterator[tuple[str, int, object]]:
    """("record", offset, fields) and ("gap", offset, (length, reason, inner)), in the order of the archive.

    ``inner`` is the place in the inflated member at ``offset``; a gap outside of
    members has none. A member may hold several records; of a cut or damaged one
    those before the damage are kept, and the member is a gap all the same. An
    empty archive gives nothing. All bytes are in a record, its member, or a gap.
    """
    pos, start, reason = 0, None, ""
    while pos < len(data):
        events, end, why = _read(data, pos) if start is None or _starts_record(data, pos) else ([], None, "")
        if events and start is not None:
            yield "gap", start, (pos - start, reason, None)
            start = None
        yield from events
        if not events or end is None:
            start, reason = (pos, why) if start is None else (start, reason)
        if end is not None:
            pos = end
        else:
            marks = [p for p in (data.find(_MEMBER, pos + 1), data.find(_VERSION, pos + 1)) if p >= 0]
            pos = min(marks, default=len(data))
    if start is not None:
        yield "gap", start, (len(data) - start, reason, None)


def read_archives(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Records and gaps of the archives in ``folder``, or of those that ``files`` (column file) names.

    ``kind`` is "record" or "gap"; a gap has its length in ``payload_bytes`` and
    the failed check in ``reason``. Archives are read whole, so they should be
    of the size that ``write_archives`` makes.
    """
    raw = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files is not None:
        raw = raw.join(files.select("file"), "file", "left_semi")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                for kind, offset, x in salvage(batch.column(1)[i].as_py()):
                    if kind == "record":
                        rows.append({"file": name, "offset": offset, "kind": kind} | x)
                        size += len(x["payload"] or b"")
                    else:
                        rows.append({"file": name, "offset": offset, "kind": kind, "payload_bytes": x[0], "reason": x[1], "inner": x[2]})
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return raw.select("file", "content").mapInArrow(parse, RECORD_DDL)


def with_revisits(pages: DataFrame, page_id: str = "page_id", uri: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Rows for ``write_archives``: of equal payloads of at least ``least`` bytes the one with the largest id is stored, others refer to it.

    Payloads are equal if their length and SHA-256 are. Records are named by URIs.
    """
    name = lambda c: F.concat(F.lit(NAME), F.col(c).cast("string"))
    rows = pages.select(name(page_id).alias("record_id"), F.col(page_id).alias("n"), F.coalesce(uri, F.lit("")).alias("uri"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.concat_ws(":", F.octet_length("payload").cast("string"), F.sha2("payload", 256)))
    kept = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("n").alias("last"), F.count(F.lit(1)).alias("times")).filter("times > 1 and last is not null")
    kept = materialize(kept, "stored")
    # payloads with many copies go to every task, so that copies are not dealt to a single one
    large = small(kept.filter(f"times > {LARGE}").select("sha", F.col("last").alias("large")))
    few = kept.filter(f"times <= {LARGE}").select(F.col("sha").alias("key"), "last")
    out = rows.join(large, "sha", "left").withColumn("key", F.when(F.col("large").isNull(), F.col("sha"))).join(small(few, 200_000), "key", "left")
    stored = F.coalesce("large", "last")
    return out.withColumn("last", stored).withColumn("refers_to", F.when(~F.col("n").eqNullSafe(F.col("last")), name("last"))).select("record_id", "uri", "payload", "refers_to")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url an empty one. Repeated rows are
    separate records. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = scratch_dir(spark) + "/warc"
    files = write_archives(with_revisits(pages, least=least), folder)
    if not files.limit(1).count():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    got = read_archives(spark, folder, files).filter("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(replace({c}, '{NAME}', '') as long)")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
