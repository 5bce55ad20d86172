"""WARC archives: a writer with revisit records, and a reader that salvages damage.

Archives are rows that hold bytes, each a run of gzip members with one record
per member (or plain records). The reader checks every member's CRC, each
record's version line, header, length and SHA-1 digests. After a failed check it
searches for the next byte where a valid member begins (or the next version line
of a plain archive) and goes on there; the bytes between are logged as a
quarantined gap, so damage costs only the records that it touches.

Defined cases: null html is an empty payload; payloads are compared by their
bytes, of equal ones the row with the greatest page_id is the response (rows that
repeat this id all are; null ids only where there is no other) and the others are
revisits that refer to it; payloads smaller than ``at_least`` are all
responses; archives of equal size are kept apart by number; very long payloads are
records of their own size; null urls are written as an empty target; an empty table gives no
rows; other columns are ignored.

Size: ids are combined per digest before they are shuffled; payloads meet them in
one equi-join whose common digests Spark can split, and are written in order of
arrival, so a task holds one archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, store, table

#: Bytes of an archive, about; one record may be longer.
ARCHIVE_BYTES = 4 << 20
#: Compressed bytes that are looked at together.
STEP = 1 << 14
_VERSION = b"WARC/1.1\r\n"
_GZIP = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value) -> bytes:
    clean = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {clean}\r\n".encode("utf-8", "surrogatepass")


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, gzip: bool = True) -> bytes:
    """One record; a revisit names the response and holds no payload."""
    block = b"" if revisit else payload
    head = _VERSION + _line("WARC-Type", "revisit" if revisit else "response") + _line("WARC-Record-ID", f"<urn:vellum:page:{page_id}>") + _line("WARC-Date", DATE) + _line("WARC-Target-URI", url or "")
    head += _line("WARC-Payload-Digest", f"sha1:{digest(payload)}") + _line("WARC-Block-Digest", f"sha1:{digest(block)}") + _line("X-Payload-Length", len(payload))
    if revisit:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<urn:vellum:page:{refers_to}>")
    raw = head + _line("Content-Type", "text/html; charset=utf-8") + _line("Content-Length", len(block)) + b"\r\n" + block + b"\r\n\r\n"
    if not gzip:
        return raw
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damage(ValueError):
    """A record that fails a check."""


def _page(said: str):
    """The page of a record id; null for ids of other archives."""
    if not said.startswith("<urn:vellum:page:"):
        return None
    said = said.removeprefix("<urn:vellum:page:").removesuffix(">")
    try:
        return None if said in ("None", "") else int(said)
    except ValueError as e:
        raise Damage("a page's number is malformed") from e


def _described(fields: dict, block: bytes) -> tuple:
    """Page, payload length, payload digest, type and page referred to of a record.

    A response's length and digest are those of the block that was read; a revisit has
    no payload, so they are what it states, or null."""
    kind, length, said = fields.get("warc-type"), fields.get("x-payload-length"), fields.get("warc-payload-digest")
    if not kind or not fields.get("warc-record-id"):
        raise Damage("a record without type or id")
    if length is not None and not (length.isdecimal() and length.isascii() and len(length) < 19):
        raise Damage("the payload's length is malformed")
    if kind != "revisit":
        size, hashed = len(block), digest(block)
    else:
        size, hashed = int(length) if length is not None else None, said.removeprefix("sha1:") if said else None
    return _page(fields["warc-record-id"]), size, hashed, kind, _page(fields.get("warc-refers-to", ""))


def parse(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Header fields (lower-cased names), block and end of the record at ``at``."""
    if raw[at : at + 5] != b"WARC/" or (stop := raw.find(b"\r\n\r\n", at)) < 0:
        raise Damage("no record")
    fields = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("a header line without a colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    size = fields.get("content-length", "")
    if not size.isdecimal() or not size.isascii():
        raise Damage("no content length")
    start, end = stop + 4, stop + 4 + int(size)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damage("the length doesn't lead to a record's end")
    block = raw[start:end]
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise Damage("the block's digest is wrong")
    if fields.get("warc-type") == "response" and (said := fields.get("warc-payload-digest")) and said != f"sha1:{digest(block)}":
        raise Damage("the payload's digest is wrong")
    _described(fields, block)
    return fields, block, end + 4


def _member(raw: bytes, at: int) -> tuple[bytes, int]:
    """The data of the gzip member at ``at``, its CRC checked, and where it ends."""
    z, parts, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(raw):  # by steps, as what is left over gets copied
            parts.append(z.decompress(raw[end : end + STEP]))
            end += STEP
    except zlib.error as e:
        raise Damage(str(e)) from e
    if not z.eof:
        raise Damage("the member ends early")
    return b"".join(parts), min(end, len(raw)) - len(z.unused_data)


def read(raw: bytes):
    """Yields ("record", start, end, fields, block) and ("gap", start, end, reason, b"").

    After a gap the next start is tried; the gap ends where a whole record is valid."""
    at, gap, reason = 0, None, ""
    while at < len(raw):
        try:
            if raw[at : at + 3] == _GZIP:
                data, end = _member(raw, at)
                found, pos = [], 0
                while pos < len(data):
                    fields, block, pos = parse(data, pos)
                    found.append((fields, block))
                if not found:
                    raise Damage("an empty member")
            else:
                fields, block, end = parse(raw, at)
                found = [(fields, block)]
        except (Damage, UnicodeDecodeError) as e:
            if gap is None:
                gap, reason = at, str(e)
            nexts = [p for p in (raw.find(_GZIP, at + 1), raw.find(b"WARC/1.", at + 1)) if p >= 0]
            at = min(nexts, default=len(raw))
            continue
        if gap is not None:
            yield "gap", gap, at, reason, b""
            gap = None
        for fields, block in found:
            yield "record", at, end, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, len(raw), reason, b""


def _write(batches):
    some, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            some.append(record(r["page_id"], r["url"], bytes(r["payload"]), r["refers_to"], r["revisit"]))
            size += len(some[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(some)], pa.binary())], ["data"])
                some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(some)], pa.binary())], ["data"])


def archives(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Rows of archive (number) and data (bytes), stored in the shared folder."""
    base = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("key", F.when(F.length("payload") >= at_least, F.sha2("payload", 256)))
    ids = base.select("page_id", "key").filter("key is not null").groupBy("key").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    ids = ids.select("key", "head", F.lit(True).alias("copied"))
    joined = base.join(ids, "key", "left").withColumn("revisit", F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("head")))
    written = joined.select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("head")).alias("refers_to"), "revisit").mapInArrow(_write, "data binary")
    with in_batches(pages.sparkSession):
        return store(written.select(F.monotonically_increasing_id().alias("archive"), "data"), "warc")


RECORD = "archive long, start long, stop long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, gap string"


def records(stored: DataFrame) -> DataFrame:
    """Salvaged records of archives, and their quarantined gaps (gap: what failed)."""

    def run(batches):
        for batch in batches:
            for archive, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for what, start, stop, fields, block in read(raw.as_py()):
                    if what == "gap":
                        rows.append((archive, start, stop, None, None, None, None, None, fields))
                    else:
                        rows.append((archive, start, stop, *_described(fields, block), None))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                cols = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in RECORD.split(", ")])

    return stored.mapInArrow(run, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), 0))
    return found.filter("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS s, max(page_id) OVER (PARTITION BY b) AS head FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || s[i * 5 + 1:i * 5 + 5])::BIGINT) AS v FROM h)
SELECT page_id, payload_bytes,
  list_aggregate(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0], lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> k) & 31) + 1]))), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM d
"""
