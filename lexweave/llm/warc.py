"""WARC archives: writing with deduplication, reading with reassembly (operator 4).

Writing: each page becomes a ``response`` record whose HTTP body uses chunked
transfer framing, or a ``revisit`` record if an equal payload has a page with a
larger id.  A block longer than ``segment_bytes`` is split: the first segment
stays in the record, the others follow as ``continuation`` records that name
their origin.  Spark's text writer stores the records, so files are committed
by Spark's protocol into any store; a record ends in CR LF CR LF, of which the
writer's line separator is the last CR LF.  Archives are gzip files of at most
``records_per_file`` records.

Reading: archives are parsed by Content-Length.  Continuation records are
grouped by origin, ordered by segment number, checked against the total length
that the last one states, and joined; then the HTTP head is cut off and the
chunked framing decoded.  Only split records are shuffled.

Payloads are compared by SHA-1 and length.  A payload's largest id is found by
partial aggregation; only payloads that occur more than once are joined back,
by broadcast while they are at most ``broadcast_rows``, else by a join whose
keys are salted.

Defined cases: a null html is an empty payload; of equal payloads all rows with
the largest page_id are responses (so a repeated row is never lost), and a null
page_id counts as the smallest; a null url is written as ``urn:none``, control
characters and spaces in urls are percent-encoded; records that fail a check
come back with ``problem`` set instead of failing the job; an empty table makes
an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, stage

RECORDS = (
    "record_type string, record_id string, target_uri string, refers_to_id string, origin_id string, segment int, total_length long, "
    "stated_digest string, stated_bytes long, payload_bytes long, payload_digest string, payload binary, block binary, problem string"
)
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_TYPES = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string()]
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk framing broken")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of HTTP head")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:[^\r]*chunked", head) else body


def _record(block: bytes, **fields: object) -> bytes:
    """A record without its last CR LF; ``_`` in a field name stands for ``-``."""
    lines = ["WARC/1.1", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes, keep: int | None, revisit: bool, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    sha = digest(payload)
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    own = f"urn:page:{page_id}:{sha}"
    common = {"WARC_Date": "1970-01-01T00:00:00Z", "WARC_Target_URI": uri}
    http = {"Content_Type": "application/http;msgtype=response", "WARC_Payload_Digest": f"sha1:{sha}"}
    if revisit:
        block = _HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record(block, WARC_Type="revisit", WARC_Record_ID=f"<{own}:revisit>", WARC_Profile=profile, WARC_Refers_To=f"<urn:page:{keep}:{sha}>", **common, **http)
        return
    block = _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record(block, WARC_Type="response", WARC_Record_ID=f"<{own}>", **common, **http)
        return
    yield _record(block[:segment_bytes], WARC_Type="response", WARC_Record_ID=f"<{own}>", WARC_Segment_Number=1, **common, **http)
    starts = range(segment_bytes, len(block), segment_bytes)
    for number, at in enumerate(starts, 2):
        total = len(block) if number == len(starts) + 1 else None
        yield _record(
            block[at : at + segment_bytes], WARC_Type="continuation", WARC_Record_ID=f"<{own}:segment:{number}>",
            WARC_Segment_Origin_ID=f"<{own}>", WARC_Segment_Number=number, WARC_Segment_Total_Length=total, **common,
        )


def _write(batches: Iterator[pa.RecordBatch], segment_bytes: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for page_id, url, payload, keep, revisit in zip(*[batch[c] for c in ("id", "url", "payload", "keep", "revisit")], strict=True):
            for record in records_of(page_id.as_py(), url.as_py(), payload.as_py(), keep.as_py(), revisit.as_py(), segment_bytes, chunk_bytes):
                out.append(record)
                size += len(record)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    least_bytes: int = 0,
    segment_bytes: int = 32 << 10,
    chunk_bytes: int = 8 << 10,
    records_per_file: int = 1000,
    broadcast_rows: int = 1_000_000,
) -> None:
    """Write all pages as gzip WARC files under ``path``."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload")})
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("sha", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    groups = stage(groups.where("n > 1").select("sha", "bytes", "keep", F.lit(True).alias("grouped")), "payloads")
    if groups.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(groups), ["sha", "bytes"], "left")
    else:
        salts = 32
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)))
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = dealt.join(spread, ["sha", "bytes", "salt"], "left")
    revisit = F.coalesce("grouped", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("keep"))
    ready = joined.select("id", "url", "payload", "keep", revisit.alias("revisit"))
    made = ready.mapInArrow(partial(_write, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes), "value binary")
    out = made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", records_per_file).option("zlib.compress.level", "BEST_SPEED").text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive's plain bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = _fields(data[at:end])
        size = int(fields["content-length"])
        if len(data) < end + 4 + size:
            raise ValueError("archive ends inside a record")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _inner(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, segment = fields.get("warc-type"), fields.get("warc-segment-number")
    size = sha = payload = problem = stated = None
    if segment is None and kind == "response":
        size, sha, payload, problem = _checked(block, fields.get("warc-payload-digest"))
    elif kind == "revisit":
        found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block)
        stated = int(found[1]) if found else None
    total = fields.get("warc-segment-total-length")
    stated_sha = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    return (
        kind, _inner(fields.get("warc-record-id")), fields.get("warc-target-uri"), _inner(fields.get("warc-refers-to")),
        _inner(fields.get("warc-segment-origin-id")), int(segment) if segment else None, int(total) if total else None,
        stated_sha, stated, size, sha, payload if payloads else None, block if segment else None, problem,
    )


def _checked(block: bytes, stated: str | None) -> tuple[int | None, str | None, bytes | None, str | None]:
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, None, None, str(e)
    sha = digest(payload)
    wrong = stated is not None and stated.removeprefix("sha1:") != sha
    return len(payload), sha, payload, "payload digest differs" if wrong else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            data = content.as_py()
            plain = []
            while data[:2] == b"\x1f\x8b":
                member = zlib.decompressobj(31)
                plain.append(member.decompress(data))
                data = member.unused_data
            rows, size = [], 0
            for fields, block in parse(b"".join([*plain, data])):
                rows.append(_row(fields, block, payloads))
                size += len(block)
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _assemble(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = {x["segment"]: x["block"] for x in r["parts"]}
            block = b"".join(parts[k] for k in sorted(parts))
            size = sha = payload = problem = None
            if sorted(parts) != list(range(1, len(parts) + 1)):
                problem = "a segment is missing"
            elif r["total_length"] != len(block):
                problem = "total length differs"
            else:
                size, sha, payload, problem = _checked(block, r["stated_digest"])
            copies = sum(x["segment"] == 1 for x in r["parts"]) or 1
            row = ("response", r["origin"], r["target_uri"], None, None, None, r["total_length"], r["stated_digest"], None, size, sha, payload if payloads else None, None, problem)
            rows += [row] * copies
        yield _batch(rows)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path``, split ones put together.

    Without ``payloads`` only their sizes and digests come back.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    found = stage(files.select("content").mapInArrow(partial(_read, payloads=payloads), RECORDS), "records")
    whole = found.where("segment is null")
    origin = F.when(F.col("record_type") == "continuation", F.col("origin_id")).otherwise(F.col("record_id"))
    groups = (
        found.where("segment is not null")
        .groupBy(origin.alias("origin"))
        .agg(
            F.max("target_uri").alias("target_uri"),
            F.max("stated_digest").alias("stated_digest"),
            F.max("total_length").alias("total_length"),
            F.collect_list(F.struct("segment", "block")).alias("parts"),
        )
    )
    return whole.union(groups.mapInArrow(partial(_assemble, payloads=payloads), RECORDS))


def pages_of(records: DataFrame) -> DataFrame:
    """Per page record: id, payload size and digest, type and the id referred to."""
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    return records.select(
        page("record_id").alias("page_id"),
        F.coalesce("payload_bytes", "stated_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", F.when(F.col("record_type") == "revisit", F.col("stated_digest"))).alias("payload_digest"),
        "record_type",
        page("refers_to_id").alias("refers_to"),
        "problem",
    )


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """Write all pages to the shared folder, read them back, one row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, **settings)
    return pages_of(read(spark, path, payloads=False))
