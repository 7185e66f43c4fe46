"""WARC archives of pages: writing with segmentation, reading with reassembly.

Writing.  Every page is a record; those longer than a segment are cut into a
first segment and continuation records, and the payload travels in chunked
transfer framing under an HTTP header.  Of the records with equal payloads of at
least ``revisit_from`` bytes, that with the smallest page_id is a response and
the others are revisits without a payload; only digests and ids are shuffled to
decide that, and payloads only where the table of repeated digests is too large
for a broadcast.  Every record is a gzip member of its own.  A member ends with
the highest byte of its length, which is 0, and Spark's text writer adds that byte
as its line end, so that it puts standard archives into any store that it reaches.

Reading.  Archives are decompressed and parsed once, record by record, by their
Content-Length; what is read is stored.  Segments are grouped by their origin's
identifier, repeated ones combined before the shuffle, ordered by segment number
and joined; the total length that the last one states is verified; the HTTP header
is cut off and the chunked framing decoded.  Revisits take length and digest from
the response they refer to, by a join, and check it against their own header.

Memory: a task holds one compressed archive (``ARCHIVE_BYTES`` of records, about)
and one record at a time; a group is one record, which fits in memory by definition.

Defined results: a null html is an empty payload; a null page_id is kept as
null (ordered last when the response is chosen); fully repeated rows are
records with the same identifier, which reassembly counts and returns as often
as they were written; rows that share page_id and payload are all responses if
that id is the smallest; an empty table gives no records.  Extra columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import delete, forget, shared_path, ship, written

#: Bytes of a chunk and of a segment; ordinary pages are longer than both.
CHUNK = 1024
SEGMENT = 2048
#: Bytes of the records of one archive, about, and records in it at most.
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 2000
RECORD_END = "\r\n\r\n"

RESULT = "record_id string, page_id long, target_uri string, record_type string, refers_to_record string, payload_bytes long, payload_digest string, stated_digest string, payload binary, problem string"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    out = [b"%X\r\n%s\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        n = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if at + n + 2 > len(framed) or framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("cut chunk")
        out.append(framed[at : at + n])
        at += n + 2


def _header(fields: dict[str, object]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"


def _pieces(block: bytes, size: int) -> list[bytes]:
    """A block in segments of about ``size`` bytes, never cut inside a character."""
    out, at = [], 0
    while at < len(block) or not out:
        end = min(len(block), at + size)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        out.append(block[at:end])
        at = end
    return out


def records_of(page_id: int | None, url: str | None, payload: str, digest: str, revisit_of: str | None, segment: int = SEGMENT, chunk: int = CHUNK) -> list[str]:
    """The WARC records of one page, without the line ends that close them."""
    raw = payload.encode()
    name = "none" if page_id is None else str(page_id)
    key = hashlib.sha1((url or "").encode() + b"\0" + raw).hexdigest()[:16]
    record_id = f"<urn:page:{name}:{key}>"
    common = {"WARC-Target-URI": re.sub(r"[\r\n]", "%0A", url) if url else None, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest}"}
    if revisit_of is not None:
        block = "HTTP/1.1 200 OK\r\n\r\n"
        fields = {"WARC-Type": "revisit", "WARC-Record-ID": record_id, "WARC-Refers-To": revisit_of, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **common}
        return [_header({**fields, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}) + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked_text(raw, chunk)
    parts = _pieces(block, segment)
    out = []
    for i, part in enumerate(parts, 1):
        fields = {"WARC-Type": "response" if i == 1 else "continuation", "WARC-Record-ID": record_id if i == 1 else f"{record_id[:-1]}:{i}>"}
        fields |= common if i == 1 else {"WARC-Date": common["WARC-Date"], "WARC-Segment-Origin-ID": record_id}
        if len(parts) > 1:
            fields |= {"WARC-Segment-Number": i, "WARC-Segment-Total-Length": len(block) if i == len(parts) else None}
        out.append(_header({**fields, "Content-Type": "application/http; msgtype=response" if i == 1 else None, "Content-Length": len(part)}) + part.decode())
    return out


def _chunked_text(raw: bytes, size: int) -> bytes:
    """Chunked framing whose chunks end between characters, so that a record is valid UTF-8 text."""
    return b"".join([*(b"%X\r\n%s\r\n" % (len(c), c) for c in _pieces(raw, size) if c), b"0\r\n\r\n"])


def gzip_member(record: bytes, step: int = 8 << 20) -> bytes:
    """A record as a gzip member without its last byte, which is 0; very long ones take several members."""
    out = []
    for at in range(0, len(record), step):
        c = zlib.compressobj(3, zlib.DEFLATED, 31)
        out += [c.compress(record[at : at + step]), c.flush()]
    return b"".join(out)[:-1]


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one archive or more for each partition of ``pages`` below ``path``."""
    ship(pages.sparkSession)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    size, sha = F.octet_length("html"), F.sha1(F.col("html").cast("binary"))
    # One row for each payload; copies are combined before the shuffle.  The table is stored, so that its size is known when the join is planned.
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.substring(F.sha1(F.concat(F.coalesce(F.col("url"), F.lit("")), F.lit("\0"), F.col("html")).cast("binary")), 1, 16).alias("key")))
    groups = base.where(size >= revisit_from).groupBy(sha.alias("sha")).agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.col("first.page_id").alias("first_id"), F.col("first.key").alias("first_key"))
    groups = written(groups, "payloads")
    judged = base.withColumn("sha", sha).join(groups, "sha", "left")
    revisit = F.col("first_key").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    to = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first_id").cast("string"), F.lit("none")), F.lit(":"), F.col("first_key"), F.lit(">"))
    ready = judged.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "sha", F.when(revisit, to).alias("revisit_of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out: list[bytes] = []
                for r in batch.slice(at, 500).to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    out += [gzip_member((x + RECORD_END).encode()) for x in records_of(r["page_id"], r["url"], r["html"], digest, r["revisit_of"], segment, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = ready.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", max(1, min(ARCHIVE_RECORDS, ARCHIVE_BYTES // segment))).text(path)
    forget(groups)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _blocks(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The bytes of an archive piece by piece; of gzip archives any members."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), 1 << 20):
            yield data[at : at + (1 << 20)]
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        rest = data[at : at + step]
        while rest:
            yield member.decompress(rest)
            rest = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def _record(data: bytearray, at: int) -> tuple[dict[str, object], int] | None:
    """The record at a place and the place after it; None if there is more of it to come."""
    end = data.find(b"\r\n\r\n", at) + 4
    if end < 4:
        return None
    if not data.startswith(b"WARC/", at):
        raise ValueError("no record where one should start")
    fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data, data.index(b"\r\n", at) + 2, end - 2)}
    n = int(fields["content-length"])
    if len(data) < end + n + 4:
        return None
    if not data.startswith(b"\r\n\r\n", end + n):
        raise ValueError("a record does not have its length")
    record_id = fields["warc-record-id"]
    origin = fields.get("warc-segment-origin-id", record_id)
    name = origin.split(":")[2] if origin.startswith("<urn:page:") else "none"
    record = {
        "segmented": "warc-segment-number" in fields, "record_id": record_id, "page_id": None if name == "none" else int(name), "record_type": fields["warc-type"],
        "segment": int(fields.get("warc-segment-number", 1)), "origin": origin, "total_length": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
        "refers_to": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "target_uri": fields.get("warc-target-uri"), "block": bytes(data[end : end + n]),
    }
    return record, end + n + 4


def parse_archive(data: bytes) -> Iterator[dict[str, object]]:
    """The records of an archive, by their headers' Content-Length."""
    held, at = bytearray(), 0
    for block in _blocks(data):
        held += block
        while at < len(held) and (found := _record(held, at)):
            record, at = found
            yield record
        if at > 1 << 20 or at == len(held):
            del held[:at]
            at = 0
    if held:
        raise ValueError("the archive ends within a record")


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _done(record: dict[str, object], block: bytes, problem: str | None, keep: bool) -> dict[str, object]:
    payload: bytes | None = None
    if problem is None and record["record_type"] == "response":
        try:
            payload = _payload(block)
        except ValueError as e:
            problem = str(e)
    own = digest32(payload) if payload is not None else None
    if own is not None and record["payload_digest"] and own != record["payload_digest"]:
        problem = "digest differs"
    return {
        "record_id": record["record_id"], "page_id": record["page_id"], "target_uri": record["target_uri"], "record_type": record["record_type"], "refers_to_record": record["refers_to"],
        "payload_bytes": None if payload is None else len(payload), "payload_digest": own, "stated_digest": record["payload_digest"], "payload": payload if keep else None, "problem": problem,
    }


_FIELDS = [("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())]
_RESULT_SCHEMA = pa.schema(_FIELDS)
_PARSED_SCHEMA = pa.schema([*_FIELDS, ("origin", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
PARSED = f"{RESULT}, origin string, segment int, total_length long, block binary"


def joined_segments(segments: list[dict[str, object]], keep_payload: bool = True) -> list[dict[str, object]]:
    """The record that segments of one origin make up, as often as it was written.

    Segments must be numbered from 1 without a gap, each as often as the first,
    and as long together as the last one states; else the record is returned
    without a payload and with the problem named.
    """
    by_number: dict[int, list[dict[str, object]]] = {}
    for x in segments:
        by_number.setdefault(int(x["segment"]), []).append(x)
    first = by_number.get(1, segments)[0]
    ordered = [by_number[n][0] for n in sorted(by_number)]
    block = b"".join(x["block"] for x in ordered)
    times = len(by_number.get(1, [0]))
    problem = None
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or any(len(x) != times for x in by_number.values()):
        problem = "a segment is missing"
    elif ordered[-1]["total_length"] is None or int(ordered[-1]["total_length"]) != len(block):
        problem = "total length differs"
    return [_done(first, block, problem, keep_payload)] * times


def parsed_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``, stored: whole ones finished, segments with origin, number, stated total length and block."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict[str, object]] = []
        for batch in batches:
            for content in batch.column(0):
                for r in parse_archive(content.as_buffer().to_pybytes()):
                    if r["segmented"]:
                        names = ("record_id", "page_id", "target_uri", "record_type", "origin", "segment", "total_length", "block")
                        rows.append({k: r[k] for k in names} | {"refers_to_record": r["refers_to"], "stated_digest": r["payload_digest"]})
                    else:
                        rows.append(_done(r, r["block"], None, keep_payload))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=_PARSED_SCHEMA)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PARSED_SCHEMA)

    return written(files.mapInArrow(run, PARSED), "parsed")


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The whole records of the archives below ``path``: ``RESULT``.

    Records in one piece are finished where they are read; only segments are
    shuffled and grouped.
    """
    return whole_records(parsed_archives(spark, path, keep_payload), keep_payload)


def whole_records(parsed: DataFrame, keep_payload: bool = True) -> DataFrame:
    """``RESULT`` of every record of ``parsed_archives``, segments joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts, n, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segments = [x | {"block": x["block"].encode(), "refers_to": x["refers_to_record"], "payload_digest": x["stated_digest"]} for x in parts]
                (row,) = joined_segments(segments, keep_payload)[:1]
                if n != times * len(parts):
                    row |= {"payload_bytes": None, "payload_digest": None, "payload": None, "problem": "a segment is missing"}
                rows.append(row | {"times": max(1, times)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*_FIELDS, ("times", pa.int64())]))

    names = [x for x, _ in _FIELDS]
    # Blocks are whole characters; as text, repeated segments are equal and combined before the shuffle.
    part = F.struct("segment", "total_length", "record_id", "page_id", "target_uri", "record_type", "refers_to_record", "stated_digest", F.col("block").cast("string").alias("block"))
    groups = parsed.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_set(part).alias("parts"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("segment") == 1).alias("times"))
    joined = groups.select("parts", "n", "times").mapInArrow(run, f"{RESULT}, times long")
    often = joined.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*names)
    return parsed.where("origin IS NULL").select(*names).unionByName(often)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, page_id, target_uri, record_type, refers_to (page_id), payload_bytes, payload_digest, problem of every record."""
    named = records.select("record_id", "page_id", "target_uri", "record_type", "refers_to_record", "payload_bytes", "payload_digest", "stated_digest", "problem")
    found = named.where("record_type = 'response'").groupBy(F.col("record_id").alias("to")).agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("of"))
    # Responses meet themselves, so that their rows are spread by their own identifiers.
    out = named.join(found, F.when(F.col("record_type") == "revisit", F.col("refers_to_record")).otherwise(F.col("record_id")) == F.col("to"), "left")
    revisit = F.col("record_type") == "revisit"
    lost = revisit & (F.col("of").isNull() | (F.col("of.payload_digest") != F.col("stated_digest")))
    return out.select(
        "record_id", "page_id", "target_uri", "record_type",
        F.when(revisit, F.col("of.page_id")).alias("refers_to"),
        F.when(revisit, F.col("of.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("of.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(lost, F.lit("the response is missing")).otherwise(F.col("problem")).alias("problem"),
    )


def round_trip(pages: DataFrame, revisit_from: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and delete them; a record with a problem ends the job."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, revisit_from, segment, chunk)
    parsed = parsed_archives(spark, path, keep_payload=False)
    delete(spark, path)
    records = written(whole_records(parsed, keep_payload=False).drop("payload"), "records")
    forget(parsed)
    back = resolve_revisits(records)
    bad = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("WARC record "), F.col("record_id"), F.lit(": "), F.col("problem"))))
    return back.select("page_id", "payload_bytes", F.coalesce(bad.cast("string"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
