"""Operator 2, WARC archives: writing, reading back, and segment reassembly.

Every row is a record of its own.  A page's HTTP response is sent in chunks and
stored as one record, or, where its block is longer than a segment, as a first
segment and continuation records.  Reading groups the segments by the
identifier of their origin, orders them by number, verifies the total length,
and decodes the chunked transfer.  Pages whose payload an earlier page has are
stored as revisit records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, shared_folder, whole_texts

CRLF = b"\r\n"
#: Bytes of a record's block at most; longer blocks are cut into segments.  Most pages are longer.
SEGMENT_BYTES = 1 << 10
#: Bytes of a chunk of the transfer.
CHUNK_BYTES = 1 << 9
#: Records of a file at most: with the segment size this bounds what a reader holds.
FILE_RECORDS = 8000
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pieces(data: bytes, size: int) -> list[bytes]:
    """Parts of about ``size`` bytes, cut between characters of UTF-8."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:end])
        at = end
    return parts


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in pieces(payload, size)) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked transfer; a frame that doesn't fit is an error."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk's length is wrong")
        parts.append(body[at : at + size])
        at += size + 2


def _record(kind: str, name: str, uri: str, block: bytes, **fields: object) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": _DATE, "WARC-Target-URI": uri, "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    if kind != "continuation":
        head["Content-Type"] = "application/http; msgtype=response"
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + block.decode()


def page_records(page_id: object, url: str | None, html: str, first: object = None, serial: str = "1", segment: int = SEGMENT_BYTES) -> list[str]:
    """The records of one page, each without its closing blank lines.

    ``first``: the page it revisits, if any; ``serial`` tells records of equal pages apart.
    """
    payload = html.encode()
    mark = digest(payload)
    name = f"<urn:page:{page_id}:{mark}:{serial}>"
    uri = "".join((url or "").split()) or f"urn:page:{page_id}"
    if first is not None:
        return [_record("revisit", name, uri, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest=f"sha1:{mark}", WARC_Refers_To=f"<urn:page:{first}:{mark}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = pieces(block, segment)
    if len(parts) == 1:
        return [_record("response", name, uri, block, WARC_Payload_Digest=f"sha1:{mark}")]
    out = [_record("response", name, uri, parts[0], WARC_Payload_Digest=f"sha1:{mark}", WARC_Segment_Number=1)]
    for k, part in enumerate(parts[1:], 2):
        out.append(_record("continuation", f"{name[:-1]}:{k}>", uri, part, WARC_Segment_Origin_ID=name, WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(parts) else None))
    return out


def write(pages: DataFrame, folder: str, *, segment: int = SEGMENT_BYTES) -> None:
    """Writes (page_id, url, html, first) rows as compressed archives; Spark's text writer puts the blank lines between records.

    A record's name has its task's number and its place there, so it is unique in the folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for x in batch.slice(i, 64).to_pylist():
                    n += 1
                    out += page_records(x["page_id"], x["url"], x["html"], x["first"], f"{task}-{n}", segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])

    pages.mapInArrow(run, "record string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(folder)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(CRLF + CRLF, at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size or content[end + 4 + size : end + 8 + size] != CRLF + CRLF:
            raise ValueError("a record's length is wrong")
        yield fields, block
        at = end + 8 + size


def decode(numbers: list[int], total: int | None, blocks: list[bytes], mark: str | None) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a response's segments in order; ``total`` is what the last of them says."""
    block = b"".join(blocks)
    if numbers != list(range(1, len(numbers) + 1)):
        return None, "a segment is missing or repeated"
    if total is not None and total != len(block):
        return None, "the total length is wrong"
    head, _, body = block.partition(CRLF + CRLF)
    try:
        payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return None, str(e)
    return (None, "the digest is wrong") if mark is not None and digest(payload) != mark else (payload, None)


RECORDS = "name string, kind string, payload_digest string, refers string, uri string, payload binary, problem string"
#: A row of segments has those of one origin that one file holds: their numbers, sizes, and blocks, joined and compressed.
SEGMENTS = RECORDS + ", origin string, numbers array<int>, sizes array<int>, total long, block binary"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_KINDS = [*[pa.string()] * 5, pa.binary(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary()]


def file_rows(content: bytes) -> list[tuple]:
    """The rows of one archive, as SEGMENTS has them: whole records decoded, segments gathered by origin."""
    rows, found = [], {}
    for f, block in parse(content):
        number, mark = f.get("warc-segment-number"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        about = (mark, f.get("warc-refers-to"), f.get("warc-target-uri"))
        if number is None:
            payload, problem = decode([1], None, [block], mark) if f["warc-type"] == "response" else (None, None)
            rows.append((f["warc-record-id"], f["warc-type"], *about, payload, problem, None, None, None, None, None))
            continue
        origin = f.get("warc-segment-origin-id", f["warc-record-id"])
        parts = found.setdefault(origin, ([], [], [], []))
        parts[0].append(int(number))
        parts[1].append(block)
        parts[2].append(about)
        if total := f.get("warc-segment-total-length"):
            parts[3].append(int(total))
    pack = zstandard.ZstdCompressor(level=1)
    for origin, (numbers, blocks, abouts, totals) in found.items():
        mark, _, uri = next((a for a in abouts if a[0]), abouts[0])
        rows.append((None, "segments", mark, None, uri, None, None, origin, numbers, [len(b) for b in blocks], max(totals, default=None), pack.compress(b"".join(blocks))))
    return rows


def read(spark, folder: str) -> DataFrame:
    """The records of all archives in a folder: whole ones decoded, one row each; the segments of a file by their origin."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if rows := file_rows(gzip.decompress(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").mapInArrow(run, SEGMENTS)


def joined(parts: list[dict]) -> tuple[list[int], list[bytes]]:
    """(numbers, blocks) in the order of the numbers, from rows of segments."""
    out, unpack = [], zstandard.ZstdDecompressor()
    for p in parts:
        body, at = unpack.decompress(p["block"]), 0
        for number, size in zip(p["numbers"], p["sizes"], strict=True):
            out.append((number, body[at : at + size]))
            at += size
    out.sort(key=lambda x: x[0])
    return [n for n, _ in out], [b for _, b in out]


def reassemble(records: DataFrame) -> DataFrame:
    """(name, kind, payload_digest, refers, uri, payload, problem): whole records of archives.

    Only segments are shuffled; a group is one record's segments.  ``problem``
    says what is wrong (a segment missing or repeated, a wrong total length,
    chunk or digest) and the payload is then null; else it is null.
    """
    grouped = (
        records.where(F.col("origin").isNotNull())
        .groupBy("origin")
        .agg(F.collect_list(F.struct("numbers", "sizes", "block")).alias("parts"), F.max("total").alias("total"), F.max("payload_digest").alias("payload_digest"), F.max("uri").alias("uri"))
        .select("origin", "payload_digest", "uri", F.coalesce("total", F.lit(-1)).alias("total"), "parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                n = part.num_rows
                found = []
                for x in part.to_pylist():
                    numbers, blocks = joined(x["parts"])
                    found.append(decode(numbers, x["total"], blocks, x["payload_digest"]))
                payload, problem = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["response"] * n), part.column(1), pa.nulls(n, pa.string()), part.column(2), pa.array(payload, pa.binary()), pa.array(problem, pa.string())], _NAMES)

    return records.where(F.col("origin").isNull()).select(*_NAMES).unionByName(grouped.mapInArrow(run, RECORDS))


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes all pages to archives in the shared folder, a record a row, and reads them back.

    Returns (id, kind, payload_digest, payload_bytes, refers_to, uri, problem)
    per row.  A null html counts as empty, a null or empty url as the page's
    own urn; blanks in a url go.  The smallest id of a payload is the response;
    rows that share that id and payload are all responses.  A null id is never
    what others revisit, and a response only where no other page has its
    payload.  Ids must be integers; further columns of any name are left out;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = whole_texts(pages, 500).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("mark", F.sha1(F.col("html").cast("binary")))
    # The first page of each payload: partial minima make a payload that many pages share one row per task.
    firsts = rows.groupBy("mark").agg(F.min("page_id").alias("first"))
    own = F.col("page_id").eqNullSafe(F.col("first")) | (F.octet_length("html") < least)
    stored = rows.join(firsts.hint("merge"), "mark").withColumn("first", F.when(own, None).otherwise(F.col("first")))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(stored.select("page_id", "url", "html", "first"), folder, segment=segment)
    found = kept(reassemble(read(spark, folder)).select("name", "kind", "payload_digest", "refers", "uri", F.length("payload").cast("long").alias("payload_bytes"), "problem"))

    def number(name: str):
        digits = F.regexp_extract(name, r"^<urn:page:(-?\d+):", 1)
        return F.when(digits != "", digits.try_cast("long"))

    # A revisit names the page and the payload; any response of that page has the payload's size.
    response = found.where("kind = 'response'")
    sizes = response.select(F.regexp_replace("name", r":\d+-\d+>$", ">").alias("refers"), "payload_bytes").groupBy("refers").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = found.where("kind = 'revisit'").drop("payload_bytes").join(sizes.hint("merge"), "refers", "left")
    return response.unionByName(again).select(number("name").alias(id_col), "kind", "payload_digest", "payload_bytes", number("refers").alias("refers_to"), "uri", "problem")
