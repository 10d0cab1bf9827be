"""WARC archives: segmented, chunk-framed records, and their reassembly.

Writing. A page is a record with an HTTP block in chunked transfer framing. A block longer than
``segment_bytes`` is cut, never inside a character: the first piece stays in the record, the others are
continuation records that name their origin and number; the last carries the total length. Of rows
with equal payloads of at least ``revisit_bytes`` the one with the largest page id is the response and the
others are revisits without a payload that name its record. Files are written by Spark's text writer
with the record separator as line separator, so commits are Spark's own; a line is a run of records of
about 1 MB, so files close at about ``file_bytes``.

Reading. Archives are cut into records by their content lengths. Only continued records are shuffled:
they are grouped by origin, ordered by segment number, checked for gaps and against the total length,
and joined. The framing is then decoded, and revisits take payload length from the response they
name.

Defined cases: a null payload is empty; a null page id gets no id header and comes back null, and such
a row is never the response of others; rows with the same id and payload get the same record
id and come back as often as they went in; an empty table gives no rows. Extra columns are not
written. Payloads of any length are streamed in segments; one payload is at most one row's value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import store
from assayer.session import shared_dir

SEGMENT_BYTES = 16 * 1024
FILE_BYTES = 32 << 20  # a file is one row where it is read, so this bounds a task's memory
CHUNK_BYTES = 4096
REVISIT_BYTES = 1000

_END = "\r\n\r\n"
_OUT_BYTES = 1 << 20

SEGMENT = "archive string, record_id string, kind string, page_id long, refers_to string, digest string, number int, total long, block binary"


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that never end inside a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def http_block(payload: bytes) -> bytes:
    """HTTP response with the payload in chunked transfer framing."""
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cut(payload, CHUNK_BYTES))
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks + b"0\r\n\r\n"


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP block; chunked framing is decoded and must be whole."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP block without an end of its headers")
    if not re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head):
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: dict[str, object], block: bytes) -> str:
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n" + block.decode("utf-8")


def _records(page_id, url: str, record_id: str, digest: str, refers_to: str | None, html: str, segment_bytes: int) -> Iterator[str]:
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:md5:{record_id}>", "X-Page-Id": page_id,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record(head | {"WARC-Profile": profile, "WARC-Refers-To": f"<urn:md5:{refers_to}>"}, b"")
        return
    pieces = _cut(http_block(html.encode("utf-8", "replace")), segment_bytes)
    total = sum(map(len, pieces))
    yield _record(head | {"WARC-Segment-Number": 1 if len(pieces) > 1 else None}, pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        yield _record(
            {
                "WARC-Type": "continuation", "WARC-Record-ID": f"<urn:md5:{record_id}-{number}>", "WARC-Segment-Origin-ID": f"<urn:md5:{record_id}>",
                "WARC-Segment-Number": number, "WARC-Segment-Total-Length": total if number == len(pieces) else None,
            },
            piece,
        )


def write(
    pages: DataFrame, folder: str | None = None, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES,
    page_id: str = "page_id", url: str = "url", payload: str = "html",
) -> str:
    """Writes the archives and returns their folder."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    html = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"),
    )

    def record_id(page: str) -> Column:
        return F.md5(F.concat_ws("|", F.coalesce(F.col(page).cast("string"), F.lit("")), "digest"))

    # only digests that come more than once: the table joined with the pages is small against them
    copies = store(
        rows.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
        .filter("n > 1 AND last IS NOT NULL").select(F.col("digest").alias("of"), "last"),
        "warc-copies",
    )
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    planned = rows.join(copies, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", record_id("page_id").alias("record_id"), "digest", F.when(revisit, record_id("last")).alias("refers_to"),
        F.when(~revisit, F.col("html")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is a run of records of about _OUT_BYTES, so that a number of rows bounds the bytes of a file
        out, held = [], 0
        for batch in batches:
            for row in zip(*(batch[c] for c in batch.schema.names)):
                for record in _records(*(x.as_py() for x in row), segment_bytes):
                    out.append(record)
                    held += len(record)
                    if held > _OUT_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": [_END.join(out)]})
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"value": [_END.join(out)]})

    planned.mapInArrow(run, "value string").write.option("lineSep", _END).option("maxRecordsPerFile", max(1, file_bytes // _OUT_BYTES)).text(folder)
    return folder


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, cut by content length."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        lines = archive[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        at = end + 4
        size = int(headers["content-length"])
        if archive[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("record length and content differ")
        yield headers, archive[at : at + size]
        at += size + 4


def segments(spark, folder: str) -> DataFrame:
    """One row per record of all archives of a folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SEGMENT.split(", "))])
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for h, block in parse(content.as_py()):
                    number = lambda name: int(h[name]) if name in h else None
                    rows.append(
                        {
                            "archive": archive.as_py(), "record_id": h.get("warc-segment-origin-id", h["warc-record-id"]), "kind": h["warc-type"],
                            "page_id": number("x-page-id"), "refers_to": h.get("warc-refers-to"), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:"),
                            "number": number("warc-segment-number"), "total": number("warc-segment-total-length"), "block": block,
                        }
                    )
                    held += len(block)
                    if held > _OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    return files.mapInArrow(run, SEGMENT)


def _payloads(rows: DataFrame) -> DataFrame:
    """(record_id, page_id, digest, payload) of whole HTTP blocks, digests verified."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                payloads = [http_payload(b.as_py()) for b in part["block"]]
                for payload, digest in zip(payloads, part["digest"]):
                    if digest.as_py() and hashlib.sha1(payload).hexdigest() != digest.as_py():
                        raise ValueError("payload digest differs")
                yield pa.RecordBatch.from_arrays(
                    [part["record_id"], part["page_id"], part["digest"], pa.array(payloads, pa.binary())], ["record_id", "page_id", "digest", "payload"]
                )

    return rows.select("record_id", "page_id", "digest", "block").mapInArrow(run, "record_id string, page_id long, digest string, payload binary")


def reassemble(parts: DataFrame) -> DataFrame:
    """Continued records made whole: (record_id, page_id, digest, block), as often as the record was written."""
    distinct = parts.groupBy("record_id", "number").agg(
        F.count("*").alias("n"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.first("block").alias("block")
    )
    whole = distinct.groupBy("record_id").agg(
        F.expr("listagg(block) WITHIN GROUP (ORDER BY number)").alias("block"), F.count("*").alias("pieces"), F.min("number").alias("first"), F.max("number").alias("last"),
        F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("n").alias("n"),
    )
    fits = (F.col("first") == 1) & (F.col("last") == F.col("pieces")) & (F.octet_length("block") == F.col("total"))
    checked = whole.withColumn(
        "block", F.when(fits, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing: "), F.col("record_id"))).cast("binary"))
    )
    return checked.select("record_id", "page_id", "digest", "block", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")


def read(spark, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload, payload_bytes); a revisit has no payload of its own.

    The lengths of revisits, and the page they refer to, come from the response their header names.
    """
    records = segments(spark, folder)
    responses = _payloads(
        records.filter("kind = 'response' AND number IS NULL").select("record_id", "page_id", "digest", "block")
        .union(reassemble(records.filter("number IS NOT NULL")))
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = records.filter("kind = 'revisit'").select("page_id", F.col("refers_to").alias("named"), "digest")
    targets = responses.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"), "payload_bytes").join(
        revisits.select("named").distinct(), F.col("of") == F.col("named"), "left_semi"
    ).distinct()
    resolved = revisits.join(targets, F.col("named") == F.col("of"), "left").select(
        "page_id", F.lit("revisit").alias("record_type"), "refers_to", "digest", F.lit(None).cast("binary").alias("payload"), "payload_bytes"
    )
    return responses.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest", "payload", "payload_bytes").union(resolved)
