"""Writing WARC archives and assembling their records into captures.

Each page gives three records: a request, a response (or a revisit of an equal
payload) and metadata. Request and metadata name the response by
``WARC-Concurrent-To``. Reading parses every record by its Content-Length, then
joins the three kinds through these identifiers into one nested row per capture.
"""

from __future__ import annotations

import functools
import gzip
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm._common import text_bytes

CRLF = "\r\n"
#: Records per archive file, and bytes of pages in it at most: a file is read as one value, of 2 GB at most, and inflated record by record.
FILE_RECORDS, FILE_BYTES = 900, 1 << 30


def _urn(kind: str, page: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}/"), page.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record as binary, without the blank lines that end it; a null field is left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    lines += [F.lit("Content-Length: "), F.length(block).cast("string"), F.lit(CRLF * 2)]
    return F.concat(F.encode(F.concat(*lines), "UTF-8"), block)


def _line(value: Column) -> Column:
    """A header value: line breaks would end the header."""
    return F.regexp_replace(value, "[\r\n]+", " ")


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """``page_id, url, payload, digest, mark, target, target_mark``: ``target`` is the page whose equal payload of at least ``least`` bytes this one revisits, else null.

    ``mark`` is the row's own number, ``target_mark`` that of one row of the target. They hold as
    long as ``pages`` gives its rows in one order each time it is read, as files do.
    """
    payload = text_bytes(pages[html_col])
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("mark"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.length("payload").cast("long")})
    # equal payloads are told by SHA-256; counted before the join, so a payload that stands on many pages costs one row a task
    # (columns are computed again below, which is cheaper than moving payloads)
    same = F.sha2("payload", 256)
    largest = rows.where(F.col("bytes") >= least).groupBy(same.alias("same")).agg(F.max(F.struct("page_id", "mark")).alias("largest"), F.count("*").alias("copies"))
    largest = largest.where("copies > 1").drop("copies")
    keyed = rows.withColumn("same", F.when(F.col("bytes") >= least, same))
    other = F.col("largest.page_id") != F.col("page_id")
    targets = {"target": F.when(other, F.col("largest.page_id")), "target_mark": F.when(other, F.col("largest.mark"))}
    return keyed.join(largest, "same", "left").withColumns(targets).drop("same", "largest")


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """Compressed archives of ``pages`` at ``path``, one file per ``FILE_RECORDS`` records or less, as many fewer as the longest page requires.

    Equal payloads of 1000 bytes or more: the largest page id is the response, the others
    revisit it. A null html is an empty payload, a null url an empty target; line breaks in
    a url become spaces. Each row is one capture with record ids of its own, also where ids
    repeat or are null (metadata then says that the page is ``none``); a revisit refers to
    one response of its target page.
    """
    rows = plan(pages, **columns).withColumn("url", F.coalesce("url", F.lit("")))
    longest = pages.agg(F.max(F.octet_length(columns.get("html_col", "html")))).first()[0] or 0
    each = max(1, min(FILE_RECORDS // 3, FILE_BYTES // (longest + 1)))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    date = F.lit("2024-01-01T00:00:00Z")
    own = F.col("mark").cast("string")
    main = _urn("capture", own)
    common = [("WARC-Target-URI", _line(F.col("url"))), ("WARC-Date", date)]
    http = F.encode(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}"), "UTF-8")
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record("response", [("WARC-Record-ID", main), *common, ("Content-Type", F.lit("application/http;msgtype=response")), digest], F.concat(http, "payload"))
    revisit = _record(
        "revisit",
        [("WARC-Record-ID", main), *common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _urn("capture", F.col("target_mark"))), ("Content-Type", F.lit("application/http;msgtype=response")), digest],
        http,
    )
    request = _record("request", [("WARC-Record-ID", _urn("request", own)), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/http;msgtype=request"))], F.encode(F.concat(F.lit("GET "), _line(F.col("url")), F.lit(f" HTTP/1.1{CRLF * 2}")), "UTF-8"))
    metadata = _record("metadata", [("WARC-Record-ID", _urn("metadata", own)), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/warc-fields"))], F.encode(F.concat(F.lit("page: "), page, F.lit(CRLF)), "UTF-8"))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    three = F.concat(request, end, F.when(F.col("target").isNull(), response).otherwise(revisit), end, metadata)
    rows.select(three.cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", each).option("compression", "gzip").text(path)


def _records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record, inflated one after the other."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)), 1 << 18)
    while stream.readline():  # the version
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line)
        head = dict(x.split(": ", 1) for x in b"".join(lines).decode("utf-8", "replace").split(CRLF)[:-1])
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block


def _row(head: dict[str, str], block: bytes, bodies: bool) -> tuple:
    kind, n, body = head["WARC-Type"], None, block
    if kind == "response":
        start = block.index(b"\r\n\r\n") + 4
        n, body = len(block) - start, block[start:] if bodies else None
    elif kind == "revisit":
        body = b""
    digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    return (kind, head["WARC-Record-ID"], head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"), head.get("WARC-Date"), digest, n, body)


def _parse(bodies: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "concurrent_to", "refers_to", "uri", "date", "digest", "payload_bytes", "body"]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows, size = [], 0
            for head, block in _records(batch.column(0)[i].as_py()):
                rows.append(_row(head, block, bodies))
                size += len(rows[-1][-1] or b"")
                if size > 1 << 22 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, uri string, date string, digest string, payload_bytes long, body binary"


def read(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Every record of the archives at ``path``, one row each; without ``bodies``, those of responses are null. A revisit has no payload, so its length is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(functools.partial(_parse, bodies), RECORD)


def captures(records: DataFrame, with_body: bool = True) -> DataFrame:
    """One nested row per capture: ``record_id, page_id, capture, request, metadata``.

    A capture without request or metadata keeps null there; a request or metadata record
    whose capture is missing gives no row. No record, no row. What a revisit would hold is in the
    capture that it refers to (``resolved``).
    """
    main = records.where(F.col("record_type").isin("response", "revisit"))
    names = ["record_type", "uri", "date", "digest", "payload_bytes", "refers_to"] + ["body"] * with_body
    main = main.select("record_id", F.struct(*names).alias("capture"))
    side = {}
    for kind in ("request", "metadata"):
        part = records.where(F.col("record_type") == kind)
        side[kind] = part.select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", F.decode("body", "UTF-8").alias("text")).alias(kind))
    page = F.regexp_extract("metadata.text", r"page: (-?\d+)", 1)
    joined = main.join(side["request"], "record_id", "left").join(side["metadata"], "record_id", "left")
    return joined.withColumn("page_id", F.when(page != "", page.cast("long")))


def resolved(found: DataFrame) -> DataFrame:
    """Captures (``record_id, page_id, record_type, target_id, payload_bytes`` and others) with the page that a revisit refers to as ``refers_to``, and that page's number of bytes."""
    targets = found.where("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("target_bytes"))
    both = found.join(targets, "target_id", "left")
    return both.withColumn("payload_bytes", F.coalesce("payload_bytes", "target_bytes")).drop("target_bytes", "target_id")
