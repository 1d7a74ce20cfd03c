"""WARC archives without repeated payloads: revisit records point to the one response that holds a payload.

1. Headers only (page, address, SHA-1 and length of the payload) are shuffled by payload digest; of
   payloads that occur more than once and have ``MIN_BYTES`` at least, the original is the page with the
   largest number.
2. Captures meet the original of their digest. An original and every payload of its own is written as a
   ``response``, the others as a ``revisit`` that refers to the original and has no payload. All headers
   are written afresh: record id, target, digests, lengths.
3. Archives are files of Spark's text writer whose line separator is the end of a record; each file is
   one gzip stream. They are read back the same way, a piece at a time: no task holds more than a batch of
   pieces and one record, however large an archive is.
4. Revisits are resolved by a join of their ``WARC-Refers-To`` with the record ids of responses.

Defined results: a null or empty payload has 0 bytes; a null number or address leaves out its header, and
a null number is smaller than all others; of rows that repeat the original exactly one is the response, as
it is one capture of several, and rows with one number and payload differ by address; line breaks in
an address are written percent-encoded; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropwind.sources.paths import scratch_path, written

#: Payloads below this are written each time.
MIN_BYTES = 1000
#: Records are dated by the caller, as captures have no time of their own.
DATE = "2025-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
STATUS = "HTTP/1.1 200 OK"
CONTENT = "text/html; charset=utf-8"

_RECORD = "record_type string, record_id string, refers_to_id string, page_id long, url string, payload_digest string, payload_bytes long, payload binary"


def _captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, bytes`` of every row."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})


def originals(captures: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``digest, o_page, o_url, copies`` for payloads that occur more than once.

    ``copies`` counts the rows that repeat the original with number and address. Only headers move, and
    equal ones are counted inside each task first, so a digest may hold any share of the rows.
    """
    seen = captures.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("copies"))
    one = seen.groupBy("digest").agg(F.max(F.struct("page_id", "url", "copies")).alias("best"), F.sum("copies").alias("total"))
    one = one.where("total > 1")
    return one.select("digest", F.col("best.page_id").alias("o_page"), F.col("best.url").alias("o_url"), F.col("best.copies").alias("copies"))


def record_id(digest: Column, page_id: Column, url: Column) -> Column:
    """The id of an original: the same wherever it is worked out."""
    name = F.md5(F.concat_ws("|", digest, F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """One header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{LINE}{name}: "), value), F.lit(""))


def _written_url(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(date: str) -> Column:
    """A record of ``page_id, url, digest, bytes, payload, own_id, refers_to, o_url`` up to its end mark."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"{STATUS}{LINE}Content-Type: {CONTENT}{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.col("own_id")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", _written_url(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("WARC-Refers-To-Target-URI", F.when(revisit, _written_url(F.col("o_url")))),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(RECORD_END),
        block,
    )


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write one record for each row to gzip archives under ``path``."""
    captures = _captures(pages)
    first = written(originals(captures, min_bytes), "warc-originals")
    known = first.withColumn("o_id", record_id(F.col("digest"), F.col("o_page"), F.col("o_url")))
    # One row for each digest: a hot one is split on the side of the captures.
    met = captures.join(known.withColumnRenamed("digest", "o_digest"), F.col("digest") == F.col("o_digest"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("o_page")) & F.col("url").eqNullSafe(F.col("o_url"))
    met = met.withColumn("is_first", is_first & F.col("o_id").isNotNull())
    columns = ["page_id", "url", "digest", "bytes", "payload", F.when(F.col("is_first"), F.col("o_id")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("own_id"), F.when(~F.col("is_first"), F.col("o_id")).alias("refers_to"), "o_url"]
    # Of rows that repeat an original, one is the response.
    rows = met.where(~F.col("is_first") | (F.col("copies") == 1)).select(*columns)
    repeated = known.where("copies > 1")
    if not repeated.isEmpty():
        same = met.where(F.col("is_first") & (F.col("copies") > 1))
        one = same.groupBy("digest", "page_id", "url", "bytes", "o_id", "o_url", "is_first").agg(F.first("payload").alias("payload"))
        again = same.select("digest", "bytes").distinct().join(repeated, "digest").withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies"))))
        again = again.select(F.col("o_page").alias("page_id"), F.col("o_url").alias("url"), "digest", "bytes", F.lit("").alias("payload"), F.lit(False).alias("is_first"), "o_id", "o_url")
        rows = rows.unionByName(one.select(*columns)).unionByName(again.select(*columns))
    rows.select(_record(date).alias("record")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode().split(LINE)
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}


def _parsed(pieces: Iterator[bytes], payloads: bool) -> Iterator[tuple]:
    """Records of a run of pieces that were cut at ``RECORD_END``, wherever it stood."""
    end = RECORD_END.encode()
    headers: dict[str, str] | None = None
    block, size, need = [], 0, 0
    for piece in pieces:
        if headers is None:
            # What is left of an end mark that a payload's last line break began.
            start = piece.lstrip(b"\r\n")
            if not start:
                continue
            if not start.startswith(VERSION.encode()):
                raise ValueError("an archive's record does not begin with its version")
            headers = _headers(start)
            block, size, need = [], 0, int(headers["content-length"])
            if need:
                continue
        else:
            for part in (piece, end):
                block.append(part)
                size += len(part)
                if size >= need:
                    break
            if size < need:
                continue
        yield _as_row(headers, b"".join(block)[:need], payloads)
        headers = None
    if headers is not None:
        raise ValueError("an archive ends inside a record")


def _as_row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    top, _, payload = block.partition(RECORD_END.encode())
    kind, page = headers["warc-type"], headers.get("x-page-id")
    # A revisit tells the length of the payload that it stands for.
    size = len(payload) if kind == "response" else int(_headers(top)["content-length"])
    if kind == "response" and int(_headers(top)["content-length"]) != size:
        raise ValueError(f"record {headers['warc-record-id']} has another length than it says")
    return (
        kind, headers["warc-record-id"], headers.get("warc-refers-to"), None if page is None else int(page), headers.get("warc-target-uri"),
        headers["warc-payload-digest"].removeprefix("sha1:"), size, payload if payloads and kind == "response" else None,
    )


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of archives: ``record_type, record_id, refers_to_id, page_id, url, payload_digest, payload_bytes, payload``.

    Payloads are those of responses; ``payloads=False`` leaves them out. Only gzip archives are read, as
    Spark never cuts these.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for row in _parsed((piece.as_py() for batch in batches for piece in batch.column("piece")), payloads):
            rows.append(row)
            size += len(row[-1] or b"")
            if len(rows) >= 2_000 or size >= 16 << 20:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    pieces = spark.read.option("lineSep", RECORD_END).option("pathGlobFilter", "*.gz").text(path)
    return pieces.select(F.col("value").cast("binary").alias("piece")).mapInArrow(run, _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``, the number of the page whose response a revisit stands for, and that response's payload.

    A revisit whose response is not among the records keeps its own digest and has no number.
    """
    has = "payload" in records.columns
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("r_id"), F.col("page_id").alias("r_page"), *([F.col("payload").alias("r_payload")] if has else []))
    rows = records.join(responses, F.col("refers_to_id") == F.col("r_id"), "left")
    own = [c for c in records.columns if c != "payload"]
    return rows.select(*own, F.col("r_page").alias("refers_to"), *([F.coalesce("payload", "r_payload").alias("payload")] if has else []))


def digest(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from the archives written.

    Bytes and digests of responses are taken from the payload that was read back.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc-archives")
    write(pages, path)
    records = read(spark, path).withColumn("payload_digest", F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest")))
    # Written without payloads, as both sides of the join read it.
    records = written(records.drop("payload", "url"), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH captures AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), placed AS (
  SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS original, first_value(url) OVER same AS first_url
  FROM captures WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, encode(url) DESC NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN original END AS refers_to
FROM placed
"""
