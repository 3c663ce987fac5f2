"""WARC archives with revisit records for repeated payloads.

Writing: the records' headers, with their payload digests, are shuffled and aggregated by digest; of the records with
equal payloads the one with the smallest id keeps its payload, the others become revisit records that name it, and
every record gets fresh headers.  A record is a string of its header block and its payload, and Spark's own text writer
ends each with the two line ends that WARC asks for, so archives can lie in any store that Spark writes.

Reading: files are parsed by their records' lengths; revisit records are resolved by a join on the digest with the
responses that the archives hold.
"""

from __future__ import annotations

import zlib
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship, small

_END = "\r\n"


#: Pages of up to so many bytes lie with so many others in one archive, which a reader holds as a whole.
SIZES = ((1 << 16, 2000), (1 << 22, 32), (None, 1))


def _urn(page_id: Column) -> Column:
    """The record id of a page; a page without an id gets a new one."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))


def deduplicated(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, size and refers_to, the page that holds an equal payload of at least ``min_bytes``, else null."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # of the binary form: the bytes are those of the string
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    head = p.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = head.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    # only headers meet by digest, so a payload of very many pages moves no payloads to one task; what pages refer to comes
    # back by page, to all executors if it is counted and small
    refers = head.join(first.select("digest", "first"), "digest").where("page_id > first").distinct().withColumnRenamed("first", "refers_to")
    return p.join(small(refers), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "size", "refers_to")


def records(pages: DataFrame, date: str) -> DataFrame:
    """One string column ``value``: the WARC record of each row of ``deduplicated``, without the line ends after it."""
    revisit = F.col("refers_to").isNotNull()
    # a URI holds no white space or control characters
    url = F.regexp_replace(F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit("urn:unknown")), r"[\x00-\x20\x7F<>]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size").cast("string"), F.lit(_END * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_END}WARC-Record-ID: "),
        _urn(F.col("page_id")),
        F.lit(f"{_END}WARC-Target-URI: "),
        url,
        F.lit(f"{_END}WARC-Date: {date}{_END}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{_END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}WARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(""),
        F.lit(f"{_END}Content-Type: application/http;msgtype=response{_END}Content-Length: "),
        length.cast("string"),
        F.lit(_END * 2),
    )
    return pages.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100, records_per_file: int = 2000, date: str | None = None, **columns: str) -> None:
    """Write a record of every row of ``pages`` into gzip archives at ``path``, revisit records for repeated payloads.

    ``date`` is the records' date, by default now.  Archives are bounded by bytes: pages are written by size, as ``SIZES``
    has it, with at most ``records_per_file`` in one.  A null page is an empty one, a null or empty url is ``urn:unknown``.  Pages under ``min_bytes`` and pages
    with a null id are always responses, and no page refers to a null id.  Rows that repeat the smallest id of a payload
    are all responses.  An empty table writes archives without records.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    done = deduplicated(pages, min_bytes, **columns)
    largest = pages.agg(F.max(F.octet_length(F.col(columns.get("html_col", "html")).cast("string")))).first()[0] or 0
    low = -1
    for high, number in SIZES:
        some = done.where(F.col("size") > low) if high is None else done.where((F.col("size") > low) & (F.col("size") <= high))
        out = records(some, date)
        out.write.mode("append").option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", min(number, records_per_file)).text(path)
        if high is None or largest <= high:
            break
        low = high


def _parse(batches):
    import hashlib

    import pyarrow as pa

    names = ("page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "sound")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())

    def number(urn: str | None):
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    for batch in batches:
        for value in batch.column("content"):
            data = zlib.decompress(value.as_py(), 47)
            at, rows = 0, []
            while at < len(data):
                head = data.index(b"\r\n\r\n", at)
                lines = data[at:head].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record at byte {at}")
                fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                begin, size = head + 4, int(fields["content-length"])
                payload = memoryview(data)[data.index(b"\r\n\r\n", begin) + 4 : begin + size]
                digest = fields["warc-payload-digest"].partition(":")[2]
                response = fields["warc-type"] == "response"
                rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], digest, number(fields.get("warc-refers-to")), len(payload) if response else None, not response or hashlib.sha256(payload).hexdigest() == digest))
                at = begin + size + 4
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, sound.

    A revisit record has the size of the response that it refers to.  ``sound`` is false for a response whose payload
    doesn't have its digest and for a revisit record without its response.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows = found.mapInArrow(_parse, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, sound boolean")
    rows = materialize(rows, "records")
    originals = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    again = rows.where("record_type = 'revisit'").join(originals, "payload_digest", "left")
    again = again.select("page_id", "url", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.col("size").isNotNull().alias("sound"))
    return rows.where("record_type <> 'revisit'").select(again.columns).union(again)


ship(__name__)
