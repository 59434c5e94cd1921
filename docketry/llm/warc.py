"""WARC archives: written from captures, read back, and assembled into transactions.

Writing: every page gives a response (or revisit), a request and a metadata
record, tied by WARC-Concurrent-To. Of pages with equal payloads of at least
``min_bytes`` the largest id is the response, the others revisit it. Spark's text
writer ends each record with the blank lines that the format asks for, so files
go wherever Spark can write, one gzip member a file.

Reading: Spark's text reader splits at ``WARC/1.``; a record whose
Content-Length is not reached yet takes in the following pieces, so payloads may
hold that string. Files are gzip and hence one stream each, read in order with a
record at a time in memory. SHA-1 is computed anew from the payload.

Assembly: records meet under the id of their response and give one nested row
per capture. Requests or metadata without a response form a capture of their own
with a null response; of several requests or metadata records the one with the
least record id is shown, and they are counted.

Null html is an empty payload. Control characters in urls are percent-encoded.
Rows with null or equal ids are captures of their own; of equal rows with equal
payloads one is the response; an input that gives such rows in another order when it
is read again has to be written first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.sizes import broadcast_within
from .common import bounded_batches, join_spread, worker_table, written

MIN_BYTES = 1000
END, START = "\r\n\r\n", "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + "|"), key))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]),
                    F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines],
                    F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                    F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = MIN_BYTES,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Write all pages; payloads are shuffled only if the table of repeats is beyond a broadcast."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        html.alias("html")).withColumn("row", F.monotonically_increasing_id())
    base = base.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn(
        "bytes", F.octet_length("html").cast("long"))
    large = F.col("bytes") >= min_bytes
    repeats = base.filter(large).groupBy("sha1").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "row")).alias("kept")
    ).filter("copies > 1")
    repeats = written(repeats.select(F.col("sha1").alias("_sha1"), F.col("kept.page_id").alias("_page"),
                                     F.col("kept.row").alias("_row")), "repeats")
    rows = base.join(broadcast_within(repeats), (F.col("sha1") == F.col("_sha1")) & large, "left")
    # The row number only tells rows apart that share id and payload.
    again = F.col("_sha1").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("_page"))
                                           & (F.col("row") == F.col("_row")))
    key = F.concat_ws("|", F.col("page_id").cast("string"), "sha1", F.col("row").cast("string"))
    # A large payload has one response, which its digest names for all that revisit it.
    of_payload = _urn("payload", F.col("sha1"))
    response_id = F.when(large, of_payload).otherwise(_urn("response", key))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(""))
    capture = F.when(again, _urn("revisit", key)).otherwise(response_id)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    response = _record([
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.col("capture")), *common,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Profile", F.when(again, PROFILE)),
        ("WARC-Refers-To", F.when(again, of_payload)),
        ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(again, "").otherwise(F.col("html"))))
    request = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", key)), *common,
        ("WARC-Concurrent-To", F.col("capture")),
        ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + END)))
    metadata = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", key)), *common,
        ("WARC-Concurrent-To", F.col("capture")),
        ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                 F.lit("\r\n")))
    (rows.withColumn("capture", capture)
     .select(F.explode(F.array(response, request, metadata)).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").text(path))


FIELDS = ("record_id string, type string, concurrent_to string, refers_to string, uri string, "
          "declared_digest string, digest string, payload_bytes long, page_id long")


def parse_record(data: bytes, size_of_head: int, head: dict[str, str], with_payload: bool) -> list:
    import hashlib

    block = data[size_of_head:size_of_head + int(head.get("content-length", "0"))]
    kind = head.get("warc-type", "")
    payload, length, page = block, len(block), None
    if "application/http" in head.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            for line in http.split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
    elif kind == "metadata":
        for line in block.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"page-id" and value.strip().lstrip(b"-").isdigit():
                page = int(value)
    declared = head.get("warc-payload-digest")
    declared = declared.partition(":")[2] if declared else None
    digest = declared if kind == "revisit" else hashlib.sha1(payload).hexdigest()
    row = [head.get("warc-record-id"), kind, head.get("warc-concurrent-to"),
           head.get("warc-refers-to"), head.get("warc-target-uri"), declared, digest, length, page]
    return row + [payload] if with_payload else row


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record; without payloads nothing large leaves the scan."""
    schema = FIELDS + (", payload binary" if with_payload else "")
    bounded_batches(spark)
    out = to_arrow_schema(_parse_datatype_string(schema))
    raw = spark.read.option("lineSep", START).text(path).select(F.col("value").cast("binary"))

    def head_of(data: bytes) -> tuple[int, dict[str, str]] | None:
        stop = data.find(b"\r\n\r\n")
        if stop < 0 or data[1:3] != b"\r\n":
            return None
        head = {}
        for line in data[3:stop].split(b"\r\n"):
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        return stop + 4, head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table(None)
        parts: list[bytes] = []
        size = need = 0
        rows: list[list] = []

        def full() -> bool:
            """Whether ``parts`` hold a whole record; if so it is parsed."""
            nonlocal need, size
            if need and size < need:
                return False
            data = START.encode().join(parts)
            parts[:] = [data]
            size = len(data)
            got = head_of(data)
            if got is None:
                return False
            need = got[0] + int(got[1].get("content-length", "0"))
            if size < need:
                return False
            rows.append(parse_record(data, *got, with_payload))
            return True

        def shown() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            held = 0
            for value in batch.column(0):
                piece = value.as_py() or b""
                if not parts and not piece:
                    continue                      # in front of the first record of a file
                size += len(piece) + (len(START) if parts else 0)
                parts.append(piece)
                held += len(piece)
                if full():
                    parts, size, need = [], 0, 0
                if rows and (len(rows) >= 2000 or with_payload and held >= 8 << 20):
                    yield shown()
                    held = 0
            if rows:
                yield shown()

    return raw.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: response, request and metadata structs under ``capture_id``.

    Either side may name the other: a request or metadata record its response, or
    a response its request. Sides combine before the shuffle, so a capture with
    very many records stays one small row.
    """
    main = F.col("type").isin("response", "revisit")
    named = records.filter(main & F.col("concurrent_to").isNotNull()).select(
        F.col("concurrent_to").alias("_other"), F.col("record_id").alias("_capture"))
    named = named.groupBy("_other").agg(F.min("_capture").alias("_capture"))
    found = records.join(named, ~main & (F.col("record_id") == F.col("_other")), "left")
    anchor = F.when(main, F.col("record_id")).otherwise(
        F.coalesce("_capture", "concurrent_to", "record_id"))
    payload = ["payload"] if "payload" in records.columns else []
    response = F.struct("record_id", "type", "refers_to", "uri", "declared_digest", "digest",
                        "payload_bytes", *payload)
    side = F.struct("record_id", "uri", "page_id")
    request, metadata = F.col("type") == "request", F.col("type") == "metadata"
    return found.groupBy(anchor.alias("capture_id")).agg(
        F.min(F.when(main, response)).alias("response"),
        F.min(F.when(request, side)).alias("request"), F.count_if(request).alias("n_requests"),
        F.min(F.when(metadata, side)).alias("metadata"), F.count_if(metadata).alias("n_metadata"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every capture read.

    Responses pass as they are; only revisits are joined with what they refer to, and a
    payload that very many revisit does not put these into one task.
    """
    rows = written(assemble(read_records(spark, path)).select(
        "capture_id", "metadata.page_id", "response.payload_bytes",
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_to")),
        "captures")
    shown = ("page_id", "payload_bytes", "payload_digest", "record_type")
    # Captures without a response have no type.
    refers = F.coalesce((F.col("record_type") == "revisit") & F.col("_to").isNotNull(), F.lit(False))
    again = rows.filter(refers).select(*shown, "_to")
    wanted = again.groupBy("_to").agg(F.count(F.lit(1)).alias("_n"))
    target = written(rows.join(wanted.withColumnRenamed("_to", "_id"), F.col("capture_id") == F.col("_id"))
                     .select(F.col("_id").alias("_to"), F.col("page_id").alias("refers_to"), "_n"),
                     "targets")
    found = join_spread(again, target, "_to", "_n", "left")
    return rows.filter(~refers).select(*shown, F.lit(None).cast("long").alias("refers_to")) \
        .unionByName(found.select(*shown, "refers_to"))
