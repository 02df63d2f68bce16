r"""WARC archives: writing captures, reading records back and assembling them into transactions.

Each page becomes three records: a request, a response (or revisit) and a metadata record; request and metadata name the
capture in WARC-Concurrent-To. A record is one row of Spark's text writer, whose line separator is the record separator
CR LF CR LF, so archives are written where Spark can write. They are rolled after a bounded number of records, and each
is read back whole, record by record by Content-Length, whatever a payload holds.

Of pages with equal payloads of at least min_revisit bytes the one with the largest page_id is a response and the others
revisit it. Null payloads are empty, null page_ids are kept and revisit any equal page that has one, repeated rows each
become a capture (equal page_ids are responses alike), an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, shared_dir, ship, stored

MIN_REVISIT = 1000
RECORDS_PER_FILE = 3000
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "type string, record_id string, concurrent_to string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The record's text without its separator; headers that are null are left out."""
    lines = [F.lit("WARC/1.1" + END), F.lit("WARC-Type: "), kind, F.lit(END)]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]+", " "), F.lit(END)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block)


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, keeper (page_id, url) of each page's payload, null for responses.

    Short payloads aren't shuffled. Of the long ones, rows without payloads find what they revisit, and only responses'
    payloads are needed, which are told from revisits by page_id and digest together, so equal payloads never meet.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    none = F.lit(None).cast("struct<page_id:bigint,url:string>").alias("keeper")
    short, long_ones = base.where(F.col("payload_bytes") < min_revisit), base.where(F.col("payload_bytes") >= min_revisit)
    light = long_ones.drop("payload")
    keepers = light.groupBy("payload_digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").cast("long").alias("page_id"), "url"))).alias("keeper"), F.count(F.lit(1)).alias("n"))
    keepers = stored(keepers.where((F.col("n") > 1) & F.col("keeper").isNotNull()), "keepers")
    revisits = join_hot(light, keepers, ["payload_digest"], "n", keepers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    revisits = revisits.where(~F.col("page_id").eqNullSafe(F.col("keeper.page_id")))
    gone = revisits.select(F.col("payload_digest").alias("d"), F.col("page_id").alias("p")).distinct()
    responses = long_ones.join(gone, (F.col("payload_digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left_anti")
    columns = [*base.columns, "keeper"]
    return short.withColumn("keeper", none).unionByName(responses.withColumn("keeper", none)).unionByName(revisits.withColumn("payload", F.lit(None).cast("string")).select(columns))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """pages: page_id, url, html."""
    rows = with_revisits(pages).withColumn("n", F.monotonically_increasing_id())
    urn = lambda kind: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", F.lit(kind), "n", "page_id")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    same = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("X-Page-Id", F.col("page_id"))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    revisit = F.col("keeper").isNotNull()
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", F.col("id")),
            *same,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To-Target-URI", F.col("keeper.url")),
            ("X-Refers-To-Page-Id", F.col("keeper.page_id")),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", urn("request")), ("WARC-Concurrent-To", F.col("id")), *same, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", "[\\r\\n ]+", "%20"), F.lit("/")), F.lit(f" HTTP/1.1{END}{END}")),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", urn("metadata")), ("WARC-Concurrent-To", F.col("id")), *same, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payload-length: "), F.col("payload_bytes").cast("string"), F.lit(END)),
    )
    records = rows.withColumn("id", urn("capture")).select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive as tuples of RECORD's columns."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head_end].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        begin = head_end + 4
        end = begin + int(fields["Content-Length"])
        kind = fields["WARC-Type"]
        size = digest = payload = None
        if kind in ("response", "revisit"):
            http_end = data.index(b"\r\n\r\n", begin, end) + 4
            http = dict(x.split(": ", 1) for x in data[begin : http_end - 4].decode().split(END)[1:])
            if kind == "response":
                payload = data[http_end:end]
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
            else:
                size, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda name: int(fields[name]) if name in fields else None
        yield (kind, fields["WARC-Record-ID"], fields.get("WARC-Concurrent-To"), number("X-Page-Id"), fields.get("WARC-Target-URI"), size, digest, number("X-Refers-To-Page-Id"), payload if with_payload else None)
        at = end + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives under path."""
    ship(spark)
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = list(parse_records(gzip.decompress(content), with_payload))
                yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})

    # A batch holds the files of a few rows only: archives are rolled, but may still be large.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its id, capture, request and metadata record, joined through concurrent-to identifiers.

    All records of a capture share one key, the capture's own id or what the record is concurrent to, so one shuffle
    joins them; a capture without a request or metadata record has null there.
    """
    fields = F.struct("record_id", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload", F.col("type").alias("record_type"))
    part = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), fields), ignorenulls=True)
    joined = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(part("response", "revisit").alias("capture"), part("request").alias("request"), part("metadata").alias("metadata"))
    return joined.where(F.col("capture").isNotNull())


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back: a row per page."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return captures(read_archives(spark, path, with_payload=False)).select(
        "capture.page_id", "capture.payload_bytes", "capture.payload_digest", "capture.record_type", "capture.refers_to",
        F.col("request.url").alias("request_url"), F.col("metadata").isNotNull().alias("has_metadata"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to, url AS request_url, true AS has_metadata
FROM p LEFT JOIN k ON p.d = k.d"""
