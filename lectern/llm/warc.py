"""WARC archives whose repeated payloads are revisit records.

Headers alone (id, digest, length) are shuffled by payload digest; of each digest the
response is the record of the least id. The revisits found there, again headers,
are joined back to the records, which are written with fresh headers: a response
carries its payload, a revisit names the response. Archives are written by Spark's
text writer: a record's end, two line ends, is the separator of its lines.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import new_path, settle

#: Shorter payloads are never revisits; bytes of payloads read at once.
LEAST_BYTES, READ_BYTES = 100, 8_000_000
#: Bytes of the longest payload of a class, and records in an archive of it: 64 MB, or one record.
CLASSES = ((1 << 16, 1024), (1 << 20, 64), (None, 1))
#: Fixed values of the format.
END, PROFILE = "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOUND = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean, payload string"


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """headers(page_id, url, digest, length) -> (page_id, digest, refers_to, refers_url) of
    the records that revisit another."""
    long_ = headers.where(F.col("length") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("nameless"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    firsts = settle(long_.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    revisits = long_.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return revisits.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()


def record_id(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line; none if value is null. Blanks and control characters of the value
    are written as %20, so that they end no line."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\x00-\\x20\\x7F]+", "%20"), F.lit(END))


def head(*lines: Column) -> Column:
    return F.concat(*(F.coalesce(x, F.lit("")) for x in lines))


def records(pages: DataFrame, date: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One text `record` for each row of pages, without the end of record, and the `length` of
    its payload."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload"))
    revisits = settle(resolve_revisits(rows.drop("payload"), least_bytes), "revisits").withColumnsRenamed({"page_id": "own_id", "digest": "own_digest"})
    joined = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["own_id"]) & (rows["digest"] == revisits["own_digest"]), "left")
    again = F.col("own_digest").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "), F.col("length").cast("string"), F.lit(END + END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    kind = F.when(again, "revisit").otherwise("response")
    top = head(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", kind),
        F.concat(F.lit("WARC-Record-ID: "), F.when(again, record_id("revisit", F.col("page_id"), F.col("digest"))).otherwise(record_id("response", F.col("page_id"), F.col("digest"))), F.lit(END)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-Id", F.col("page_id")),
        F.when(again, line("WARC-Profile", F.lit(PROFILE))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id("response", F.col("refers_to"), F.col("digest")), F.lit(END))),
        F.when(again, line("WARC-Refers-To-Target-URI", F.col("refers_url"))),
        F.when(again, line("X-Refers-To-Page-Id", F.col("refers_to"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(END),
    )
    return joined.select("length", F.concat(top, block).alias("record"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record per row of pages(page_id, url, html) to gzip archives in path, those of
    long payloads apart from the others, so that an archive is bounded in bytes."""
    rows, least = records(pages, date, least_bytes), -1
    for most, per_file in CLASSES:
        part = rows.where(F.col("length") > least) if most is None else rows.where((F.col("length") > least) & (F.col("length") <= most))
        part.select("record").write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        least = most


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:60]!r}")
        fields: dict[str, str] = {}
        while (text := stream.readline()).strip():
            name, _, value = text.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_digest (hex), payload_bytes (of the full
    payload), refers_to, intact (a response's payload has the digest and length
    that its headers tell) and payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)))
        for b in batches:
            for content in b.column(0):
                out: list[tuple] = []
                size = 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    for fields, block in parse_archive(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                        number = [int(fields[x]) if x in fields else None for x in ("x-page-id", "x-refers-to-page-id")]
                        if kind == "response":
                            made = hashlib.sha256(payload).hexdigest()
                            out.append((number[0], fields.get("warc-target-uri"), kind, made, len(payload), None, made == digest and told == len(payload), payload.decode()))
                        else:
                            out.append((number[0], fields.get("warc-target-uri"), kind, digest, told, number[1], True, None))
                        size += len(payload) + 500
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, FOUND)


def through_archives(pages: DataFrame, **how) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back.

    Null html is an empty payload; a null url leaves its header out; a null page_id comes
    after all others, and its header is left out too. Rows that repeat the least id of a
    payload are responses all. Other columns are left out; an empty table gives no
    rows."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)
