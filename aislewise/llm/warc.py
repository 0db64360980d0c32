"""WARC archives with revisit records.

Records are headers first: page, digest and length of the payload. Headers are shuffled by digest, the
smallest page of equal payloads becomes the response, and every other one a revisit that names it; payloads
move only to meet their own page's verdict. Archives are written by Spark's text writer, whose line
separator is the blank line that ends a WARC record, and read back through Spark as binary files, record by
record by their Content-Length. So both ends work in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.llm.common import cut, new_path

END = "\r\n\r\n"
MIN_BYTES = 100
# Payload bytes of a file, largest payload of the first class of sizes, and how much larger each further class goes.
FILE_BYTES, SMALL, STEP = 1 << 29, 1 << 16, 1 << 6
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
COLUMNS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def plain_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, payload_digest, payload_bytes)``; a null html is an empty payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(page_id, payload_digest, refers_to, refers_url)`` of the pages whose payload an earlier page has.

    Works on headers alone. Digests that occur once leave after a partial count, so a common payload does
    not gather in one task; the join reads written tables, which Spark can split where a digest is common.
    """
    heads = plain_pages(pages).where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    heads = cut(heads.select("page_id", "url", "payload_digest"), "heads")
    first = heads.groupBy("payload_digest").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.min("page_id").alias("least"), F.max("page_id").alias("most")
    )
    first = cut(first.where("least < most").select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "first")
    found = heads.join(first, "payload_digest").where("page_id <> refers_to")
    return found.select("page_id", "payload_digest", "refers_to", "refers_url").distinct()


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.concat(F.lit("none:"), F.uuid())), F.lit(">"))


def one_line(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page as gzip-compressed WARC files below ``path``.

    Of pages with equal payloads of at least ``min_bytes`` that with the smallest id is a response, the
    others are revisits without payload. Rows without an id, and rows that repeat the id and payload of a
    response, are responses. Line breaks in an URL are percent-encoded; a null URL is left out. A file holds
    payloads of at most ``file_bytes`` or a single record: payloads are written by classes of size, each with
    as many records a file as its largest ones allow.
    """
    again = cut(revisits(pages, min_bytes), "revisits").withColumnRenamed("page_id", "of").withColumnRenamed("payload_digest", "with")
    rows = plain_pages(pages)
    rows = rows.join(again, (rows.page_id == again["of"]) & (rows.payload_digest == again["with"]), "left")
    old = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    body = F.concat(F.lit(HTTP), F.when(old, F.lit("")).otherwise(F.col("html")))
    size = len(HTTP) + F.when(old, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.0"),
        line("WARC-Type", F.when(old, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_uri(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        optional("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(old, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_uri(F.col("refers_to"))))).otherwise(""),
        F.when(old, optional("WARC-Refers-To-Target-URI", one_line(F.col("refers_url")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", size.cast("string")),
        F.lit(END),
    )
    largest = rows.agg(F.max("payload_bytes")).first()[0] or 0
    low, high = -1, SMALL
    while low < largest:
        some = rows.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high)).select(F.concat(head, body).alias("value"))
        some.write.mode("append").option("maxRecordsPerFile", max(1, file_bytes // high)).text(path, compression="gzip", lineSep=END)
        low, high = high, high * STEP


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content block of each record of a gzip-compressed file, one at a time."""
    unpack = zlib.decompressobj(31)
    buffer, at = bytearray(), 0
    view = memoryview(content)
    pending = b""
    want = 0
    head: dict[str, str] | None = None
    while True:
        if head is None:
            stop = buffer.find(b"\r\n\r\n", at)
            if stop >= 0:
                lines = bytes(buffer[at:stop]).decode().split("\r\n")
                head = dict(x.split(": ", 1) for x in lines[1:])
                at, want = stop + 4, int(head["Content-Length"])
                continue
        elif len(buffer) - at >= want + 4:
            yield head, bytes(buffer[at : at + want])
            at, head = at + want + 4, None
            continue
        del buffer[:at]
        at = 0
        if not pending:
            if not len(view):
                if head is not None or buffer:
                    raise ValueError("the file ends within a record")
                return
            pending, view = bytes(view[: 1 << 16]), view[1 << 16 :]
        buffer += unpack.decompress(pending)
        pending = unpack.unused_data
        if pending:
            unpack = zlib.decompressobj(31)


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record, columns ``COLUMNS``; digest and length are those of the payload read, null for a revisit.

    ``payload`` adds the bytes of responses. A file is unpacked as it is read, one record at a time.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in records(content.as_py()):
                    page = head["WARC-Record-ID"][12:-1]
                    old = head["WARC-Type"] == "revisit"
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = stated if old else hashlib.sha256(body).hexdigest()
                    if digest != stated:
                        raise ValueError(f"record of page {page} does not match its digest")
                    refers = int(head["WARC-Refers-To"][12:-1]) if old else None
                    rows.append(
                        (None if page.startswith("none:") else int(page), head.get("WARC-Target-URI"), head["WARC-Type"], digest,
                         None if old else len(body), refers, body if payload and not old else None)
                    )
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, COLUMNS)


NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def resolved(archive: DataFrame) -> DataFrame:
    """The records of an archive with each revisit joined to the response it refers to, for its payload and length."""
    archive = cut(archive, "records")
    whole = archive.where("record_type = 'response'")
    sources = whole.where(F.col("page_id").isNotNull()).select(
        F.col("page_id").alias("source"), F.col("payload_digest").alias("source_digest"), "payload_bytes", "payload"
    )
    sources = cut(sources.dropDuplicates(["source", "source_digest"]), "sources")
    old = archive.where("record_type = 'revisit'").drop("payload_bytes", "payload")
    joined = old.join(sources, (F.col("refers_to") == F.col("source")) & (F.col("payload_digest") == F.col("source_digest")))
    return whole.unionByName(joined.select(*archive.columns))


def deduplicated(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages as archives, read them back and resolve the revisits: one row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, min_bytes)
    return resolved(read_archive(spark, path))
