"""Operator 1: WARC archives in which repeated payloads are stored once.

Headers (page, length, SHA-1 digest), never payloads, are shuffled by digest. Of equal payloads of
at least ``min_bytes`` the page with the largest id keeps the response; the others become revisit
records that refer to it. ``write_archives`` writes gzip-compressed WARC 1.1 with fresh headers,
``read_archives`` reads any such folder back, and ``resolved`` joins revisits to their originals.

Nulls: a null payload is empty, a null url leaves out the target URI, a null page id sorts first.
Rows repeated with their id are all alike: copies of the kept page are all responses. An empty table
gives an empty folder. Columns other than the three are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
BATCH_BYTES = 1 << 23
ARCHIVE_RECORDS = 10_000

RECORD = ("record_type string, page_id bigint, url string, record_id string, refers_to_id string, "
          "date string, payload_digest string, payload_bytes bigint")


def headers(pages: DataFrame) -> DataFrame:
    """One row per page: id, url, payload, its UTF-8 length and digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("bytes"), F.sha1(payload).alias("digest"))


def revisits(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(page_id, digest, original, original_url)`` of the pages whose payload another page keeps."""
    large = heads.filter(F.col("bytes") >= min_bytes)
    originals = (
        large.groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select("digest", F.col("kept.page_id").alias("original"), F.col("kept.url").alias("original_url"))
    )
    return (
        large.select("page_id", "digest").join(originals, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("original"))).dropDuplicates(["page_id", "digest"])
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null. Raw line breaks, which no URI may hold, are percent-coded."""
    coded = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), coded, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, date: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One column ``record``: the text of each WARC record without its closing blank lines."""
    heads = headers(pages)
    others = revisits(heads, min_bytes).withColumnsRenamed({"page_id": "of", "digest": "same"})
    joined = heads.join(others, heads["page_id"].eqNullSafe(others["of"]) & (heads["digest"] == others["same"]), "left")
    again = F.col("same").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    return joined.select(F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, _record_id(F.col("original"), F.col("digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("original_url"))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block).alias("record"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z",
                   min_bytes: int = MIN_BYTES) -> None:
    """Write deduplicated archives below ``path``.

    Payloads are shuffled once, to meet the decision about their page; each task then writes archives of at
    most ``ARCHIVE_RECORDS`` records, which bounds what a reader holds at once.
    """
    (records(pages, date, min_bytes)
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS)
     .text(path))


def _parsed(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive; lengths come from the headers, so payloads may hold anything."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").removesuffix("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        payload = block.partition(b"\r\n\r\n")[2]
        kind, page = fields["warc-type"], fields.get("x-page-id")
        stored = kind == "response"
        yield {
            "record_type": kind, "page_id": int(page) if page else None, "url": fields.get("warc-target-uri"),
            "record_id": fields.get("warc-record-id"), "refers_to_id": fields.get("warc-refers-to"),
            "date": fields.get("warc-date"),
            "payload_digest": hashlib.sha1(payload).hexdigest() if stored else
            fields.get("warc-payload-digest", "").removeprefix("sha1:"),
            "payload_bytes": len(payload) if stored else None, "payload": payload if stored else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; a response's digest and length are those of
    the payload that was read, a revisit's digest is the header's."""
    kinds = [("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()),
             ("refers_to_id", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
             ("payload_bytes", pa.int64())]
    schema = pa.schema([*kinds, ("payload", pa.binary())] if payloads else kinds)

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as stream:
                    for row in _parsed(io.BufferedReader(stream)):
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if not payloads:
                            row["payload"] = None
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    archives = (spark.read.schema("path string, modificationTime timestamp, length bigint, content binary")
                .format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content"))
    return archives.mapInArrow(parse, f"{RECORD}, payload binary" if payloads else RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Records with every revisit's ``payload_bytes`` (and ``payload``, if read) and ``refers_to``, the page id
    of its original, taken from the response that it refers to."""
    own = [c for c in ("payload_digest", "payload_bytes", "payload") if c in found.columns]
    originals = (
        found.filter((F.col("record_type") == "response"))
        .join(found.filter(F.col("record_type") == "revisit")
              .select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
        .dropDuplicates(["record_id"])
        .select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"),
                *(F.col(c).alias(f"_{c}") for c in own))
    )
    again = found.filter(F.col("record_type") == "revisit")
    joined = again.join(originals, again["refers_to_id"] == originals["_id"], "left")
    return (
        found.filter(F.col("record_type") != "revisit").withColumn("refers_to", F.lit(None).cast("bigint"))
        .unionByName(joined.select(
            *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in found.columns),
            "refers_to"))
    )
