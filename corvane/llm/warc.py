"""WARC archives: writing, reading, and resolution of revisit records.

Archives are written with Spark's text writer: a record's header, block and closing blank lines are one row, so any
file system that Spark knows will do and files stay whole WARC files.  They are read as binary files and cut into
records by Content-Length; what is no whole record becomes a row of its own, up to the next record's start.  Only
headers are shuffled by payload digest: copies are counted by digest and page before they meet, so that no task holds
a group, and the join that carries the original back reads written tables, so its hot key can be split.

``deduplicated`` goes from pages to archives and their records, ``deduplicate_archives`` from archives that may hold
copies and revisits to archives without copies, in which each revisit names a response that is there.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, work_path, written

MIN_REVISIT_BYTES = 1000
#: Records and payload bytes in one archive file at most, so that a file fits in a task's memory; a larger payload has
#: a file of its own.
RECORDS_PER_FILE, FILE_BYTES = 2000, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CRLF = "\r\n"


def headers_of(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with the payload (null html: empty), its bytes and its SHA-1."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "UTF-8"))})


def originals(headers: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(payload_digest, original, original_uri), one row for each digest that several records of at least ``least`` bytes
    share; the URI is null where several rows have the original's page_id, as it would name none of them."""
    pages = headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    found = pages.groupBy("payload_digest").agg(best.alias("b"), F.sum("n").alias("n")).where("n > 1 AND b IS NOT NULL")
    return found.select("payload_digest", F.col("b.page_id").alias("original"), F.when(F.col("b.n") == 1, _named_uri("payload_digest")).alias("original_uri"))


def _named_uri(digest: str) -> F.Column:
    """The record id of a group's one original: a UUID made of the digest that all its revisits know."""
    h = F.md5(F.concat(F.lit("original "), F.col(digest)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolved(records: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """records with record_type, refers_to, record_uri and refers_to_uri: the record of a group's largest page_id is the
    response.

    Repeated rows with that page_id are all responses; null page_ids revisit it.
    """
    first = written(originals(records.select("page_id", "payload_bytes", "payload_digest"), least), "originals")
    out = records.join(first, "payload_digest", "left")
    member = F.col("original").isNotNull()
    revisit = member & ~F.col("page_id").eqNullSafe(F.col("original"))
    fresh = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    return out.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("original")),
        "record_uri": F.coalesce(F.when(member & ~revisit, F.col("original_uri")), fresh), "refers_to_uri": F.when(revisit, F.col("original_uri")),
    }).drop("original", "original_uri")


def _line(name: str, value) -> F.Column:
    """A header line, or nothing where the value is null; line ends in the value are left out."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", ""), F.lit(_CRLF)), F.lit(""))


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """records (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, record_uri, refers_to_uri) as
    WARC/1.1 files, dated with the time of writing or ``date``.

    A response's block is an HTTP response with the payload, a revisit's has the HTTP header alone.  page_id and
    refers_to are header fields of our own.  Records of large payloads go to files of fewer records.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.col("record_uri")), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), _line("WARC-Profile", F.when(revisit, PROFILE)), _line("WARC-Refers-To", F.col("refers_to_uri")),
        _line("Page-ID", F.col("page_id").cast("string")), _line("Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", block_bytes.cast("string")),
        F.lit(_CRLF), http, F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )

    def write(part: DataFrame, most: int) -> None:
        part.select(record.alias("value")).write.mode("append").option("lineSep", _CRLF * 2).option("maxRecordsPerFile", most).text(path)

    small = max(1, file_bytes // records_per_file)
    largest = records.where(~revisit).agg(F.max("payload_bytes")).first()[0] or 0
    if largest <= small:
        write(records, records_per_file)
        return
    bytes_of = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    write(records.where(bytes_of <= small), records_per_file)
    while small < largest:  # classes of eight times the size, a file of each within the bytes
        write(records.where((bytes_of > small) & (bytes_of <= small * 8)), max(1, file_bytes // (small * 8)))
        small *= 8


RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("record_uri", T.StringType()), T.StructField("refers_to_uri", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("intact", T.BooleanType()),
])


def _number(text: str | None) -> int | None:
    """A whole number of 64 bits; anything else, such as other scripts' digits, is none."""
    if not text or not re.fullmatch(r"-?[0-9]{1,19}", text, re.ASCII):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None


def _next_record(data: bytes, at: int) -> int:
    """The start of the next record after ``at``, or the end."""
    found = data.find(b"\r\n\r\nWARC/", at)
    return len(data) if found < 0 else found + 4


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive; ``intact`` tells whether a response's payload has the digest of its header.

    Bytes that are no whole record give one of type ``damaged``, with them as its payload, up to the next record.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode(errors="replace").split(_CRLF) if end >= 0 else [""]
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = _number(head.get("content-length"))
        stop = end + 4 + (size or 0)
        if not lines[0].startswith("WARC/") or size is None or size < 0 or data[stop : stop + 4] != b"\r\n\r\n":
            after = _next_record(data, at)
            yield None, None, "damaged", None, None, None, None, data[at:after], False
            at = after
            continue
        kind, block = head.get("warc-type", ""), data[end + 4 : stop]
        digest, payload = head.get("warc-payload-digest", "").removeprefix("sha1:").lower(), None
        if kind == "response":
            cut = block.find(b"\r\n\r\n")
            payload = block[cut + 4 :] if cut >= 0 else block
        own = hashlib.sha1(payload).hexdigest() if payload is not None else digest
        yield (
            _number(head.get("page-id")), head.get("warc-target-uri"), kind, digest or own, _number(head.get("refers-to-page-id")), head.get("warc-record-id"), head.get("warc-refers-to"),
            payload, payload is None or not digest or own == digest,
        )
        at = stop + 4


@contextmanager
def _one_by_one(spark: SparkSession):
    """Arrow batches of one row, a whole file here, while a job runs."""
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, "1")
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path, as a written table; without payloads, payload_bytes stands for them.

    Any WARC file will do, also other kinds of records than responses; files may have 2 GB at most.
    """
    fields = RECORD if payloads else T.StructType([*[f for f in RECORD if f.name != "payload"], T.StructField("payload_bytes", T.LongType())])

    def records(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = list(parse(data))
                out = pd.DataFrame(rows, columns=RECORD.names)
                if not payloads:
                    out["payload_bytes"] = pd.array([None if p is None else len(p) for p in out.pop("payload")], dtype="Int64")
                for column, place in (("page_id", 0), ("refers_to", 4)):  # not by way of doubles, which large ids would lose digits in
                    out[column] = pd.array([r[place] for r in rows], dtype="Int64")
                yield out

    with _one_by_one(spark):
        return written(spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, fields), "warc-records")


def deduplicated(spark: SparkSession, pages: DataFrame, path: str | None = None, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes pages as archives in which equal payloads are stored once, reads them back and resolves the revisits.

    (page_id, url, record_type, payload_digest, refers_to, payload_bytes, intact); a revisit's payload_bytes are
    those of the response that it refers to.  Null html is an empty payload; repeated rows have a record each.
    """
    path = path or work_path(spark, "warc")
    write_archives(resolved(headers_of(pages), least), path)
    records = read_archives(spark, path, payloads=False)
    stored = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    joined = records.join(written(stored, "stored"), "payload_digest", "left")
    return joined.select("page_id", "url", "record_type", "payload_digest", "refers_to", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "intact")


def with_payloads(records: DataFrame) -> DataFrame:
    """records of read_archives with each revisit's payload and its response's record_uri as ``resolved_uri``: by the id
    that it names, else by its payload digest, of which the smallest record_uri counts.  A revisit of a response that is
    not there keeps a null payload."""
    spark = records.sparkSession
    with Scratch(spark, "warc-revisits") as scratch:
        response = records.where("record_type = 'response' AND intact")
        revisit = records.where("record_type = 'revisit'").select("payload_digest", "refers_to_uri").distinct()
        named = scratch.written(response.where("record_uri IS NOT NULL").groupBy("record_uri").agg(F.min("payload_digest").alias("named_digest")), "named")
        by_digest = scratch.written(response.groupBy("payload_digest").agg(F.min("record_uri").alias("digest_uri")), "by-digest")
        known = revisit.join(named, revisit["refers_to_uri"] == named["record_uri"], "left").join(by_digest, "payload_digest", "left")
        uri = F.coalesce("record_uri", "digest_uri").alias("resolved_uri")
        found = scratch.kept(known.select("payload_digest", "refers_to_uri", uri, F.coalesce("named_digest", F.when(F.col("digest_uri").isNotNull(), F.col("payload_digest"))).alias("source_digest")), "found")
        wanted = found.where("source_digest IS NOT NULL").select(F.col("source_digest").alias("payload_digest")).distinct()
        # one payload for each digest that is asked for
        stored = scratch.kept(response.join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.min("payload").alias("stored")).withColumnRenamed("payload_digest", "source_digest"), "stored")
    left, right = records.alias("r"), found.alias("f")
    same = (F.col("r.payload_digest") == F.col("f.payload_digest")) & F.col("r.refers_to_uri").eqNullSafe(F.col("f.refers_to_uri")) & (F.col("r.record_type") == "revisit")
    out = left.join(right, same, "left").select("r.*", "f.resolved_uri", "f.source_digest").join(stored, "source_digest", "left")
    return out.withColumn("payload", F.coalesce("payload", "stored")).drop("stored", "source_digest")


def deduplicate_archives(spark: SparkSession, source: str, target: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Reads the archives under ``source``, joins revisits to their responses, and writes archives under ``target`` in
    which each payload of at least ``least`` bytes is stored once, with fresh headers; the damaged records are returned.

    A revisit whose response is missing is left as it is found among the damaged, with its digest.  Of equal payloads
    the record of the largest page_id, then of the largest record_uri, is the response.  Other kinds of records are left out.
    """
    records = written(with_payloads(read_archives(spark, source)), "warc-resolved")
    lost = (F.col("record_type") == "damaged") | ~F.col("intact") | ((F.col("record_type") == "revisit") & F.col("payload").isNull())
    whole = records.where(~lost & F.col("payload").isNotNull())
    body = whole.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    with Scratch(spark, "warc-copies") as scratch:
        own = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), F.coalesce("record_uri", F.lit("")).alias("u"))
        groups = body.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(own).alias("best"), F.count("*").alias("n")).where("n > 1")
        groups = scratch.written(groups.select("payload_digest", "best"), "groups")
        joined = body.join(groups, "payload_digest", "left")
        revisit = F.col("best").isNotNull() & (own != F.col("best"))
        uri = F.when(F.col("best").isNotNull() & ~revisit, _named_uri("payload_digest")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
        out = joined.select(
            "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            F.when(revisit & (F.col("best.p") > -(1 << 63)), F.col("best.p")).alias("refers_to"), uri.alias("record_uri"), F.when(revisit, _named_uri("payload_digest")).alias("refers_to_uri"),
        )
        write_archives(out, target)
    return records.where(lost)
