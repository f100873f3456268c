"""Web archives: writing segmented WARC files and reassembling what they hold.

Writing: each page is a ``response`` record with an HTTP block whose body is chunked; blocks over
``segment_bytes`` are cut into a first record and ``continuation`` records. Of pages with equal
payloads of at least ``least_bytes`` the one with the largest id is written in full, the others as
``revisit`` records that refer to it. Files go through Spark's text writer, one record per row: a
record ends in CR LF CR and the writer's line feed completes it. So files are ordinary gzip-compressed
WARC files, written and committed like any table, in whatever store Spark can reach.

Reading: files are parsed by their ``Content-Length`` fields; their size is bounded by
``FILE_RECORDS`` records of at most ``segment_bytes`` each. Continuation records are grouped by the
identifier of their origin, put in order of their segment numbers, and joined if none is missing and
the total length is right; then the chunks are decoded.

Defined results: a null payload is empty; a null page id stays null and ranks below all others; rows
repeated whole are all responses if their page id is the largest; record identifiers are made of page
id and digest, so equal identifiers mean equal payloads; a null URL leaves the field out; broken
records are returned with ``problem`` set and a null payload, never dropped; an empty table gives no
files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import broadcast_if_small, scratch_path, written_table

LEAST_BYTES = 1_000
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
FILE_RECORDS = 2_000
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Transfer-Encoding: chunked\r\n\r\n")


def record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in [*parts, b""])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked transfer framing; raises ValueError if it is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        parts.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no HTTP header")
    coding = re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head)
    return unchunked(body) if coding else body


def _record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()
    return head + block + b"\r\n\r"  # the text writer adds the last line feed


def page_records(page_id, url: str | None, payload: bytes, refers_page, refers: bool,
                 segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page."""
    digest = hashlib.sha1(payload).hexdigest()
    own = record_id(page_id, digest)
    shown = [("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")),
             ("WARC-Date", DATE), ("X-Page-Id", page_id),
             ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers:
        yield _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shown,
             ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
             ("WARC-Refers-To", record_id(refers_page, digest)), ("X-Refers-To-Page-Id", refers_page),
             ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        fields = [("WARC-Type", "response" if n == 1 else "continuation")]
        if n == 1:
            fields += [("WARC-Record-ID", own), *shown,
                       ("Content-Type", "application/http; msgtype=response")]
        else:
            fields += [("WARC-Record-ID", own[:-1] + f":{n}>"), ("WARC-Date", DATE),
                       ("WARC-Segment-Origin-ID", own)]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", n))
        if n == len(cuts) > 1:
            fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(fields, block[at:at + segment_bytes])


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
                   payload: str = "html", least_bytes: int = LEAST_BYTES,
                   segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the pages as WARC files below ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"),
                        F.col(url).cast("string").alias("url"), body.alias("payload"))
    big = F.octet_length("payload") >= least_bytes
    twice = written_table(
        rows.where(big).groupBy(F.sha1("payload").alias("digest"))
        .agg(F.max("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).drop("n"), "equal-payloads")
    marked = rows.withColumn("digest", F.when(big, F.sha1("payload"))).join(
        broadcast_if_small(twice), "digest", "left").select(
        "page_id", "url", "payload", "first_page",
        (F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")))
        .alias("refers"))

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            out, size = [], 0
            for page, link, data, first, refers in zip(*cols):
                for r in page_records(page, link, data, first, refers, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    (marked.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
     .write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("origin_id", T.StringType()),
    T.StructField("segment", T.IntegerType()), T.StructField("total", T.LongType()),
    T.StructField("type", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("refers_id", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("digest", T.StringType()),
    T.StructField("block", T.BinaryType()), T.StructField("problem", T.StringType())])


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """Content of a file whose members may be compressed, and what was wrong with a member, if any.

    Behind a broken member reading goes on at the next one.
    """
    out, at, problem = [], 0, None
    while data[at:at + 2] == b"\x1f\x8b":
        start, member = at, zlib.decompressobj(31)
        try:
            while not member.eof and at < len(data):
                piece = data[at:at + 1_000_000]
                out.append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
        except zlib.error as e:
            problem = problem or str(e)
            at = data.find(b"\x1f\x8b\x08", start + 2)
            at = len(data) if at < 0 else at
    return b"".join([*out, data[at:]]), problem


def header_number(fields: dict, name: str, bits: int) -> tuple[int | None, str | None]:
    """The field as a number of so many bits, else null with the reason."""
    text = fields.get(name)
    if text is None:
        return None, None
    if re.fullmatch("-?[0-9]{1,19}", text) and -(1 << bits - 1) <= int(text) < 1 << bits - 1:
        return int(text), None
    return None, f"bad {name}"


def header_digest(text: str) -> tuple[str | None, str | None]:
    """Lower-case hex SHA-1 of a digest field in base 32 or hex; other algorithms are not checked."""
    kind, _, value = text.partition(":")
    if kind.lower() != "sha1":
        return None, None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower(), None
    if re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex(), None
    return None, "bad warc-payload-digest"


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one file, compressed or not.

    Fields that can't be read are null and the record has ``problem``. A stretch that is no whole record
    is a record with nothing but ``problem``; reading goes on at the next line that begins with ``WARC/``.
    """
    text, problem = inflate(data)
    if problem:
        yield {"problem": problem}
    at = 0
    while at < len(text):
        end = text.find(b"\r\n\r\n", at)
        lines = text[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        broken = None
        if not lines[0].startswith("WARC/") or not re.fullmatch("[0-9]{1,18}", size):
            broken = "no record header"
        elif text[end + 4 + int(size):end + 8 + int(size)] != b"\r\n\r\n":
            broken = "record cut short"
        if broken:
            yield {"problem": broken}
            at = end >= 0 and text.find(b"\nWARC/", at) + 1 or len(text)
            continue
        stop = end + 4 + int(size)
        numbers = {name: header_number(fields, field, bits) for name, field, bits in (
            ("segment", "warc-segment-number", 32), ("total", "warc-segment-total-length", 64),
            ("page_id", "x-page-id", 64), ("refers_to", "x-refers-to-page-id", 64))}
        digest, problem = header_digest(fields.get("warc-payload-digest", ""))
        for _, why in numbers.values():
            problem = problem or why
        yield {"record_id": fields.get("warc-record-id"),
               "origin_id": fields.get("warc-segment-origin-id"),
               "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"),
               "refers_id": fields.get("warc-refers-to"), "digest": digest,
               **{name: n for name, (n, _) in numbers.items()},
               "block": text[end + 4:stop], "problem": problem}
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files below ``path``, segments apart."""
    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(),
                                      "binary": pa.binary()}[f.dataType.typeName()]) for f in RECORD])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_archive(content.as_py()):
                    rows.append(r)
                    size += len(r.get("block") or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


DECODED = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("problem", T.StringType())])


@F.arrow_udf(DECODED)
def _decode(block: pa.Array, digest: pa.Array) -> pa.Array:
    payloads, problems = [], []
    for b, want in zip(block, digest):
        payload, problem = None, None
        try:
            payload = payload_of(b.as_py()) if b.is_valid else None
        except ValueError as e:
            problem = f"bad framing: {e}"
        if payload is not None and want.is_valid and hashlib.sha1(payload).hexdigest() != want.as_py():
            payload, problem = None, "digest differs"
        payloads.append(payload)
        problems.append(problem)
    return pa.StructArray.from_arrays(
        [pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], ["payload", "problem"])


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: ``record_id``, ``type``, ``page_id``, ``url``, ``refers_id``, ``refers_to``,
    ``digest``, ``segments``, ``payload`` (null for revisits) and ``problem``."""
    shown = ["record_id", "type", "page_id", "url", "refers_id", "refers_to", "digest"]
    whole = records.where(F.col("segment").isNull()).select(
        *shown, F.lit(1).alias("segments"), "block", "problem")
    # Equal identifiers mean equal payloads: a segment met twice is taken once, a first record counts
    # as often as it is met.
    parts = records.where(F.col("segment").isNotNull()).withColumn(
        "origin", F.coalesce("origin_id", "record_id"))
    first = F.col("segment") == 1
    joined = (
        parts.groupBy("origin").agg(
            F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("s"),
            F.max("total").alias("total"), F.max("problem").alias("wrong"), F.sum(F.when(first, 1).otherwise(0)).alias("n"),
            *[F.max(F.when(first, F.col(c))).alias(c) for c in shown[1:]])
        .withColumn("block", F.aggregate(F.transform("s", lambda x: x["block"]), F.lit(b""),
                                         lambda a, b: F.concat(a, b)))
        .withColumn("problem", F.when(F.col("wrong").isNotNull(), F.col("wrong"))
                    .when(F.col("n") == 0, "no first segment")
                    .when(F.element_at("s", -1)["segment"] != F.size("s"), "segment missing")
                    .when(~F.octet_length("block").eqNullSafe(F.col("total")), "total length differs"))
        .select(F.col("origin").alias("record_id"), *shown[1:], F.size("s").alias("segments"),
                F.when(F.col("problem").isNull(), F.col("block")).alias("block"), "problem",
                F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int"))))
        .drop("col"))
    every = whole.unionByName(joined)
    block = F.when((F.col("type") != "revisit") & F.col("problem").isNull(), F.col("block"))
    return every.withColumn("_d", _decode(block, F.col("digest"))).select(
        *shown, "segments", F.col("_d.payload").alias("payload"),
        F.coalesce("problem", "_d.problem").alias("problem"))


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record, revisits resolved: ``page_id``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to``, ``segments``, ``problem``."""
    whole = written_table(reassemble(read_records(spark, path)).select(
        "record_id", "type", "page_id", "refers_id", "refers_to", "digest", "segments", "problem",
        F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("sha1")), "index")
    named = whole.where(F.col("refers_id").isNotNull()).select(
        F.col("refers_id").alias("found_id")).distinct()
    found = (whole.where((F.col("type") == "response") & F.col("bytes").isNotNull())
             .select(F.col("record_id").alias("found_id"), "bytes", "sha1").join(
                 named, "found_id", "left_semi")
             .groupBy("found_id").agg(F.max("bytes").alias("found_bytes"), F.max("sha1").alias("found_sha1")))
    found = broadcast_if_small(written_table(found, "referred"))
    return whole.join(found, F.col("refers_id") == F.col("found_id"), "left").select(
        "page_id", F.coalesce("bytes", "found_bytes").alias("payload_bytes"),
        F.coalesce("sha1", "found_sha1").alias("payload_digest"), F.col("type").alias("record_type"),
        "refers_to", "segments",
        F.coalesce("problem", F.when(F.col("refers_id").isNotNull() & F.col("found_id").isNull(),
                                     "response missing")).alias("problem"))


def archive_round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Writes the pages below the shared folder and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **kw)
    return page_index(spark, path)
