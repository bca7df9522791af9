"""WARC archives: writing, reading, and revisit resolution.

Archives are gzip files of WARC/1.1 records, written by Spark's own text writer
(so by its commit protocol: a lost executor leaves no half file) and read with
its binary reader, so they can lie in any store that Spark reaches. A file holds
at most RECORDS_PER_FILE records and about ARCHIVE_BYTES; a reader holds it
compressed and unpacks one record at a time.

Revisit resolution: headers are shuffled by payload digest, payloads stay where they are; of the records with
one digest the largest page_id stays the response and all others become revisit
records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm.common import bit_table, has_bit, scratch, small_batches, written

#: The most records and about the most bytes of an archive, before compression.
RECORDS_PER_FILE, ARCHIVE_BYTES = 2000, 64 << 20
_PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: The digits of conv() in base 32 and those of RFC 4648.
_CONV32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1, without a prefix: eight groups of 20 bits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV32, _RFC32)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add refers_to to (page_id, payload_digest, payload_bytes, ...): null for responses.

    Of records with equal payloads of at least `least_bytes` bytes the largest
    page_id is the response; smaller payloads are all responses. Repeated rows
    of the largest page_id are responses all; a null page_id is never the
    response of others unless all are null. Digests are pre-aggregated before
    the shuffle, and the join back has one row per digest on one side, so a
    digest that a third of all rows share is split by adaptive execution.
    """
    large = F.col("payload_bytes") >= least_bytes
    first = headers.where(large).groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    with_first = headers.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = large & F.col("_digest").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return with_first.withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first", "_digest")


def resolved_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, payload) as rows for write_archives(), of which only headers are shuffled.

    Headers, digests among them, are resolved apart from the payloads and stored.
    Payloads then stay where they are read: a bit table of the revisits says which
    page is certainly none, a second one of the other pages whose bits are set there
    says which is certainly one, and only the few pages between, whose hashes
    collide, are joined with the revisits' headers. Both tables are of bounded size;
    a corpus beyond it moves more payloads and loses none.
    """
    spark = pages.sparkSession
    page = F.xxhash64("payload", "page_id").alias("_at")
    headers = written(resolve(with_digest(pages).select("page_id", "url", "payload_digest", "payload_bytes", page), least_bytes), "headers")
    revisits = headers.where("refers_to IS NOT NULL")
    first = bit_table(revisits.select("_at").distinct())
    sent_first = spark.sparkContext.broadcast(first)

    @F.pandas_udf("boolean")
    def may_be_one(at: pd.Series) -> pd.Series:
        return pd.Series(has_bit(sent_first.value, at.to_numpy().view(np.uint64)))

    sent_second = spark.sparkContext.broadcast(bit_table(headers.where("refers_to IS NULL").where(may_be_one("_at")).select("_at").distinct()))

    @F.pandas_udf("int")
    def route(at: pd.Series) -> pd.Series:
        hashes = at.to_numpy().view(np.uint64)
        return pd.Series(np.where(has_bit(sent_first.value, hashes), np.where(has_bit(sent_second.value, hashes), 1, 2), 0), dtype="int32")

    routed = pages.withColumn("_route", route(page))
    bare = revisits.select("page_id", "url", F.lit(b"").alias("payload"), "payload_digest", "payload_bytes", "refers_to")
    sure = with_digest(routed.where("_route = 0").drop("_route"))
    known = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).distinct()
    unsure = with_digest(routed.where("_route = 1").drop("_route")).join(known, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left_anti")
    return sure.unionByName(unsure).withColumn("refers_to", F.lit(None).cast("long")).unionByName(bare)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Control characters in a value would end the line: they are percent-encoded."""
    clean = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column, kind: str) -> Column:
    return F.concat(F.lit(f"<urn:page:{kind}:"), page_id.cast("string"), F.lit(">"))


def records(resolved: DataFrame) -> Column:
    """The WARC record of a row of (page_id, url, payload, payload_digest, payload_bytes, refers_to) without its last CRLF.

    Further columns, where a row has them, stand for what is else made up: http_head,
    date, record_id, and refers_to_id in the place of refers_to. `other` is a whole
    record of another type, which stays as it is. Bytes stay bytes: the column is
    text in name only.
    """
    own = lambda name, kind="string": F.col(name) if name in resolved.columns else F.lit(None).cast(kind)
    target = F.coalesce(own("refers_to_id"), _record_id(F.col("refers_to"), "response"))
    revisit = target.isNotNull()
    as_text = lambda c: c.cast("binary").cast("string")
    made_head = F.concat(F.lit(_HTTP), F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.coalesce(as_text(own("http_head", "binary")), made_head), F.when(revisit, F.lit("")).otherwise(as_text(F.col("payload"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.coalesce(own("record_id"), F.when(revisit, _record_id(F.col("page_id"), "revisit")).otherwise(_record_id(F.col("page_id"), "response")))),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Date", F.coalesce(own("date"), F.lit(DATE))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", target),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.coalesce(as_text(own("other", "binary")), F.concat(head, F.lit("\r\n"), block, F.lit("\r\n")))


def write_archives(resolved: DataFrame, path: str, mean_bytes: float = 0) -> None:
    """Write resolved rows as archives below `path`, of about ARCHIVE_BYTES if records have so many bytes on the average. The writer's line end completes each record's two CRLFs."""
    most = max(1, min(RECORDS_PER_FILE, int(ARCHIVE_BYTES / max(1.0, mean_bytes))))
    resolved.select(records(resolved).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _plain(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, plain or in gzip members, piece by piece."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + _PIECE] for i in range(0, len(data), _PIECE))
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            piece = data[at : at + _PIECE]
            at += len(piece)
            while piece or member.unconsumed_tail:
                yield member.decompress(piece or member.unconsumed_tail, _PIECE)
                piece = b""
                if member.eof:
                    break
        at -= len(member.unused_data)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The records of one archive, one at a time: headers by lower-case name, the block, and the header as it stands."""
    held, pieces = bytearray(), _plain(data)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        end = held.find(b"\r\n\r\n")
        if end < 0 or len(held) < 2:
            if more():
                continue
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(fields["content-length"])
        while len(held) < stop:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(held[end + 4 : stop]), bytes(held[: end + 4])
        del held[:stop]


_READ = "page_id long, url string, record_type string, record_id string, refers_to_id string, date string, payload_digest string, payload_bytes long, digest_ok boolean, http_head binary, payload binary, other binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record below `path`; without `payloads` the three binary columns are null.

    payload_digest is the header's; digest_ok says whether the payload has it
    (null for revisits, which have none). payload_bytes is the length of the
    payload found, and null for revisits: follow() finds it. A record of another
    type than response and revisit is in `other` as it stands. A task holds one
    compressed archive and one record of it at a time.
    """
    import re

    keep = re.compile(r"-?\d+")

    def row(f: dict[str, str], block: bytes, head: bytes) -> tuple:
        http, gap, body = block.partition(b"\r\n\r\n")
        kind = f.get("warc-type")
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        response = kind == "response"
        ok = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest if response else None
        page, known = f.get("warc-page-id", ""), kind in ("response", "revisit")
        page_id = int(page) if keep.fullmatch(page) else None
        binary = (http + gap if known else None, body if response else None, None if known else head + block + b"\r\n") if payloads else (None, None, None)
        return (page_id, f.get("warc-target-uri"), kind, f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-date"), digest, len(body) if response else None, ok, *binary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for f, block, head in parse(data.as_buffer()):
                    rows.append(row(f, block, head))
                    size += len(block) if payloads else 100
                    if size > _PIECE:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return small_batches(files).mapInArrow(read, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


_NAMES = [x.split(" ")[0] for x in _READ.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split(" ")[1]] for x in _READ.split(", ")]


def follow(read: DataFrame) -> DataFrame:
    """Join revisit records to their original responses: payload_bytes becomes the original's, refers_to its page_id.

    A revisit whose original is in no archive keeps null in both.
    """
    original = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    return read.join(original, F.col("refers_to_id") == F.col("_id"), "left").withColumns({"refers_to": F.col("_page"), "payload_bytes": F.coalesce("payload_bytes", "_bytes")}).drop("_id", "_page", "_bytes")


def as_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload) from (page_id, url, html); null html is an empty payload."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))


def with_digest(payloads: DataFrame) -> DataFrame:
    return payloads.withColumns({"payload_digest": payload_digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Read archives, resolve equal payloads and write deduplicated archives with fresh headers.

    Of the responses with equal payloads of at least `least_bytes` bytes the one
    with the largest page_id, then record id, stays; the others, and revisits whose
    original is in no archive but whose digest is, refer to it. A revisit without
    either stays as it is. Payloads, HTTP heads, dates and record ids are kept byte
    for byte, and records of other types (requests, metadata) are copied.
    """
    rows = read_archives(spark, source)
    heads = rows.where("record_type IN ('response', 'revisit')").select("record_id", "page_id", "record_type", "refers_to_id", "payload_digest", "payload_bytes")
    order = F.struct("page_id", "record_id")
    first = heads.where("record_type = 'response' AND payload_digest IS NOT NULL").where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("_digest")).agg(F.max_by("record_id", order).alias("_first"))
    told = heads.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    to = F.when(F.col("_first").isNull() | (F.col("_first") == F.col("record_id")), F.when(F.col("record_type") == "revisit", F.col("refers_to_id"))).otherwise(F.col("_first"))
    # told of the heads alone; what is written is read again and told apart by record id, so no payload waits for its group
    revisit = written(told.select(F.col("record_id").alias("_id"), to.alias("_to")).where("_to IS NOT NULL").distinct(), "revisits")
    known = rows.join(revisit, F.col("record_id") == F.col("_id"), "left").withColumn("refers_to_id", F.col("_to")).withColumn("refers_to", F.lit(None).cast("long")).drop("_id", "_to")
    write_archives(known.withColumns({"payload_bytes": F.coalesce("payload_bytes", F.lit(0).cast("long")), "payload": F.coalesce("payload", F.lit(b""))}), target)


def op6(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write one record per page, read the archives back, and return what they say.

    Null html is an empty payload, a null page_id is carried as null, repeated
    rows of the response's page_id are responses too, an empty table gives no
    rows; further columns are ignored; a very long page is one record of its archive.
    """
    path = scratch(spark, "warc")
    payloads = as_payloads(pages)
    mean = payloads.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    write_archives(resolved_pages(payloads, 0), path, mean)
    read = read_archives(spark, path, payloads=False)
    return follow(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, list_aggregate([substr('{_RFC32}', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN true END AS digest_ok
FROM d
"""
