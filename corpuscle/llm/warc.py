"""WARC: write archives, read them back, and resolve revisits by payload digest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, written

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one archive file; with them its size stays that of a few thousand pages.
RECORDS_PER_FILE = 20_000
DATE = "2020-01-01T00:00:00Z"
#: The alphabets of base 32 as numbers and as RFC 4648 has it.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes, in built-in functions: 40 bits at a time."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends in a value would end the header, so they become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archive(records: DataFrame, path: str) -> None:
    """Write WARC/1.1 records as gzip archives, through Spark's text writer (any file system).

    records: record_id, type (response or revisit), page_id, url, digest, n_bytes (of the full payload), refers_to (a
    record id or null) and payload (text, null for a revisit).
    """
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.coalesce("payload", F.lit("")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.col("type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(F.col("type") == "revisit", F.lit(PROFILE))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("refers_to"), F.lit(">"))),
        _header("X-Page-ID", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    writer = records.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("zlib.compress.level", "THREE").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_LENGTH = re.compile(rb"^Content-Length: *(\d+)", re.M | re.I)
_FIELDS = {k: re.compile(rb"^%s: *([^\r\n]*)" % v, re.M | re.I) for k, v in {"type": b"WARC-Type", "record_id": b"WARC-Record-ID", "url": b"WARC-Target-URI", "digest": b"WARC-Payload-Digest", "refers_to": b"WARC-Refers-To", "page_id": b"X-Page-ID"}.items()}
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("record_id", "type", "page_id", "url", "digest", "refers_to")] + [T.StructField("n_bytes", T.LongType())])


def _value(name: str, head: bytes) -> str | None:
    found = _FIELDS[name].search(head)
    if not found:
        return None
    value = found[1].decode()
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<urn:uuid:").removesuffix(">")
    return value.removeprefix("sha1:") if name == "digest" else value


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record, by Content-Length; pieces are what stands between blank lines.

    A block that ends in a line end shifts the blank line after it, so that its last piece holds the next header too.
    """
    end, held = END.encode(), b""
    while (piece := held or next(pieces, None)) is not None:
        head, held = piece.lstrip(b"\r\n"), b""
        if not head.startswith(b"WARC/"):
            continue
        length = int(_LENGTH.search(head)[1])
        block, have = [], -len(end)
        while have < length:
            part = next(pieces, None)
            if part is None:
                break
            block.append(part)
            have += len(part) + len(end)
        whole = end.join(block)
        held = whole[length:].lstrip(b"\r\n")
        yield head, whole[:length]


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of an archive: header fields, `n_bytes` (of the payload, as the HTTP header tells) and, if asked for, `payload`.

    An archive is read as a stream between blank lines, each file in one task (gzip files are never split).
    """
    lines = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"))
    schema = T.StructType([*RECORD.fields, T.StructField("payload", T.StringType())]) if payload else RECORD
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "n_bytes" else pa.string()) for n, c in zip(names, columns, strict=True)], names)

        rows, held = [], 0
        pieces = (v.as_py() for b in batches for v in b.column(0))
        for head, block in _records(pieces):
            http, _, body = block.partition(END.encode())
            told = _LENGTH.search(http)
            row = [_value(n, head) for n in names[:6]] + [int(told[1]) if told else len(body)]
            if payload:
                row.append(body.decode())
                held += len(body)
            rows.append(row)
            if len(rows) >= 2000 or held > 8 << 20:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    return lines.mapInArrow(run, schema)


def page_records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record for each row. Repeated rows have one record id: they are one page stored more than once."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page).cast("string").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), digest32(payload).alias("digest"))
    hexed = F.md5(F.concat_ws("\n", F.coalesce("page_id", F.lit("-")), F.coalesce("url", F.lit("-")), "digest").cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return rows.select(uuid.alias("record_id"), F.lit("response").alias("type"), "page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), F.lit(None).cast("string").alias("refers_to"), "payload")


def dedup_archive(spark: SparkSession, source: str, target: str, least: int = 0) -> None:
    """Write the archive `source` to `target` with each payload of at least `least` bytes stored once, under fresh headers.

    Only headers are shuffled by digest: the response with the largest numeric page id (ties: record id) stays, every other
    one becomes a revisit of it. Kept payloads are fetched by record id, which is unique, so a payload that a third of
    all pages share moves once. Revisits that `source` holds already point to the kept response of their digest, or stay
    as they are if there is none. Smaller payloads are all kept.
    """
    heads = written(read_archive(spark, source).groupBy("record_id", "type", "page_id", "url", "digest", "n_bytes", "refers_to").agg(F.count(F.lit(1)).alias("n")), "warc-heads")
    large = F.col("n_bytes") >= least
    order = F.struct(F.col("page_id").cast("decimal(38,0)").alias("p"), F.col("page_id").alias("s"), F.col("record_id").alias("r"))
    best = heads.where((F.col("type") == "response") & large).groupBy("digest").agg(F.max(order).alias("best")).select("digest", F.col("best.r").alias("kept"))
    best = written(best, "warc-kept")
    full = read_archive(spark, source, payload=True).where("type = 'response'")
    winners = full.join(best.select(F.col("kept").alias("record_id")), "record_id").dropDuplicates(["record_id"])
    small = full.where(~large)
    known = heads.where((F.col("type") == "revisit") | large).join(best, "digest", "left")
    again = F.expr("explode(sequence(1L, n - if(record_id = kept, 1L, 0L)))")
    others = known.where("n > 1 OR NOT record_id <=> kept").select("*", again.alias("copy"))
    fresh = F.when((F.col("copy") > 1) | (F.col("record_id") == F.col("kept")), F.concat("record_id", F.lit("-"), F.col("copy").cast("string"))).otherwise(F.col("record_id"))
    others = others.select(fresh.alias("record_id"), F.lit("revisit").alias("type"), "page_id", "url", "digest", "n_bytes", F.coalesce("kept", "refers_to").alias("refers_to"), F.lit(None).cast("string").alias("payload"))
    columns = ["record_id", "type", "page_id", "url", "digest", "n_bytes", "refers_to", "payload"]
    out = winners.select(*columns).unionByName(others.select(*columns))
    write_archive(out if least <= 0 else out.unionByName(small.select(*columns)), target)


def resolve(records: DataFrame) -> DataFrame:
    """Records read from an archive with each revisit joined to its original response: `original_page` and the payload's size.

    A revisit whose original is not there has a null `original_page` and its own header's size.
    """
    originals = records.where("type = 'response'").select(F.col("record_id").alias("__id"), F.col("page_id").alias("original_page"), F.col("n_bytes").alias("__n"))
    revisits = records.where("type = 'revisit'").join(originals, F.col("refers_to") == F.col("__id"), "left")
    kept = records.where("type = 'response'").select("*", F.lit(None).cast("string").alias("original_page"))
    return kept.unionByName(revisits.withColumn("n_bytes", F.coalesce("__n", "n_bytes")).drop("__id", "__n"))


def archive_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Archive `pages`, deduplicate the archive, read it back: one row per page, `page`, `payload_bytes`,
    `payload_digest`, `record_type` and `refers_to` (the original's page, null for a response).

    A null page has an empty payload. Rows with equal page id, URL and payload are one response and revisits of it; a
    null page id ranks lowest. Extra columns are ignored; an empty table gives no rows.
    """
    spark, kind = pages.sparkSession, pages.schema[page].dataType
    first, second = shared_path(spark, "warc-in"), shared_path(spark, "warc-out")
    write_archive(page_records(pages, page, url, html), first)
    dedup_archive(spark, first, second, least)
    found = resolve(read_archive(spark, second))
    return found.select(F.col("page_id").cast(kind).alias(page), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("original_page").cast(kind).alias("refers_to"))
