"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder: ``payloads`` holds the bytes of each distinct payload once,
under its SHA-256, compressed; ``records`` holds the exact header block of every record, the HTTP head that comes before its payload, and the key of the
payload. Originals come back through a join on that key; what a record says of itself is parsed from its header, and each payload is checked against its digest
when it is read.

Bodies cross one exchange when written and one when read. Tasks compress a body and pass on each they have not yet seen, so copies of
a payload, however many, make a row a task; the table of first records is stored before its join, so a payload that a third of all records share can be split.

Defined results: a null payload is the empty one; a null id ranks after all others, and revisits of a payload
that only null ids have refer to null; rows that repeat the id of a payload's first record are responses as it
is; rows that are alike in id, URL and payload are one capture and share a record id; a null URL gives an empty target; control characters and spaces in a URL are
written as percent escapes, so that a header has the lines it should; an empty table gives an empty archive; a payload of any length is one value, as it is in the input. Input columns other than the three
named are not read, so none can clash.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, stored, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Keys of payloads that a task remembers having passed on.
SEEN = 1 << 16


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal digest whose length is a multiple of 5: five digits make four characters."""
    parts = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed bodies, those that this task has passed on lately left out."""
    packer, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        fresh = []
        for at, key in enumerate(batch.column("store_key").to_pylist()):
            if key not in seen:
                seen.add(key)
                fresh.append(at)
        if len(seen) > SEEN:
            seen.clear()
        bodies = batch.column("body")
        yield pa.RecordBatch.from_arrays([batch.column("store_key").take(pa.array(fresh, pa.int64())), pa.array([packer.compress(bodies[at].as_buffer()) for at in fresh], pa.binary())], ["store_key", "body"])


def _uri(url: Column) -> Column:
    """A URL without the characters that would end a header line."""
    for code in (0, 9, 10, 11, 12, 13, 32, 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _urn(page_id: Column, url: Column, store_key: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", page_id.cast("string"), url, store_key), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(digest, a, n), F.lit("-" if a < 21 else ">"))])


def field(header: Column, name: str) -> Column:
    """The value of a header field; null where there is none."""
    value = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(F.contains(F.concat(F.lit("\r\n"), header), F.lit(f"\r\n{name}: ")), value)


def _restore(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        payloads = [opener.decompress(b.as_buffer()) for b in batch.column("body")]
        for key, size, payload in zip(batch.column("store_key").to_pylist(), batch.column("payload_bytes").to_pylist(), payloads, strict=True):
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != key:
                raise ValueError(f"payload {key} does not match its digest")
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(payloads, pa.binary())], [*batch.schema.names[:-1], "payload"])


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write a record for each row of ``pages``. Of equal payloads of ``min_revisit_bytes`` or more, the record with the
    smallest id is the response and the others revisit it; smaller payloads are all responses. Either way
    the bytes are stored once."""
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    keyed = rows.select("page_id", "url", F.sha2("body", 256).alias("store_key"), F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("sha1"))
    # One small row per payload, combined before the shuffle.
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("l")
    firsts = stored(keyed.groupBy("store_key").agg(least).select("store_key", F.col("l.page_id").alias("first_id"), F.col("l.url").alias("first_url")), "firsts")
    kind = keyed.join(firsts, "store_key")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("payload_bytes") < min_revisit_bytes)
    revisit = F.col("record_type") == "revisit"
    head = F.when(revisit, "").otherwise(F.concat(F.lit(HTTP_HEAD), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.coalesce("url", F.lit("")))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"), F.col("url"), F.col("store_key"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first_id"), F.col("first_url"), F.col("store_key")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _uri(F.coalesce("first_url", F.lit(""))))),
        # Fields of our own, which readers that do not know them leave alone: ids of pages, for results without a second join.
        F.concat(F.lit("X-Page-ID: "), _uri(F.col("page_id").cast("string"))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), _uri(F.col("first_id").cast("string")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise((F.octet_length("http") + F.col("payload_bytes")).cast("string"))),
    ]
    records = kind.withColumn("record_type", F.when(is_first, "response").otherwise("revisit")).withColumn("http", head)
    records = records.withColumn("header", F.concat_ws("\r\n", *lines)).select("page_id", "url", "header", "http", "store_key", "payload_bytes")
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    packed = rows.select(F.sha2("body", 256).alias("store_key"), "body").mapInArrow(_compress, "store_key string, body binary")
    once = packed.groupBy("store_key").agg(F.first("body").alias("body"))
    once.write.option("compression", "none").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive with what its header says and its full payload; raises where bytes do not match their digest."""
    small_batches(spark)
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    whole = records.join(payloads, "store_key").select(*records.columns, "body")
    kinds = [f"`{n}` {t}" for n, t in records.dtypes] + ["payload binary"]
    back = whole.mapInArrow(_restore, ", ".join(kinds))
    said = {"record_type": field(F.col("header"), "WARC-Type"), "payload_digest": F.regexp_replace(field(F.col("header"), "WARC-Payload-Digest"), "^sha1:", ""), "refers_to": field(F.col("header"), "X-Refers-To-Page-ID").cast(dict(records.dtypes)["page_id"])}
    return back.withColumns(said)


def record_bytes(header: str, http: str, payload: bytes, record_type: str) -> bytes:
    """One record as it stands in a WARC file."""
    return header.encode() + b"\r\n\r\n" + (b"" if record_type == "revisit" else http.encode() + payload) + b"\r\n\r\n"


def parse_records(data: bytes) -> list[tuple[str, bytes]]:
    """Header block and content of each record in the bytes of a WARC file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        header = data[at:end].decode()
        size = next(int(x.split(":", 1)[1]) for x in header.split("\r\n") if x.lower().startswith("content-length:"))
        found.append((header, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return found


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path)
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")


_DIGITS = "||".join(f"substr('{ALPHABET}', (((('0x' || substr(h, 5*i+1, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)" for s in (15, 10, 5, 0))
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: {_DIGITS}), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""
