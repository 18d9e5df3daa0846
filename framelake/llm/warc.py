"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records by join.

``write_archive`` stores two sets of WARC files. ``payloads/`` holds one resource record for each
distinct payload, named by its SHA-256; ``headers/`` holds, for every page, the exact header block
of its record (response or revisit). ``read_archive`` parses both, recomputes and checks every
digest, and joins them to the original records. Files are plain gzip-compressed WARC, written by
Spark's text writer (each record ends in the writer's line separator CR LF CR LF) and read by
length, so payloads may contain anything, line ends and WARC headers included.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.runtime import HOT_ROWS, batches_of, join_hot, shared_dir, staged

EOL = "\r\n"
FILE_BYTES = 32 << 20  #: of records, after which a file ends
DATE = "2024-01-01T00:00:00Z"  #: of records that bring no date, so that reruns write the same bytes


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes, without Python.

    160 bits are 32 groups of five; a group is read from at most four hexadecimal digits.
    """
    digest = F.sha1(payload)
    five = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _group(digest, i))
    return F.array_join(five, "")


def _group(digest: Column, i: Column) -> Column:
    bit = i * 5
    nibble = F.floor(bit / 4).cast("int")
    pair = F.conv(F.rpad(F.substring(digest, nibble + 1, F.lit(2)), 2, "0"), 16, 10).cast("int")
    value = F.floor(pair / F.pow(F.lit(2), 3 - bit % 4)).cast("int") % 32
    return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), value + 1, F.lit(1))


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit(EOL))])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def write_archive(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", smallest: int = 0, file_bytes: int = FILE_BYTES, hot_rows: int = HOT_ROWS) -> str:
    """Write the archive of ``pages`` and return its folder (a fresh shared one, unless ``path`` is given).

    Of pages whose payloads (UTF-8 of ``html``; null: empty) are equal and have at least
    ``smallest`` bytes, the one with the least key is a response and the others are revisits of
    it; pages with smaller payloads are all responses. Every row has a record of its own, repeated
    rows and rows that share a key too (of them the least url goes first); a null key comes after all
    others, and its record has no key field. A null url gives an empty target. Control characters in
    a url are written percent-encoded, as a header line cannot hold them. An empty table writes an
    archive of no records. Other columns are not read. A file ends with the record that brings it to
    ``file_bytes``, so its size does not depend on how long pages are, but for one record. Payloads with more
    than ``hot_rows`` copies are joined apart.

    The address of a payload is its SHA-256 with its length. Whether two different payloads ever
    share one is checked by a second digest of another family (SHA-1) and reported as an error.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    figures = rows.select("key", "url", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha256"), sha1_base32(F.col("payload")).alias("sha1"))
    narrow = staged(figures.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "url", "row")
    stored = staged(narrow.groupBy("sha256", "bytes").agg(F.min(order).alias("first"), F.min("sha1").alias("low"), F.max("sha1").alias("high")))
    if stored.where("low <> high").limit(1).count():
        raise ValueError("two payloads share an address")
    winners = stored.select(F.col("first.key").alias("key"), F.col("first.url").alias("url"), "sha256", F.col("low").alias("sha1"), "bytes")
    found = rows.withColumn("sha256", F.sha2("payload", 256)).alias("r").join(winners.alias("w"), (F.col("r.sha256") == F.col("w.sha256")) & (F.col("r.url") == F.col("w.url")) & F.col("r.key").eqNullSafe(F.col("w.key")))
    kept = found.select("r.payload", "w.sha256", "w.sha1", "w.bytes")
    if narrow.count() != narrow.select("key", "url", "sha256").distinct().count():
        kept = kept.dropDuplicates(["sha256"])
    resource = F.concat(
        _lines("WARC/1.1", "WARC-Type: resource", _field("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), "sha256", F.lit(">"))), f"WARC-Date: {DATE}"),
        _lines(_field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), "Content-Type: text/html", _field("Content-Length", F.col("bytes")), ""),
        F.col("payload"),
    )
    _write(kept.select(resource.alias("value")), f"{path}/payloads", file_bytes)
    named = join_hot(narrow, stored.select("sha256", "bytes", "first"), ["sha256", "bytes"], hot_rows)
    is_revisit = (F.col("bytes") >= smallest) & (F.col("row") != F.col("first.row"))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record_id = lambda c: F.concat(F.lit("<urn:record:"), F.col(c).cast("string"), F.lit(">"))
    optional = lambda name, c: F.when(F.col(c).isNotNull(), _lines(_field(name, F.col(c)))).otherwise(F.lit(""))
    profile = _lines("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", _field("WARC-Refers-To", record_id("first.row")))
    header = F.concat(
        _lines("WARC/1.1", _field("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")), _field("WARC-Record-ID", record_id("row"))),
        _lines(f"WARC-Date: {DATE}", _field("WARC-Target-URI", safe), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1"))),
        optional("X-Page-Key", "key"),
        F.when(is_revisit, F.concat(profile, optional("X-Refers-To-Key", "first.key"))).otherwise(F.lit("")),
        _lines(_field("X-Payload-Address", F.concat(F.lit("sha256:"), "sha256")), _field("Content-Length", F.when(is_revisit, 0).otherwise(F.col("bytes"))), ""),
    )
    # a record of its own that carries the exact header block of the original record
    block = F.concat(_lines("WARC/1.1", "WARC-Type: metadata", _field("WARC-Record-ID", F.concat(F.lit("<urn:header:"), F.col("row").cast("string"), F.lit(">"))), f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", _field("Content-Length", F.octet_length("h")), ""), F.col("h"))
    _write(named.select("row", header.alias("h")).select(block.alias("value")), f"{path}/headers", file_bytes)
    return path


def _write(records: DataFrame, path: str, file_bytes: int) -> None:
    """Records as text files of a row each: as many records, with line separators between them, as reach ``file_bytes``."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, size = [], 0
        for batch in batches:
            for record in batch["value"]:
                have.append(record)
                size += len(record)
                if size >= file_bytes:
                    yield pd.DataFrame({"value": [(EOL * 2).encode().join(have)]})
                    have, size = [], 0
        if have:
            yield pd.DataFrame({"value": [(EOL * 2).encode().join(have)]})

    as_bytes = records.select(F.col("value").cast("binary").alias("value"))
    with batches_of(records.sparkSession, 64):
        whole = as_bytes.mapInPandas(files, "value binary").select(F.col("value").cast("string").alias("value"))
        whole.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Records of a WARC stream: (fields with lower-case names, header block, content)."""
    have = b""
    ended = False
    chunks = iter(chunks)
    while True:
        end = have.find(b"\r\n\r\n")
        while end < 0 and not ended:
            more = next(chunks, None)
            ended = more is None
            have += more or b""
            end = have.find(b"\r\n\r\n")
        if end < 0:
            if have.strip():
                raise ValueError("a record is cut off")
            return
        head = have[: end + 4]
        first, *lines = head[:-4].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts with {first[:40]!r}")
        fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
        need = end + 4 + int(fields["content-length"]) + 4
        parts = [have]
        size = len(have)
        while size < need and not ended:
            more = next(chunks, None)
            ended = more is None
            parts.append(more or b"")
            size += len(parts[-1])
        have = b"".join(parts)
        if len(have) < need:
            raise ValueError("a record is cut off")
        if have[need - 4 : need] != b"\r\n\r\n":
            raise ValueError("a record's length does not fit")
        yield fields, head, have[end + 4 : need - 4]
        have = have[need:]


def _unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    while data:
        z = zlib.decompressobj(31)
        out = z.decompress(data, step)
        while out or z.unconsumed_tail:
            yield out
            out = z.decompress(z.unconsumed_tail, step)
        data = z.unused_data


def _read(spark: SparkSession, path: str, schema: str, row) -> DataFrame:
    def parsed(batches):
        for batch in batches:
            for data in batch["content"]:
                out = []
                for record in parse_records(_unzipped(data)):
                    out.append(row(*record))
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in schema.split(",")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    with batches_of(spark, 1):  # a row is a whole file
        return staged(files.mapInPandas(parsed, schema))


def _stored_payload(fields: dict, head: bytes, content: bytes) -> tuple:
    sha256 = fields["warc-record-id"].removeprefix("<urn:sha256:").removesuffix(">")
    sha1 = base64.b32encode(hashlib.sha1(content).digest()).decode()
    if hashlib.sha256(content).hexdigest() != sha256 or fields["warc-payload-digest"] != f"sha1:{sha1}":
        raise ValueError(f"payload {sha256} does not have its digest")
    return sha256, len(content), sha1, content


def read_payloads(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """``(sha256, bytes, sha1[, payload])`` of the stored payloads, each checked against its digests."""
    if content:
        return _read(spark, f"{path}/payloads", "sha256 string, bytes long, sha1 string, payload binary", _stored_payload)
    return _read(spark, f"{path}/payloads", "sha256 string, bytes long, sha1 string", lambda *r: _stored_payload(*r)[:3])


def _stored_header(fields: dict, head: bytes, content: bytes) -> tuple:
    lines = content.decode("utf-8").split("\r\n")[1:]
    inner = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines if x)}
    return inner.get("x-page-key"), inner["warc-type"], inner.get("x-refers-to-key"), inner["warc-payload-digest"].removeprefix("sha1:"), inner["x-payload-address"].removeprefix("sha256:"), content


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(key, record_type, refers_to, sha1, sha256, header)`` of all records; keys as text."""
    return _read(spark, f"{path}/headers", "key string, record_type string, refers_to string, sha1 string, sha256 string, header binary", _stored_header)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``(key, record_type, refers_to, payload_bytes, payload_digest, record)``.

    ``record`` is the header block, for a response followed by its payload. Bytes and digest are
    those of the full payload as it was found in the store, for revisits too. Where only narrow
    columns are used, select them from ``read_records``, which does not carry payloads.
    """
    headers, payloads = read_headers(spark, path), read_payloads(spark, path).withColumnRenamed("sha1", "stored")
    # revisits, which may be many of one payload, need its figures only
    revisits = join_hot(headers.where("record_type <> 'response'"), payloads.drop("payload"), ["sha256"]).withColumn("payload", F.lit(b""))
    responses = headers.where("record_type = 'response'").join(payloads, "sha256")
    return responses.unionByName(revisits).select("key", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("stored").alias("payload_digest"), F.concat("header", "payload").alias("record"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_archive`` without the record bytes; every header must find its payload under both digests."""
    stored = read_payloads(spark, path, content=False)
    found = join_hot(read_headers(spark, path).drop("header"), stored.withColumnRenamed("sha1", "stored"), ["sha256"])
    checked = F.when(F.col("sha1") == F.col("stored"), F.col("stored")).otherwise(F.raise_error(F.concat(F.lit("no payload of record "), F.coalesce("key", F.lit("without a key")))))
    return found.select("key", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"))
