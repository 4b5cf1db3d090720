"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records that name each other by WARC-Concurrent-To: request,
response (or revisit) and metadata. Archives are written by Spark's text writer
with CRLF as line separator: a record ends in CRLF CRLF, so a row that holds
records without the last CRLF gives exact WARC bytes, on any file system, with
the writer's commit protocol. They are read as binary files, a record at a time
by its Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X

#: Payload bytes of one archive file, about; captures in it, at most.
FILE_BYTES = 64 << 20
FILE_CAPTURES = 20_000
#: Join keys over which the rows of one digest are spread.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: eight groups of 20 bits, each four digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last CRLF; fields with a null value are left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <urn:uuid:"), record_id, F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Write a request, a response or revisit and a metadata record for each row, as gzipped archives under `path`.

    Of rows with equal payloads of at least least_bytes bytes, the one with the smallest id is the response (all rows
    that tie on id and payload are), the others are revisits without payload. Null payloads are empty; line breaks in
    urls are removed from the headers; rows whose ids are null are responses if no row with that payload has an id, else
    revisits. Record ids are hashes of id, url, payload and the number of such a row, so a rerun gives the same. Files hold
    about FILE_BYTES of payload by its mean length.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.regexp_replace(F.col(f"`{url_col}`"), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    # rows alike in id, url and payload have one key; which of equal payloads is first is told from keys alone
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-")), F.coalesce(F.concat(F.lit("="), "url"), F.lit("-")), F.col("digest"))))
    narrow = X.keep(rows.select("id", "digest", "key", F.octet_length("payload").alias("bytes")), "warc-keys")
    first = narrow.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    salted = first.select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = narrow.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    alone = F.col("least").isNull() | F.col("id").eqNullSafe(F.col("least")) | (F.col("bytes") < least_bytes)
    later = own.where(~alone).select("key").distinct().withColumn("later", F.lit(True))
    rows = rows.join(later, "key", "left").withColumn("fresh", F.col("later").isNull())
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("digest")))

    def uuid(kind: str) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(kind), F.col("key"), F.col("copy").cast("string")))
        return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")

    root = uuid("response")
    near = F.concat(F.lit("<urn:uuid:"), root, F.lit(">"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}")
    request = _record("request", uuid("request"), [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", near), ("Content-Type", F.lit("application/http; msgtype=request"))], get)
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", root, common, F.concat(head, F.col("payload").cast("string")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    revisit = _record("revisit", root, [*common, profile], head)
    meta = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit(f"via: crawl{CRLF}"))
    metadata = _record("metadata", uuid("metadata"), [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", near), ("Content-Type", F.lit("application/warc-fields"))], meta)
    text = F.concat(request, F.lit(CRLF), F.when(F.col("fresh"), response).otherwise(revisit), F.lit(CRLF), metadata)
    mean = narrow.agg(F.avg("bytes")).first()[0] or 0
    most = max(1, min(FILE_CAPTURES, int(FILE_BYTES / (mean + 1))))
    rows.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


RECORD_DDL = "type string, record_id string, concurrent_to string, uri string, digest string, payload_bytes long, payload binary, fields map<string,string>"
_RECORD = pa.schema(
    [("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()),
     ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def _inflated(data, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of a plain file, in pieces."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        for lo in range(0, len(view), step):
            yield bytes(view[lo : lo + step])
        return
    z, at = zlib.decompressobj(31), 0
    rest, begun = b"", False
    while at < len(view) or rest:
        if not rest:
            rest = bytes(view[at : at + step])
            at += len(rest)
        begun = begun or bool(rest)
        out = z.decompress(rest, 4 * step)
        rest = z.unconsumed_tail
        if out:
            yield out
        if z.eof:
            rest = z.unused_data + rest
            z, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("archive ends within a compressed member")


class _Reader:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.have, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.have, self.at = self.have[self.at :] + piece, 0
        return True

    def upto(self, mark: bytes) -> bytes | None:
        while (i := self.have.find(mark, self.at)) < 0:
            if not self.more():
                return None
        out, self.at = self.have[self.at : i], i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, short = [], n
        while short > len(self.have) - self.at:
            parts.append(self.have[self.at :])
            short -= len(parts[-1])
            self.have, self.at = b"", 0
            if not self.more():
                raise ValueError("archive ends within a record")
        parts.append(self.have[self.at : self.at + short])
        self.at += short
        return b"".join(parts)


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of each record of an archive. Of a repeated field the last counts, but
    all values of WARC-Concurrent-To do, one a line."""
    reader = _Reader(_inflated(data))
    while (head := reader.upto(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one was expected: {lines[0][:60]!r}")
        fields: dict[str, str] = {}
        for k, _, v in (x.partition(":") for x in lines[1:]):
            name, before = k.strip().lower(), fields.get(k.strip().lower())
            fields[name] = f"{before}\n{v.strip()}" if before is not None and name == "warc-concurrent-to" else v.strip()
        block = reader.take(int(fields["content-length"]))
        reader.take(4)
        yield fields, block
    if reader.have[reader.at :].strip(b"\r\n\0"):
        raise ValueError("archive ends within a record")


def _parse(batches):
    for batch in batches:
        rows, size = [], 0
        for data in batch.column(0):
            for fields, block in records(data.as_buffer()):
                kind = fields.get("warc-type")
                own: dict[str, str] = {}
                payload = b""
                if kind in ("response", "revisit", "request"):
                    payload = block[block.find(b"\r\n\r\n") + 4 :]
                elif kind == "metadata":
                    own = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k}
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest is not None and found != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} has digest {found}, its record says {digest}")
                    digest = found
                rows.append((kind, fields["warc-record-id"], fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), digest, len(payload), payload, list(own.items())))
                size += len(payload) + 500
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)
                    rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)


def read_warc(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """One row for each record of the archives under `path` whose file names match `names` (gzipped, by record or as a
    whole, or plain). Names that begin with `_` or `.` are no archives.

    Payload digests of responses are verified: a damaged archive raises. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("content")
    return X.arrow(files, _parse, RECORD_DDL)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row for each capture: id, uri, digest, and its request, response (or revisit) and metadata records.

    Requests and metadata find their response by WARC-Concurrent-To (any of its values); missing ones are null, of several
    the least by record id counts. A revisit's payload_bytes and
    digest are those of the payload it refers to, found by digest; refers_to is the metadata of the response with the
    least page-id of that digest. Null digests refer to nothing.
    """
    is_main = F.col("type").isin("response", "revisit")
    root = F.explode(F.when(is_main, F.array("record_id")).otherwise(F.array_distinct(F.split("concurrent_to", "\n"))))

    def of(kind: Column, value: Column) -> Column:
        return F.min(F.when(kind, value))

    small = F.struct("record_id", "uri", F.map_entries("fields").alias("fields"))
    main = ("type", "uri", "digest", "payload_bytes", "payload")
    joined = (
        records.select("*", root.alias("root"))
        .groupBy(F.col("root").alias("record_id"))
        .agg(*[of(is_main, F.col(c)).alias(f"r_{c}") for c in main], *[of(F.col("type") == k, small).alias(k) for k in ("request", "metadata")])
        .where(F.col("r_type").isNotNull())
    )
    page = F.filter("metadata.fields", lambda x: x["key"] == "page-id")
    joined = joined.select(
        "record_id", F.get(page, F.lit(0))["value"].cast("long").alias("page_id"), "request", "metadata",
        F.struct(*[F.col(f"r_{c}").alias(c) for c in main]).alias("response"),
    )
    full = (
        joined.where(F.col("response.type") == "response")
        .groupBy(F.col("response.digest").alias("of"))
        .agg(F.min("page_id").alias("first_page"), F.min("response.payload_bytes").alias("full_bytes"))
    )
    revisit = F.col("response.type") == "revisit"
    out = joined.join(full, F.col("response.digest") == F.col("of"), "left")
    return out.select(
        F.col("record_id").alias("capture_id"), "page_id", F.col("response.uri").alias("uri"), F.col("response.type").alias("record_type"),
        F.col("response.digest").alias("payload_digest"), F.when(revisit, F.col("full_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("first_page")).alias("refers_to"), "request", "response", "metadata",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written and read back; nulls, repeats and ties as in `write_warc`, an empty table gives no rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = X.new_path(spark, "warc")
    write_warc(pages, path)
    return assemble_transactions(read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS least FROM p GROUP BY h),
b AS (SELECT p.*, f.least, array_to_string(list_transform(range(8), lambda i:
        array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.h, 5 * i + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest
      FROM p JOIN f ON p.h = f.h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM b
"""
