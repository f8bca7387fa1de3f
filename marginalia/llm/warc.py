"""WARC archives of pages: writing with revisits, and reading with boundary-chain verification.

Writing. Each page becomes one record. Of pages with equal payloads (SHA-1 and length) the one
with the largest identifier is a `response`, the others are `revisit` records that name it and
carry no payload; payloads under `min_bytes` are all responses. Files are written by Spark's text
writer, whose line separator is the blank lines that end a WARC record.

Reading, plain or compressed; offsets are those of the plain bytes. A magic string may stand inside
a payload, so a scan cannot tell records by it. Tasks scan the files, one whole file at a time (the
writer keeps them small), and emit every place where the magic stands as a candidate, with the
offset that its headers give for the next record. Pointer jumping then doubles, round by round, how
far the chain from offset 0 of each file is known to reach; only candidates on it are records, and
the chain must reach the end of the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, new_path

MAGIC = "WARC/1.0\r\n"
#: Payload bytes of one archive file, about.
FILE_BYTES = 8 << 20
MIN_BYTES = 0
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "file string, start long, next long, page_id long, type string, payload_bytes long, digest string, refers_to long, payload binary"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: five hex digits are four base-32 digits."""
    digits = F.upper(F.sha1(text))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX, _BASE32)


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, url, body, payload_bytes, payload_digest, record_type, refers_to of each page.

    A null payload is empty, a null url is left out, a null key is the smallest. Of rows that share
    the largest key of a payload, one is the response; the others revisit it.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    sized = pages.select(
        F.col(key).alias("page_id"),
        F.coalesce(F.col(key), F.lit(0)).alias("id"),
        F.col(key).isNull().alias("nameless"),
        F.col(url).alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        base32_sha1(body).alias("payload_digest"),
    )
    # Only payloads that occur twice take part in the join: one row each, after partial sums.
    slim = sized.select("page_id", "id", "nameless", "payload_digest", "payload_bytes")
    shared = (
        slim.groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes))
        .select("payload_digest", "payload_bytes", "first", F.lit(True).alias("shared"))
    )
    shared = materialize(shared, "warc-shared")
    row = ["id", "nameless", "payload_digest", "payload_bytes"]
    firsts = slim.join(shared, ["payload_digest", "payload_bytes"]).select(*row, "first", "shared").distinct()
    # Bodies are shuffled once: the join's partitions are the archive's files.
    total = pages.agg(F.sum(F.octet_length(html).cast("long"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    joined = sized.repartition(files, *row).join(firsts.repartition(files, *row), row, "left")
    twin = F.row_number().over(Window.partitionBy(*row).orderBy("payload_bytes"))
    stored = F.col("shared").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("twin") == 1))
    return joined.withColumn("twin", twin).select(
        "page_id",
        "url",
        "body",
        "payload_bytes",
        "payload_digest",
        F.when(stored, "response").otherwise("revisit").alias("record_type"),
        F.when(~stored, F.col("first")).alias("refers_to"),
    )


def _record(names: dict[str, Column], body: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in names.items()]
    return F.concat(F.lit(MAGIC), *lines, F.lit("\r\n"), body)


def write_archive(records: DataFrame, path: str) -> None:
    """Write planned records, a gzip file a partition; each file is a chain of records from offset 0."""
    revisit = F.col("record_type") == "revisit"
    stored = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    one_line = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    text = _record(
        {
            "WARC-Type": F.col("record_type"),
            "WARC-Record-ID": F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
            "WARC-Target-URI": one_line,
            "WARC-Date": F.lit("1970-01-01T00:00:00Z"),
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("payload_digest")),
            "WARC-Refers-To": F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
            "WARC-Profile": F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            "X-Payload-Bytes": F.when(revisit, F.col("payload_bytes").cast("string")),
            "Content-Type": F.lit("text/html"),
            "Content-Length": F.octet_length(stored).cast("string"),
        },
        stored,
    )
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


#: Type of the row that stands for the end of a file.
END = "end"
_FIELD = re.compile(rb"([A-Za-z0-9-]+): ?([^\r\n]*)\r\n")
_HEAD_END = b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """Header fields of a candidate and the offset of its body; None if it has none."""
    end = data.find(_HEAD_END, at)
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(data, at + len(MAGIC), end + 2)}
    length = fields.get(b"content-length", b"")
    return (fields, end + 4) if length.isdigit() and len(length) < 19 else None


def _number(value: bytes | None) -> int | None:
    found = re.search(rb"(-?\d+)>?\Z", value or b"")
    return int(found[1]) if found else None


def _candidates(with_payload: bool):
    """Rows of RECORD for each place of the magic in a file, and one of the type END at the file's end."""

    def scan(batches):
        magic = MAGIC.encode()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, rows, at = content.as_py(), [], -1
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                while (at := data.find(magic, at + 1)) >= 0:
                    head = _headers(data, at)
                    if head is None:
                        continue
                    fields, body = head
                    end = body + int(fields[b"content-length"])
                    whole = data[end : end + 4] == _HEAD_END
                    kind = fields.get(b"warc-type", b"").decode("latin-1")
                    payload = data[body:end] if kind == "response" else b""
                    digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                    size = len(payload)
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        digest = None  # a candidate inside a payload, or a damaged record
                    elif kind == "revisit":
                        size = _number(fields.get(b"x-payload-bytes"))
                    rows.append((path, at, end + 4 if whole else None, _number(fields.get(b"warc-record-id")), kind, size, digest, _number(fields.get(b"warc-refers-to")), payload if with_payload else None))
                rows.append((path, len(data), None, None, END, None, None, None, None))
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                names = [f.split()[0] for f in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return scan


def reachable(edges: DataFrame) -> DataFrame:
    """(file, start) on the chain from offset 0, of edges (file, start, next), by pointer jumping.

    Round k knows the first 2^k links: what is reached and what the 2^k-th successor of each
    reached place is, so the rounds are as many as the logarithm of the longest chain.
    """
    jump = materialize(edges.select("file", "start", "next"), "warc-jump")
    reached = jump.filter("start = 0").select("file", "start")
    known = -1
    while True:
        step = reached.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        on = step.join(edges.select("file", "start"), ["file", "start"], "left_semi")
        reached = materialize(reached.union(on).distinct(), "warc-reached")
        now = reached.count()
        if now == known:
            return reached
        known = now
        second = jump.select("file", F.col("start").alias("next"), F.col("next").alias("after"))
        jump = materialize(jump.join(second, ["file", "next"]).select("file", "start", F.col("after").alias("next")), "warc-jump")


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The verified records of all archive files under a path: page_id, type, payload_bytes, digest, refers_to.

    With payload, responses carry their bytes. A record whose payload does not match its digest
    has a null digest. A file whose chain does not reach its end is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = materialize(files.mapInArrow(_candidates(with_payload), RECORD), "warc-candidates")
    chain = reachable(found.select("file", "start", "next"))
    broken = found.filter(F.col("type") == END).join(chain, ["file", "start"], "left_anti").select("file").first()
    if broken:
        raise ValueError(f"the chain of records breaks in {broken[0]}")
    return found.filter(F.col("type") != END).join(chain, ["file", "start"], "left_semi")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages into a fresh folder of the shared store and read the records back, as many as pages."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(plan_records(pages, key, url, html, min_bytes), path)
    records, written = read_archive(spark, path), pages.count()
    if (found := records.count()) != written:
        raise ValueError(f"{written} pages were written and {found} records read")
    return records
