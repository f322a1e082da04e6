"""WARC archives with revisit resolution.

Payloads are digested where they lie; only headers (digest, length, page id, a
row id) are shuffled. Per digest the response is the record with the largest
page id, found by a pre-aggregated maximum, and the headers of the others are
joined to it and become revisit records. Archives hold one full payload per
digest and are read back record by record, by Content-Length: an archive goes
through a task as a stream of pieces, so no more than some records of it are in
memory at a time, however large the archive and however long its payloads.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import col, prepare, stored
from usagelens.session import scratch_path

# Payloads below this many bytes are stored again rather than referred to.
MIN_REVISIT_BYTES = 0
RECORDS_PER_FILE = 4_000
# The base32 alphabet.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: eight groups of five
    hex digits, each of which makes four base32 digits."""
    digest = F.sha1(payload)
    group = lambda i: F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda v, s: F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(group(i), s) for i in range(8) for s in (15, 10, 5, 0)])


def resolve(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Headers with their decision. ``pages`` has row, page_id, url, payload_bytes,
    payload_digest; adds record_type, refers_to, refers_url, refers_row. Rows without a
    page id count as the smallest; of equal page ids the smallest (url, row) responds."""
    heads = pages.select("row", "page_id", "url", "payload_bytes", "payload_digest")
    linked = F.col("payload_bytes") >= min_bytes
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), (-F.xxhash64("url")).alias("u"), (-F.col("row")).alias("r"))
    # one row per digest leaves each map task; a group of copies is reduced before the shuffle
    best = (heads.where(linked).groupBy("payload_digest", "payload_bytes")
            .agg(F.max(order).alias("best"), F.max_by("url", order).alias("to_url"), F.max_by("page_id", order).alias("to_page"))
            .select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"), (-F.col("best.r")).alias("to_row"), "to_url", "to_page"))
    both = heads.join(best, (heads.payload_digest == best.d) & (heads.payload_bytes == best.n), "left")
    revisit = F.coalesce(F.col("to_row") != F.col("row"), F.lit(False)) & linked
    return both.select("row", "page_id", "url", "payload_bytes", "payload_digest",
                       F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("to_page")).alias("refers_to"), F.when(revisit, F.col("to_url")).alias("refers_url"),
                       F.when(revisit, F.col("to_row")).alias("refers_row"))


def _header(name: str, value: Column) -> Column:
    clean = F.regexp_replace(value.cast("string"), "[\r\n]+", " ")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")))


def _record_id(row: Column) -> Column:
    """The name of the record of row ``row``: a revisit can name its response
    by the response's row, as equal payloads have equal digests. Null for null."""
    name = F.sha2(F.concat(row.cast("string"), F.lit(":"), F.col("payload_digest")).cast("binary"), 256)
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(row.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))


def _record(payload: Column, date: Column) -> Column:
    """The text of one record, without the two line ends behind it."""
    body = F.when(F.col("record_type") == "response", payload).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _record_id(F.col("row"))),
        _header("WARC-Date", date), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Refers-To", _record_id(F.col("refers_row"))),
        _header("WARC-Refers-To-Date", F.when(F.col("refers_row").isNotNull(), date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To-Target-URI", F.col("refers_url")),
        _header("X-Refers-To-Page", F.col("refers_to")), _header("X-Page-Id", F.col("page_id")),
        _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(body)), F.lit("\r\n"), body)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES, as_of: dt.datetime | None = None) -> None:
    """Writes a record per row of ``pages`` to gzip-compressed archives under
    ``path`` (any folder Spark can write), dated ``as_of`` (UTC; now if not
    given). Null html is an empty payload, a null id or url leaves out its
    header, repeated rows get a record each, and very long payloads stay whole."""
    date = F.lit((as_of or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ"))
    html = F.coalesce(col(pages, html_col).cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), col(pages, id_col).alias("page_id"),
                        col(pages, url_col).alias("url"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
                        base32_sha1(html.cast("binary")).alias("payload_digest"))
    # headers are stored once: their row ids must not change when a task is run again
    heads = resolve(stored(rows, "warc-heads"), min_bytes)
    revisits = heads.where("record_type = 'revisit'").select(_record(F.lit(""), date).alias("value"))
    # equal digests have equal payloads, so one payload per digest is all that moves
    payloads = pages.select(base32_sha1(html.cast("binary")).alias("digest"), html.alias("html")).groupBy("digest").agg(F.first("html").alias("html"))
    full = heads.where("record_type = 'response'")
    responses = full.join(payloads, F.col("payload_digest") == F.col("digest")).select(_record(F.col("html"), date).alias("value"))
    (responses.union(revisits).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        key, sep, value = line.partition(b": ")
        if sep and key == name:
            return value.decode("utf-8")
    return None


class _Archive:
    """The records of one archive, fed with its bytes piece by piece."""

    def __init__(self):
        self.head, self.block, self.missing = None, [], 0

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Takes the bytes up to the next two line ends (they are not part of
        ``piece``); gives the (header, block) they complete, if any."""
        if self.head is None:
            piece = piece.lstrip(b"\r\n")
            if not piece:
                return
            self.head, self.block = piece, []
            self.missing = int(_field(piece, b"Content-Length"))
            if self.missing:
                return
        else:
            part = (piece + END.encode())[:self.missing]
            self.block.append(part)
            self.missing -= len(part)
        if not self.missing:
            yield self.head, b"".join(self.block)
            self.head = None

    def close(self) -> None:
        if self.head is not None:
            raise ValueError("archive ends inside a record")


def _fields(head: bytes, block: bytes) -> tuple:
    number = lambda x: None if x is None else int(x)
    kind = _field(head, b"WARC-Type")
    digest = _field(head, b"WARC-Payload-Digest").removeprefix("sha1:")
    size = int(_field(head, b"X-Payload-Length"))
    if kind == "response":
        size, found = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
        if found != digest:
            raise ValueError(f"payload digest {found} differs from the header's {digest}")
    return (number(_field(head, b"X-Page-Id")), _field(head, b"WARC-Target-URI"), kind, size, digest,
            number(_field(head, b"X-Refers-To-Page")))


def read_archives(spark, path: str) -> DataFrame:
    """Every record below ``path``: page_id, url, record_type, payload_bytes and
    payload_digest (of the block for responses, as declared for revisits),
    refers_to. The digest of every response is computed anew and compared; a
    record that is cut short fails the read. A file is one task's stream, so
    its pieces arrive in order."""
    prepare(spark)
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    kinds = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, archive = None, _Archive()
        for batch in batches:
            rows = []
            for name, piece in zip(batch["file"], batch["value"]):
                if name != file:
                    archive.close()
                    file, archive = name, _Archive()
                rows.extend(_fields(*record) for record in archive.feed(piece.encode("utf-8")))
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        archive.close()

    pieces = spark.read.option("lineSep", END).option("pathGlobFilter", "part-*").text(path)
    return pieces.select(F.col("_metadata.file_name").alias("file"), "value").mapInPandas(parse, kinds)


def roundtrip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, **columns) -> DataFrame:
    """``pages`` written to archives in the shared scratch folder and read back.
    An empty table gives an empty result."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes=min_bytes, **columns)
    return read_archives(pages.sparkSession, path)
