"""WARC archives: a writer and a PySpark data source ``warc``.

Reading plans partitions by files, packed up to a size. ``record types`` and equality or ``in``
predicates on header columns are pushed into the reader, which parses a record's header block
first and, where the record is unwanted or no payload is asked for, seeks past its body without
reading or decoding it. Records and their bodies are read one at a time.

Writing keeps Spark's own file commit, so a lost executor leaves no half archive: records become
lines of the text writer with the record separator as line end. Of records with equal payloads of
at least ``least_bytes`` bytes the one with the largest key is a ``response`` and the others are
``revisit`` records, which have no body and name the response. Only digests are grouped; the page
bodies take part in no shuffle unless there are more revisits than a broadcast may hold.

Options of the source: ``path`` (a folder or file), ``payload`` (``binary``, ``text`` or ``none``),
``types`` (comma-separated record types), ``bytes`` (size of a partition). The session needs
``spark.sql.python.filterPushdown.enabled``, which :func:`read_archives` sets.

Defined results: a null payload is empty; a payload of any length is one record, written and read
whole; a null url is empty; columns other than the four named are not written, whatever their
names; repeated rows with the largest key are all responses;
an empty table gives an archive without records and an empty result; payload bytes and digest of
a revisit are those of the full payload, kept in its header.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .common import col, shared_path, stored, table

END = "\r\n\r\n"
SCHEMA = ("record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
          "refers_to string, page_id string, payload_bytes long, file string, offset long, payload {}")
#: Header names by column.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
           "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
           "page_id": "x-page-id"}
PARTITION_BYTES = 32 << 20
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(u.path) if u.scheme else path
    return fs.FileSystem.from_uri(path)


class WarcSource(DataSource):
    """``spark.read.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA.format("binary" if self.options.get("payload", "binary") == "binary" else "string")

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.mode = options["path"], options.get("payload", "binary")
        self.size = int(options.get("bytes", PARTITION_BYTES))
        self.wanted: dict[str, set] = {}
        if options.get("types"):
            self.wanted["record_type"] = set(options["types"].split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and ``in`` on header columns; everything else goes back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = open_fs(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))
        out, pack, size = [], [], 0
        for name, n in files:
            if pack and size + n > self.size:
                out.append(Files(tuple(pack)))
                pack, size = [], 0
            pack.append(name)
            size += n
        return [*out, *([Files(tuple(pack))] if pack else [])] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = open_fs(self.path)
        for name in partition.paths:
            with system.open_input_file(name) as f:
                yield from self.records(f, name)

    def records(self, f, name: str) -> Iterator[tuple]:
        buffered, place, end = bytearray(), 0, f.size()
        while place < end:
            start = place
            while (stop := buffered.find(b"\r\n\r\n")) < 0:  # header block first
                more = f.read(1 << 16)
                if not more:
                    raise ValueError(f"{name}: header at byte {start} does not end")
                buffered += more
            head = parse_header(bytes(buffered[:stop]), name, start)
            length = int(head["content-length"])
            whole = stop + 4 + length + 4
            want = all(head.get(HEADERS[c]) in values for c, values in self.wanted.items())
            body = None
            if want and self.mode != "none":
                while len(buffered) < stop + 4 + length:
                    more = f.read(max(1 << 16, stop + 4 + length - len(buffered)))
                    if not more:
                        raise ValueError(f"{name}: body at byte {start} does not end")
                    buffered += more
                body = bytes(buffered[stop + 4:stop + 4 + length])
            place = start + whole
            if whole <= len(buffered):
                del buffered[:whole]
            else:  # the rest is skipped unread
                f.seek(place)
                buffered.clear()
            if want:
                digest = head.get("warc-payload-digest")
                if body is not None and head["warc-type"] == "response":
                    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
                yield (*[digest if c == "payload_digest" else head.get(h) for c, h in HEADERS.items()],
                       int(head.get("x-payload-length", length)), name, start,
                       body.decode("utf-8", "replace") if body is not None and self.mode == "text" else body)


def parse_header(block: bytes, name: str, start: int) -> dict[str, str]:
    lines = block.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"{name}: no record at byte {start}")
    pairs = (line.partition(b":") for line in lines[1:])
    return {k.strip().lower().decode(): v.strip().decode("utf-8") for k, _, v in pairs}


def sha1_base32(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from ten hex digits (eight base32 digits) at a time."""
    digest = F.sha1(value)
    part = lambda k: F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(4)]), _DIGITS, _BASE32)


def revisits(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """(key, digest, refers_to) of the pages whose payload another page with a larger key has."""
    body = F.coalesce(col(payload), F.lit("")).cast("binary")
    d = pages.select(col(key).alias("key"), F.sha1(body).alias("digest"), F.length(body).alias("n")).where(F.col("n") >= least_bytes)
    first = d.groupBy("digest").agg(F.max("key").alias("refers_to"), F.min("key").alias("lo"))
    first = first.where(F.col("refers_to") != F.col("lo")).drop("lo")
    return d.join(first, "digest").where(F.col("key") != F.col("refers_to")).select("key", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """One record for each page, in WARC files below ``path``; the number of files is that of the partitions."""
    known = stored(revisits(pages, key, payload, least_bytes), "revisits")
    p = pages.select(col(key).alias("key"), F.coalesce(col(url), F.lit("")).alias("url"), F.coalesce(col(payload), F.lit("")).alias("body"))
    p = p.withColumn("digest", F.sha1(F.col("body").cast("binary"))).join(known, ["key", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    record = lambda k: F.concat(F.lit("<urn:x-page:"), k.cast("string"), F.lit(">"))
    clean = F.regexp_replace("url", "[\\r\\n]+", " ")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), record(F.coalesce(F.col("key").cast("string"), F.lit("null")))),
        F.concat(F.lit("WARC-Target-URI: "), clean), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1_base32(F.col("body").cast("binary"))), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("body")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record(F.col("refers_to")))),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.octet_length("body")))]
    text = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.when(again, F.lit("")).otherwise(F.col("body")))
    p.select(text.alias("value")).write.option("lineSep", END).text(path)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of the archives below ``path``; switches on the pushdown of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).option("path", path).load()


def op3_warc_source(spark, sf_dir):
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    r = read_archives(spark, path, types="response,revisit")
    return r.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes",
                    F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type",
                    F.regexp_extract("refers_to", "^<urn:x-page:(.*)>$", 1).cast("long").alias("refers_to"))


QUERIES = {"op3_warc_source": op3_warc_source}
SQL = {"op3_warc_source": """WITH d AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, body, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, 10 * k + 1, 10) AS BIGINT)) AS v,
      max(page_id) OVER (PARTITION BY body) AS top FROM d)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((v[j // 8 + 1] >> (35 - 5 * (j % 8))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM b"""}
