"""WARC archives of pages, and their index by external merge of sorted runs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import partitions, scratch_path, write_table
from .common import utf8_size

CRLF = "\r\n"
NO_PAGE = "<urn:no-page>"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one archive file; a file is read by one task, as a stream.
FILE_RECORDS = 10_000
#: Index entries of one range, about; a task merges one range.
RANGE_ROWS = 200_000
#: Pages without a capture time are taken to be captured one second apart, by id.
FIRST_CAPTURE, TIME_FORMAT = "2024-01-01 00:00:00", "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Their times start anew after so many seconds, so that ids may be large hashes.
SPAN = 1 << 31
#: Characters that a header keeps in a URL, and in an id (which may hold any).
_IN_URL, _IN_ID = r"\x21-\x7E", r"\x21-\x24\x26-\x3B\x3D\x3F-\x7E"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's bytes in upper-case base32: five bytes at a time
    are a number in base 32 of eight digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _BASE32HEX, _BASE32)


def url_key(url: Column) -> Column:
    """The sort-friendly form of a URL: host labels reversed, then ')' and
    path with query; scheme, user, port and fragment do not count."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(F.when(authority == "", url).otherwise(key), F.lit(""))


def capture_time(page_id: Column, kind: T.DataType) -> Column:
    """A made-up time of capture: FIRST_CAPTURE plus the id, modulo SPAN, in
    seconds; of ids that are no whole numbers, a hash takes the id's place."""
    number = page_id.cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(page_id)
    seconds = F.pmod(F.coalesce(number, F.lit(0)), F.lit(SPAN))
    return F.date_format(F.timestamp_add("SECOND", seconds, F.lit(FIRST_CAPTURE).cast("timestamp_ntz")), TIME_FORMAT)


def escaped(col: Column, keep: str) -> Column:
    """A string with every character outside the class `keep` percent-encoded
    by its UTF-8 bytes."""
    char = lambda c: F.when(c.rlike(f"^[{keep}]$"), c).otherwise(F.regexp_replace(F.hex(c), "(..)", "%$1"))
    return F.when(col.rlike(f"[^{keep}]"), F.array_join(F.transform(F.split(col, ""), char), "")).otherwise(col)


def capture_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    time_col: str | None = None, min_revisit_bytes: int = 0,
) -> DataFrame:
    """One row per page: id, url, urlkey, captured, payload, payload_bytes,
    payload_digest, refers_to (null for a response).

    Of equal payloads (by digest and size; of min_revisit_bytes at least) the
    least id responds and the others revisit it. Digests are counted with
    map-side combine and only the repeated ones are joined back, so a payload
    that a third of all pages share is one row on the small side.

    `captured` is time_col (a timestamp, or text as it is), and where that is
    null or not named, capture_time of the id."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    captured = capture_time(F.col(id_col), pages.schema[id_col].dataType)
    if time_col:
        given = F.col(time_col)
        given = given if isinstance(pages.schema[time_col].dataType, T.StringType) else F.date_format(given, TIME_FORMAT)
        captured = F.coalesce(given, captured)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_key(F.col(url_col)).alias("urlkey"), captured.alias("captured"),
        payload.alias("payload"), utf8_size(payload).alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"),
    )
    large = rows.where(F.col("payload_bytes") >= min_revisit_bytes)
    firsts = large.groupBy("payload_digest", "payload_bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # A table of its own: small ones are broadcast, else a hot digest is split.
    firsts = write_table(firsts.where("n > 1").drop("n"), "firsts")
    joined = rows.join(firsts, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("id") != F.col("first"), F.col("first"))
    return joined.select("id", "url", "urlkey", "captured", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), escaped(page_id.cast("string"), _IN_ID), F.lit(">"))


def _warc_record() -> Column:
    """A record as text, up to the CRLF CRLF that ends it. All but printable
    ASCII of a URL is percent-encoded, and the URL as it was goes into a field
    of its own, in hexadecimal, when that changed it; a null URL is left out."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF * 2),
    )
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    url = F.col("url")
    odd = F.when(url.rlike(f"[^{_IN_URL}]") | (url == ""), F.hex(url.cast("binary")))
    named = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.coalesce(_urn(F.col("id")), F.lit(NO_PAGE))),
        ("WARC-Date", F.col("captured")),
        ("WARC-Target-URI", escaped(url, _IN_URL)),
        ("X-Target-URI-Hex", odd),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Refers-To", _urn(F.col("refers_to"))),
        ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block_bytes.cast("string")),
    ]
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in named])
    return F.concat(head, F.lit(CRLF * 2), http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_warc(records: DataFrame, path: str) -> None:
    """Archives of capture_records' rows, gzipped, each a run sorted by URL
    key, time and id. Spark's text writer puts the CRLF CRLF after every
    record, so any file system and the usual commit of tasks serve."""
    runs = records.sortWithinPartitions("urlkey", "captured", "id").select(_warc_record().alias("value"))
    runs.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Archive:
    """Records of one archive from its bytes, which come in pieces and are
    held no longer than a record needs them."""

    def __init__(self):
        self.held: list[bytes] = []
        self.size = self.need = self.fed = 0
        self.fields: dict | None = None

    def feed(self, piece: bytes) -> Iterator[dict]:
        self.held.append(piece)
        self.fed += len(piece)
        self.size += len(piece)
        while self.size >= self.need and self.size:
            data = b"".join(self.held)
            if self.fields is None:
                data = data.lstrip(b"\r\n")
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    self.keep(data, len(data) + 1)
                    return
                self.fields, data = self.head(data[:end]) | {"offset": self.fed - len(data)}, data[end + 4 :]
            length = int(self.fields["content-length"])
            if len(data) < length:
                self.keep(data, length)
                return
            yield self.fields | {"block": data[:length]}
            self.fields = None
            self.keep(data[length:], 0)

    def keep(self, data: bytes, need: int) -> None:
        self.held, self.size, self.need = [data], len(data), need

    @staticmethod
    def head(raw: bytes) -> dict[str, str]:
        lines = raw.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        pairs = (x.partition(":") for x in lines[1:])
        return {name.strip(" \t").lower(): value.strip(" \t") for name, _, value in pairs}

    def end(self) -> None:
        if self.fields is not None or b"".join(self.held).strip(b"\r\n"):
            raise ValueError("an archive ends within a record")


_PAGE = re.compile(r"<urn:page:(.*)>", re.S)
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def _entry(r: dict, with_payload: bool) -> tuple:
    http, _, payload = r["block"].partition(b"\r\n\r\n")
    page, told = _PAGE.fullmatch(r["warc-record-id"]), r["warc-payload-digest"].removeprefix("sha1:")
    refers = _PAGE.fullmatch(r.get("warc-refers-to", ""))
    size, body = int(_LENGTH.search(http)[1]), None
    if r["warc-type"] == "response":
        digest, body = base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload
        if digest != told or len(payload) != size:
            raise ValueError(f"the payload of {r['warc-record-id']} is damaged")
    url = r.get("warc-target-uri")
    if "x-target-uri-hex" in r:
        url = bytes.fromhex(r["x-target-uri-hex"]).decode("utf-8", "replace")
    ids = [unquote(m[1]) if m else None for m in (page, refers)]
    return (ids[0], url, r["warc-date"], r["warc-type"], ids[1], size, told, r["offset"], *([body] if with_payload else []))


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(id, url, captured, record_type, refers_to, payload_bytes,
    payload_digest, offset, file, payload) of every record of the archives in
    a folder; ids are text; offset is the record's first byte in the unpacked
    file. Of a response, size and digest are taken from the payload
    itself (and held against the header); of a revisit, whose payload is not
    there (null), from the headers. An empty folder gives no rows.

    Spark's text source unpacks and streams each file, in pieces between the
    CRLF CRLF marks; a task holds one record at a time, whatever a file has."""
    names = ["id", "url", "captured", "record_type", "refers_to", "payload_bytes", "payload_digest", "offset"] + ["payload"] * with_payload + ["file"]
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload + [pa.string()]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, file, held, size = Archive(), None, [], 0
        for b in batches:
            for name, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name != file:
                    archive.end()
                    archive, file = Archive(), name
                for r in archive.feed(piece.as_py() + b"\r\n\r\n"):
                    held.append((*_entry(r, with_payload), name))
                    size += len(r["block"]) * with_payload
                    if len(held) == 1000 or size > 1 << 26:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held, size = [], 0
        archive.end()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    schema = "id string, url string, captured string, record_type string, refers_to string, payload_bytes long, payload_digest string, offset long"
    files = spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path)
    pieces = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(load, schema + ", payload binary" * with_payload + ", file string")


def merge_runs(runs: list[Iterable]) -> Iterator:
    """Merge sorted runs with a tree of losers: each node keeps the loser of
    its match, the winner moves up, so the next item costs one match a level.
    Of each run only the head is held."""
    done = object()
    heads = [iter(r) for r in runs]
    item = [next(h, done) for h in heads]
    k = len(runs)
    if not k:
        return

    def beats(a: int, b: int) -> bool:
        if item[a] is done or item[b] is done:
            return item[b] is done and item[a] is not done
        return (item[a], a) < (item[b], b)

    losers = [-1] * k
    winners = [-1] * k + list(range(k))  # leaves k .. 2k-1; played once, from the bottom
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while item[best] is not done:
        yield item[best]
        item[best] = next(heads[best], done)
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


KEY = ["urlkey", "captured", "id", "__q_run", "__q_place"]


def _heads(run: list[pa.RecordBatch], first: int) -> Iterator[tuple]:
    """(key, row number) of a run's pieces in order; a slice at a time
    becomes Python values."""
    for piece in run:
        for at in range(0, piece.num_rows, 1000):
            columns = [piece.column(c).slice(at, 1000).to_pylist() for c in KEY]
            for key in zip(*columns, strict=True):
                yield tuple((v is not None, v) if v is not None else (False,) for v in key), first
                first += 1


def merge_range(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
    """The rows of a range, which come as pieces of sorted runs, and their
    order. The rows stay in Arrow; a loser tree merges the runs' heads."""
    runs: dict[int, list[pa.RecordBatch]] = {}
    for b in batches:
        run = np.asarray(b.column(KEY[3]))
        for at in np.split(np.argsort(run, kind="stable"), np.flatnonzero(np.diff(np.sort(run))) + 1) if len(run) else []:
            runs.setdefault(int(run[at[0]]), []).append(b.take(pa.array(at)))
    pieces, heads, first = [], [], 0
    for run in runs.values():
        place = np.concatenate([np.asarray(b.column(KEY[4])) for b in run])
        if (np.diff(place) < 0).any():  # blocks of a run may come in any order, and in one batch
            run = pa.Table.from_batches(run).take(pa.array(np.argsort(place, kind="stable"))).combine_chunks().to_batches()
        heads.append(_heads(run, first))
        pieces += run
        first += sum(p.num_rows for p in run)
    return (pa.Table.from_batches(pieces) if pieces else None), [row for _, row in merge_runs(heads)]


def merged_index(entries: DataFrame) -> DataFrame:
    """entries (urlkey, captured, id, ...) with position: their place in the
    global order of (urlkey, captured, id).

    The entries are written as sorted runs, each row with its run and its
    place there. They are dealt by ranges of the whole key with run and place,
    of about RANGE_ROWS rows each, so that one host, one URL or one repeated
    entry fills as many ranges as it needs; a range arrives as pieces of the
    runs, which a loser tree merges. The ranges' row counts (one number each)
    turn places in ranges into global ones."""
    spark = entries.sparkSession
    names = entries.columns
    runs = entries.sortWithinPartitions("urlkey", "captured", "id")
    runs = write_table(runs.withColumn("__q_run", F.spark_partition_id()).withColumn("__q_place", F.monotonically_increasing_id()), "runs")
    ranges = max(partitions(spark), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *KEY)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, order = merge_range(batches)
        for at in range(0, len(order), 10_000):
            part = rows.take(pa.array(order[at : at + 10_000])).drop_columns(KEY[3:])
            n = part.num_rows
            part = part.append_column("__q_range", pa.array([TaskContext.get().partitionId()] * n, pa.int32()))
            yield from part.append_column("__q_at", pa.array(range(at, at + n), pa.int64())).combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    merged = write_table(dealt.mapInArrow(merge, f"{fields}, __q_range int, __q_at long"), "merged")
    sizes = merged.groupBy("__q_range").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a range
    first, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__q_range"]):
        first[r["__q_range"]] = total
        total += r["n"]
    offsets = spark.createDataFrame(list(first.items()) or [(-1, 0)], "__q_range int, __q_first long")
    out = merged.join(F.broadcast(offsets), "__q_range")
    return out.select(*names, (F.col("__q_first") + F.col("__q_at")).alias("position"))


def archive_pages(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    time_col: str | None = None, min_revisit_bytes: int = 0,
) -> DataFrame:
    """Write pages to WARC archives in `path`, read them back, and return the
    merged index: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, urlkey, captured, position, and where the record lies:
    file and offset (see `read_warc`).

    Null payloads are empty ones (equal to each other); a null URL has the
    empty key; rows with a null id always respond; rows that repeat an id are
    records of their own. Other columns are left out. An empty table gives
    empty archives and an empty index."""
    write_warc(capture_records(pages, id_col, url_col, payload_col, time_col, min_revisit_bytes), path)
    kind = pages.schema[id_col].dataType
    back = read_warc(pages.sparkSession, path, with_payload=False)
    entries = back.select(
        F.col("id").cast(kind).alias("id"), url_key(F.col("url")).alias("urlkey"), "captured", "url", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "payload_bytes", "payload_digest", "file", "offset",
    )
    out = merged_index(entries)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "urlkey", "captured", "position", "file", "offset")


def archive_digest(pages: DataFrame) -> DataFrame:
    out = archive_pages(pages.select("page_id", "url", "html"), scratch_path(pages.sparkSession, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "position")


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages
), u AS (
  SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS authority,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1) AS rest
  FROM p
), k AS (
  SELECT *, CASE WHEN url IS NULL THEN '' WHEN authority = '' THEN url ELSE
           array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '.')), ',')
           || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS urlkey,
         min(page_id) OVER (PARTITION BY payload) AS first
  FROM u
)
SELECT page_id, strlen(payload) AS payload_bytes,
       translate(to_base(('0x' || substr(hexed, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hexed, 11, 10))::BIGINT, 32, 8)
                 || to_base(('0x' || substr(hexed, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hexed, 31, 10))::BIGINT, 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       urlkey, row_number() OVER (ORDER BY urlkey, ((page_id % 2147483648) + 2147483648) % 2147483648, page_id) - 1 AS position
FROM k
"""
