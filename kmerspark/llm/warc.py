r"""Legacy archives to WARC.

An ARC file opens with a ``filedesc:`` record whose block names the version and
the fields of the header lines that follow; each record is such a line, as many
bytes as the line declares, and a newline.  The converter reads versions 1 and 2
by their own field lists and synthesises what WARC wants: record identifiers,
ISO timestamps, types and payload digests.  Blocks are bytes of any encoding; one
that does not start like an HTTP response becomes a resource record.  Payloads
of 1000 bytes or more that occur again become revisits of the one with the
largest page_id.

A record's identity is its archive's name and its offset there, from which its
identifier is made; so records that repeat a page_id, or have none, have
identifiers of their own.  Records are written once, as Parquet, and typed from
there.  WARC files are written by Spark's text writer, gzipped, in the cluster's
shared folder: the strings are bytes as they are, and the four bytes that end a
WARC record are the writer's line separator.  A file has at most FILE_BYTES of
records before compression, or one record.  They are read back as binary files
and parsed by declared length.

Defined results: null html is an empty payload; a null url is written as "-";
spaces and control characters in a url are percent-encoded; rows that repeat a
page_id are records of their own, and all with the largest page_id of equal
payloads are responses, of which the others revisit one; equal payloads without
any page_id are all responses; a null page_id is read back as null; an empty
table gives an empty table; columns besides page_id, url and html are not looked
at.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kmerspark.rows import meet
from kmerspark.scratch import materialize, scratch_path

#: The field lists of ARC header lines, by version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Bytes of records after which a new ARC archive is begun, and of a WARC file; the bytes of a record that counts as small, and the least payload that is revisited.
ARCHIVE_BYTES = 1 << 21
FILE_BYTES = 1 << 30
SMALL = 1 << 16
LEAST_REVISITED = 1000
#: Rows that a task turns into Python objects at once, and the date of archives whose pages have none.
SLICE = 256
DATE = "19970101000000"
END = "\r\n\r\n"


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_record(version: int, url: str, date: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(known[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def arc_opening(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 none\n{' '.join(FIELDS[version])}\n".encode()
    known = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(known[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an ARC archive after the opening one; the last may lack its newline."""
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # some writers put more than one
            at += 1
            continue
        eol = data.find(b"\n", at)
        line = data[at:eol].decode("latin-1").rstrip("\r").split(" ")
        if eol < 0 or not line[-1].isdigit():
            raise ValueError(f"record at {at}: no header line that ends in a length")
        start, end = eol + 1, eol + 1 + int(line[-1])  # the length is the last field in either version
        if end > len(data) or data[end : end + 1] not in (b"", b"\n"):
            raise ValueError(f"record at {at}: the declared length does not end at a record's end")
        block = data[start:end]
        if fields is None:
            version, names = block.split(b"\n")[:2]
            fields = names.decode("latin-1").strip().split(" ")
            if not line[0].startswith("filedesc:") or fields != FIELDS.get(int(version.split(b" ")[0])):
                raise ValueError("not an ARC archive of version 1 or 2")
        elif len(line) != len(fields):
            raise ValueError(f"record at {at}: {len(line)} fields for {len(fields)}")
        else:
            yield at, dict(zip(fields, line, strict=True)), block
        at = end + 1


def unzipped(data: bytes) -> bytes:
    """An archive without its gzip, which may have a member for each record or one for all; one that is not gzipped as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return gzip.GzipFile(fileobj=io.BytesIO(data)).read()  # reads on as members come, so that many of them cost no more than one
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"a broken gzip member: {e}") from e


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _build(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[tuple[str, bytes]]:
    """(name, archive): names tell the archives of all tasks apart."""
    parts: list[bytes] = []
    made = size = version = 0
    task = TaskContext.get().partitionId()
    for b in _slices(batches):
        for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not parts:
                version, name = 1 + made % 2, f"part-{task}-{made}.arc"
                parts, made = [arc_opening(version, name, date)], made + 1
                size = len(parts[0])
            body = html.encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(body)}\r\n\r\n"
            parts.append(arc_record(version, safe_url(url), date, head.encode() + body, size, name))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield name, b"".join(parts)
                parts = []
    if parts:
        yield name, b"".join(parts)


def _records(archives: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "offset", "page_id", "url", "date", "ip", "kind", "head", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    for archive, data in archives:
        rows = []
        for offset, field, block in parse_arc(data):
            http = block.startswith(b"HTTP/")
            head, end, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            page_id = re.search(rb"\r\nX-Page-Id: (-?\d+)(?:\r|$)", head)
            rows.append((archive, offset, int(page_id[1]) if page_id else None, field["URL"], field["Archive-date"], field["IP-address"], "application/http; msgtype=response" if http else field["Content-type"], head + end, payload))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))


RECORD = "archive string, offset long, page_id long, url string, date string, ip string, kind string, head binary, payload binary"


def to_archives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(name, archive): ARC archives of pages(page_id, url, html), versions 1 and 2 in turn."""
    return _pages(pages).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([n]), pa.array([a], pa.binary())], ["name", "archive"]) for n, a in _build(it, date)), "name string, archive binary")


def from_archives(archives: DataFrame) -> DataFrame:
    """The records of the ARC archives in archives(name, archive), whoever wrote them, and page_id where an X-Page-Id header gives one.

    Names tell archives apart: for files, spark.read.format("binaryFile") has them in path.
    Archives may be gzipped, by record or whole; offsets are those without gzip.
    """
    return archives.select("name", "archive").mapInArrow(lambda it: _records((n.as_py(), unzipped(a.as_py())) for b in it for n, a in zip(*b.columns, strict=True)), RECORD)


def through_archives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """from_archives(to_archives(pages)), with each archive handed over inside the task that made it."""
    return _pages(pages).mapInArrow(lambda it: _records(_build(it, date)), RECORD)


def with_digests(records: DataFrame) -> DataFrame:
    """records with the bytes of their payloads, and their digests."""
    return records.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))


def with_types(records: DataFrame) -> DataFrame:
    """Written records(archive, offset, page_id, bytes, digest, ...) with keeper: the record that this one revisits, or null for one that stands by itself.

    Only places and digests meet the keepers; the payloads wait for one join on
    the record's own place, which no other record has.
    """
    own = records.select("archive", "offset", "page_id", "bytes", "digest").where(F.col("bytes") >= LEAST_REVISITED)
    place = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "archive", "offset")
    again = own.groupBy("digest", "bytes").agg(F.max(place).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = meet(own, materialize(again, "keepers"), ["digest", "bytes"], "n")
    revisits = met.where(~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))).select("archive", "offset", "keeper")
    return records.join(revisits, ["archive", "offset"], "left")


def _record_id(archive: Column, offset: Column) -> Column:
    h = F.md5(F.concat_ws("@", archive, offset.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def warc_text(typed: DataFrame) -> DataFrame:
    """(value): each record as WARC text, without the bytes that end it; blocks are bytes as they are."""
    revisit = F.col("keeper").isNotNull()
    block = F.concat(F.col("head").cast("string"), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    iso = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3T$4:$5:$6Z")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    where = lambda name, value: F.when(value.isNotNull(), line(name, value.cast("string"))).otherwise(F.lit(""))
    kind = F.when(revisit, F.lit("revisit")).when(F.length("head") > 0, F.lit("response")).otherwise(F.lit("resource"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _record_id(F.col("archive"), F.col("offset"))),
        line("WARC-Date", iso),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        where("Page-Id", F.col("page_id")),
        line("Payload-Bytes", F.col("bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("keeper.archive"), F.col("keeper.offset"))), where("Refers-To-Page-Id", F.col("keeper.page_id"))
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.col("kind")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return typed.select(F.concat(header, block).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """WARC files of an archive's records, in folders below path: the small ones, and the others, if there are any."""
    size = F.octet_length("head") + F.octet_length("payload") + 4096  # with room for the header
    kept = materialize(with_digests(records).withColumn("_size", size), "records", "zstd")
    most = kept.agg(F.max("_size")).first()[0] or 0
    for name, part, largest in (("small", F.col("_size") <= SMALL, SMALL), ("large", F.col("_size") > SMALL, most)):
        if name == "small" or most > SMALL:
            out = warc_text(with_types(kept).where(part)).write.option("lineSep", END).option("compression", "gzip")
            out.option("maxRecordsPerFile", max(1, FILE_BYTES // largest)).text(f"{path}/{name}")


def write_warc(pages: DataFrame, path: str) -> None:
    """WARC files of pages(page_id, url, html), by way of ARC archives."""
    write_records(through_archives(pages), path)


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, from the file's bytes in pieces of any length."""
    held = bytearray()
    pieces = iter(pieces)

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not fill(len(held) + 1):
                if held:
                    raise ValueError("a record's header is cut short")
                return
            at = held.find(b"\r\n\r\n")
        first, *lines = bytes(held[:at]).decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record: {first[:40]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        end = at + 4 + int(fields["content-length"])
        if not fill(end + 4) or held[end : end + 4] != END.encode():
            raise ValueError("the declared length does not end at a record's end")
        yield fields, bytes(held[at + 4 : end])
        del held[: end + 4]


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data, step)
        while z.unconsumed_tail:
            yield z.decompress(z.unconsumed_tail, step)
        yield z.flush()
        data = z.unused_data


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url) of every record below path."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parse_warc(_inflated(content.as_py())):
                    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    size, digest = int(f["payload-bytes"]), f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] != "revisit" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{f['warc-record-id']}: the payload is not what its header says")
                    number = [int(f[k]) if k in f else None for k in ("page-id", "refers-to-page-id")]
                    rows.append((number[0], size, digest, f["warc-type"], number[1], f["warc-record-id"], f["warc-target-uri"].encode("utf-8", "replace").decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")


def convert(pages: DataFrame) -> DataFrame:
    """Write pages as WARC and return what is read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path).drop("record_id", "url")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
