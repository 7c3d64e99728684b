"""Block gzip: a gzip file of many small members, each of which says how long it is, read by ranges of bytes.

A member belongs to the range of the file that it begins in, and a record to the
range that the line's end before it lies in.  A part reads on past its range until
its last record has ended.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Compressed bytes of one part; bytes read at a time; the longest member.
PART, CHUNK, LONGEST = 1 << 24, 1 << 20, 1 << 16
MEMBER = 0xFF00  # bytes of text in a member that is written here
MAGIC = b"\x1f\x8b\x08\x04"
ENDINGS = (".gz", ".bgz", ".bgzf", ".bam")
ROWS = 1024
WRITTEN = 256  # rows that are encoded at once


def member_size(head: bytes) -> int | None:
    """Bytes of the member that begins with head, or None where none of known length begins."""
    if len(head) < 12 or head[:4] != MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Spark's name of a file as pyarrow knows it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri(uri)  # a path alone
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + ("/" if scheme == "file" else "") + rest.lstrip("/"))


def block_gzip(uris: list[str]) -> set[str]:
    """Those of the files that are block gzip: by name, then by their first bytes; none on a file system that pyarrow does not know."""

    def check(uri: str) -> bool:
        try:
            files, path = filesystem(uri)
        except (pa.ArrowInvalid, NotImplementedError):
            return False
        with files.open_input_file(path) as f:
            return member_size(f.read(1 << 12)) is not None

    named = [u for u in uris if u.endswith(ENDINGS)]
    with ThreadPool(16) as pool:
        return {u for u, own in zip(named, pool.map(check, named) if named else [], strict=True) if own}


def _whole(member: bytes) -> bool:
    try:
        zlib.decompress(member, 31)
    except zlib.error:
        return False
    return True


def first_member(stream: pa.NativeFile, size: int, at: int) -> int:
    """Where the first member at or after this place begins, or the size of the file.

    Bytes inside a member may look like a header, so what follows a candidate for
    as far as two of the longest members must be members too.
    """
    if at == 0:
        return 0
    stream.seek(at)
    data = stream.read(4 * LONGEST)
    i = data.find(MAGIC)
    while i >= 0:
        j = i
        while j < min(i + 2 * LONGEST, len(data)):
            n = member_size(data[j : j + 1024])
            if n is None:
                break
            j += n
        if (j >= i + 2 * LONGEST or at + j == size) and _whole(data[i : i + (member_size(data[i : i + 1024]) or 0)]):
            return at + i
        i = data.find(MAGIC, i + 1)
    if at + len(data) < size:
        raise ValueError(f"no member begins in {len(data)} bytes from {at} on")
    return size


def members(stream: pa.NativeFile, size: int, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members from start, where one begins, to the end of the file."""
    stream.seek(start)
    data, at = b"", start
    while at < size:
        n = member_size(data)
        if n is None or n > len(data):
            more = stream.read(CHUNK)
            data += more
            n = member_size(data)
            if n is None or n > len(data):
                raise ValueError(f"no whole member at {at}")
        while n is not None and n <= len(data):
            text = zlib.decompressobj(31)
            out = text.decompress(data[:n])
            if not text.eof or text.unused_data:
                raise ValueError(f"a member at {at} is not {n} bytes long")
            yield at, out
            data, at = data[n:], at + n
            n = member_size(data[:1024])


def pieces(texts: Iterable[tuple[bool, bytes]], separator: bytes, opens: bool) -> Iterator[bytes]:
    """What separators cut out of the texts (whether a part owns it, text), from the first that it owns to the end of the last.

    opens: the texts begin a file, so that what comes before the first separator
    is a piece too.  The separator has two bytes; its first decides whose it is.
    """
    held: list[bytes] | None = [] if opens else None
    carry, ours = b"", True
    for own, data in texts:
        if held is None and not own and not (carry and ours):
            return
        text, at = carry + data, 0
        while (i := text.find(separator, at)) >= 0:
            if held is not None:
                held.append(text[at:i])
                yield b"".join(held)
            if not (own or (i < len(carry) and ours)):
                return
            held, at = [], i + len(separator)
        keep = int(len(text) > at and text[-1:] == separator[:1])
        if held is not None:
            held.append(text[at : len(text) - keep])
        carry, ours = text[len(text) - keep :], own if data else ours
    if held is not None:
        last = b"".join([*held, carry])
        if last:
            yield last


@dataclass
class Stretch(InputPartition):
    uri: str
    size: int
    start: int
    end: int


class BgzfSource(DataSource):
    """The format "bgzf": (file, part, at, value) of block gzip files, cut at a separator of two bytes."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "file string, part long, at long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BgzfReader(self.options["files"].split("\n"), self.options["separator"].encode(), int(self.options.get("range", PART)))


class BgzfReader(DataSourceReader):
    def __init__(self, uris: list[str], separator: bytes, size: int):
        self.uris, self.separator, self.size = uris, separator, size

    def partitions(self) -> list[Stretch]:
        out = []
        for uri in self.uris:
            files, path = filesystem(uri)
            size = files.get_file_info(path).size
            out += [Stretch(uri, size, a, min(a + self.size, size)) for a in range(0, size, self.size)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        files, path = filesystem(p.uri)
        with files.open_input_file(path) as stream:
            start = first_member(stream, p.size, p.start)
            if start >= p.end:
                return
            found = pieces(((at < p.end, text) for at, text in members(stream, p.size, start)), self.separator, p.start == 0)
            rows: list[str] = []
            n, held = 0, 0
            for piece in found:
                rows.append(piece.decode(errors="replace"))
                held += len(piece)
                if len(rows) == ROWS or held >= CHUNK:
                    yield self._batch(p, n, rows)
                    n, held, rows = n + len(rows), 0, []
            if rows:
                yield self._batch(p, n, rows)

    def _batch(self, p: Stretch, n: int, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p.uri] * len(rows)), pa.array([p.start] * len(rows)), pa.array(range(n, n + len(rows)), pa.int64()), pa.array(rows)], ["file", "part", "at", "value"])


def read_pieces(spark: SparkSession, uris: list[str], separator: str, size: int | None = None) -> DataFrame:
    """(file, part, at, value): the text of block gzip files between separators; part: where the range begins, at: the piece's number in it."""
    spark.dataSource.register(BgzfSource)
    return spark.read.format("bgzf").options(files="\n".join(uris), separator=separator, range=size or PART).load()


def compress(data: bytes, member: int = MEMBER) -> bytes:
    """Block gzip of data, with the empty member that ends a file."""
    out = []
    for a in [*range(0, len(data), member), len(data)]:
        text = data[a : a + member]
        raw = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = raw.compress(text) + raw.flush()
        if len(body) + 26 > LONGEST:  # text that does not shrink is stored
            raw = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = raw.compress(text) + raw.flush()
        out.append(MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text)))
    return b"".join(out)


def write_blocks(rows: DataFrame, path: str, encode: Callable[[pa.RecordBatch], bytes], head: bytes = b"", ending: str = ".gz") -> None:
    """A block gzip file of a folder for each partition: head, and what encode makes of its rows.

    Names are of the partition alone, so that a task run again writes the same file.
    """
    files, root = filesystem(path)
    files.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, where = TaskContext.get(), filesystem(path)[0]
        name = f"{root}/part-{context.partitionId():06d}{ending}"
        own = f"{root}/_{context.partitionId()}-{context.taskAttemptId()}"
        with where.open_output_stream(own, compression=None) as out:
            held = head
            for b in batches:
                for first in range(0, b.num_rows, WRITTEN):
                    held += encode(b.slice(first, WRITTEN))
                    whole = len(held) - len(held) % MEMBER
                    out.write(compress(held[:whole])[: -len(compress(b""))] if whole else b"")
                    held = held[whole:]
            out.write(compress(held))
        where.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    rows.mapInArrow(run, "name string").write.format("noop").mode("append").save()


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """lines(value) as block gzip files, in the given order over the files by name; null is no line."""
    write_blocks((lines.orderBy(*order) if order else lines).select("value"), path, lambda b: b"".join(v.encode() + b"\n" for v in b.column(0).to_pylist() if v is not None))
