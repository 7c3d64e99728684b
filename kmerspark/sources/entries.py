"""Records that cannot be found by a separator, read by ranges of bytes.

A length or a count of characters says where such a record ends, so a range can be
read once it is known where its first record begins.  First, every range is tried
from each place that could be a record's beginning: places are taken from the last
to the first, so a place's exit, where the first record past the range begins, is
that of the record after it, and each is parsed once.  Nearly always all places
that parse share one exit; those that have another are kept by name.  Then one row
a range meets in a fold over each file: a range's entry is the exit that belongs to
its predecessor's entry.  Last, ranges are read from their entries.

A place is an offset in a plain file; in block gzip, the member's offset and, in
its lower 16 bits, an offset in its text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kmerspark.scratch import materialize
from kmerspark.sources import bgzf

#: Bytes of a range of a plain file, and of one of a block gzip file.
PLAIN, PACKED = 1 << 26, bgzf.PART
NOWHERE = -1
TASKS = 10_000  # of one job, at most


class Window:
    """The text of a range, and as much of what follows as is asked for; own: how much of it is the range's."""

    def __init__(self, stream: pa.NativeFile, size: int, start: int, end: int, packed: bool):
        self.text, self.packed = bytearray(), packed
        self._starts, self._members = [], []
        self._more = self._blocks(stream, size, start) if packed else self._plain(stream, start)
        self._next = next(self._more, None)
        while self._next is not None and self._next[0] < end:
            at, data = self._next
            if not packed and at + len(data) > end:  # a plain file's chunk does not end with the range
                self._take(at, data[: end - at])
                self._next = end, data[end - at :]
                break
            self.grow()
        self.own = len(self.text)

    def _plain(self, stream: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
        stream.seek(start)
        while data := stream.read(bgzf.CHUNK):
            yield start, data
            start += len(data)

    def _blocks(self, stream: pa.NativeFile, size: int, start: int) -> Iterator[tuple[int, bytes]]:
        return (m for m in bgzf.members(stream, size, bgzf.first_member(stream, size, start)) if m[1])

    def _take(self, at: int, data: bytes) -> None:
        self._starts.append(len(self.text))
        self._members.append(at)
        self.text += data

    def grow(self) -> bool:
        """More text, unless there is none."""
        if self._next is None:
            return False
        self._take(*self._next)
        self._next = next(self._more, None)
        return True

    def holds(self, n: int) -> bool:
        """Whether there are n bytes from the range's start."""
        while len(self.text) < n:
            if not self.grow():
                return False
        return True

    def line(self, i: int) -> tuple[bytes, int] | None:
        """The line at i without its end, and where the next begins."""
        if not self.holds(i + 1):
            return None
        j, seen = self.text.find(b"\n", i), len(self.text)
        while j < 0 and self.grow():
            j, seen = self.text.find(b"\n", seen), len(self.text)
        end = len(self.text) if j < 0 else j
        return bytes(self.text[i:end]).removesuffix(b"\r"), end + (j >= 0)

    def place(self, i: int) -> int:
        if not self.holds(i + 1):
            return NOWHERE
        m = bisect_right(self._starts, i) - 1
        return self._members[m] << 16 | i - self._starts[m] if self.packed else self._members[m] + i - self._starts[m]

    def index(self, place: int) -> int:
        at = place >> 16 if self.packed else place
        m = bisect_right(self._members, at) - 1
        return self._starts[m] + (place & 0xFFFF if self.packed else place - self._members[m])


@dataclass
class Format:
    """A kind of record: where the first of a file begins, where one could begin in a range, and one that begins at a place.

    ``parse`` gives the end of the record and its values, or None where none is.
    """

    first: Callable[[Window], int]
    candidates: Callable[[Window], Sequence[int]]
    parse: Callable[[Window, int], tuple[int, tuple] | None]
    types: list[pa.DataType]
    names: list[str]
    schema: str


TRIED = "file string, part long, end long, first long, exit long, other array<struct<from:long,to:long>>, packed boolean, size long"
ENTERED = "file string, part long, end long, entry long, packed boolean, size long"
_PLACE = [("file", pa.string()), ("part", pa.int64()), ("end", pa.int64())]
_REST = [("packed", pa.bool_()), ("size", pa.int64())]


def _ranges(spark: SparkSession, uris: list[str], plain: int, packed: int) -> DataFrame:
    """(file, part, end, packed, size): a row a range."""
    blocks, rows = bgzf.block_gzip(uris), []
    for uri in dict.fromkeys(uris):
        files, path = bgzf.filesystem(uri)
        size, step = files.get_file_info(path).size, packed if uri in blocks else plain
        rows += [(uri, a, min(a + step, size), uri in blocks, size) for a in range(0, size, step)]
    bad = [u for u in uris if u.endswith(bgzf.ENDINGS) and u not in blocks]
    if bad:
        raise ValueError(f"{bad[0]}: gzip, but not of blocks")
    return spark.createDataFrame(rows, "file string, part long, end long, packed boolean, size long").repartition(_tasks(len(rows)))


def _tasks(ranges: int) -> int:
    return min(max(ranges, 1), TASKS)


def _tried(ranges: DataFrame, kind: Format) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                files, path = bgzf.filesystem(r["file"])
                with files.open_input_file(path) as stream:
                    w = Window(stream, r["size"], r["part"], r["end"], r["packed"])
                    first = kind.first(w) if r["part"] == 0 else None
                    exits: dict[int, int] = {}
                    for c in reversed(kind.candidates(w)):
                        found = kind.parse(w, c)
                        if found and (found[0] >= w.own or found[0] in exits):
                            exits[c] = exits.get(found[0], found[0])
                    most = Counter(exits.values()).most_common(1)[0][0] if exits else None
                    row = {
                        **r,
                        "first": None if first is None else w.place(first),
                        "exit": None if most is None else w.place(most),
                        "other": [{"from": w.place(c), "to": w.place(e)} for c, e in exits.items() if e != most],
                    }
                names = [f.split()[0] for f in ("file", "part", "end", "first", "exit", "other", "packed", "size")]
                types = dict([*_PLACE, ("first", pa.int64()), ("exit", pa.int64()), ("other", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), *_REST])
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], types[n]) for n in names], names)

    return ranges.mapInArrow(run, TRIED)


def _entered(tried: DataFrame) -> DataFrame:
    """Ranges with their entries; those where no record begins are left out."""

    def fold(table: pa.Table) -> pa.Table:
        rows, entry = [], NOWHERE
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            entry = entry if r["first"] is None else r["first"]
            if entry == NOWHERE or (entry >> 16 if r["packed"] else entry) >= r["end"]:
                continue
            rows.append({**r, "entry": entry})
            exits = {x["from"]: x["to"] for x in r["other"]}
            entry = exits.get(entry, r["exit"])
            if entry is None:
                raise ValueError(f"{r['file']}: no record at {rows[-1]['entry']}")
        return pa.Table.from_pylist(rows, pa.schema([*_PLACE, ("entry", pa.int64()), *_REST]))

    return tried.groupBy("file").applyInArrow(fold, ENTERED)


def read_records(spark: SparkSession, uris: list[str], kind: Format, plain: int | None = None, packed: int | None = None) -> DataFrame:
    """(file, part, at, ...) of all records; at: a record's number in its range.  A file that is broken raises."""
    tried = materialize(_tried(_ranges(spark, uris, plain or PLAIN, packed or PACKED), kind), "tried")
    entered = materialize(_entered(tried), "entered")
    entered = entered.repartition(_tasks(entered.count()))
    names, types = ["file", "part", "at", *kind.names], [pa.string(), pa.int64(), pa.int64(), *kind.types]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                files, path = bgzf.filesystem(r["file"])
                with files.open_input_file(path) as stream:
                    w = Window(stream, r["size"], r["part"], r["end"], r["packed"])
                    i, n, rows = w.index(r["entry"]), 0, []
                    begin = i
                    while i < w.own:
                        found = kind.parse(w, i)
                        if found is None:
                            raise ValueError(f"{r['file']}: no record at {w.place(i)}: {bytes(w.text[i : i + 80])!r}")
                        rows.append((r["file"], r["part"], n, *found[1]))
                        i, n = found[0], n + 1
                        if len(rows) == bgzf.ROWS or i - begin >= bgzf.CHUNK:
                            yield batch(rows)
                            rows, begin = [], i
                    if rows:
                        yield batch(rows)

    return entered.mapInArrow(run, f"file string, part long, at long, {kind.schema}")
