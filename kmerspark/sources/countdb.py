"""Databases of counted k-mers as external counters write them: a prefix file and a suffix file.

The suffix file holds a record a k-mer, the bases after the prefix at four to a
byte and a counter, little endian.  The prefix file holds, for each prefix of
each bin, the number of the first record that has it, and a header at its end.
Version 0 has one bin in the order of the k-mers; version 2 has many, and a table
that says which bin a signature went to, which a scan does not need.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from kmerspark.functions.codec import check_k

# Fixed values of the format.
PREFIXES, SUFFIXES = ".kmc_pre", ".kmc_suf"
PREFIX_MARK, SUFFIX_MARK = b"KMCP", b"KMCS"
VERSIONS = {0: 0, 2: 0x200}

#: Fields of the header, before the version; the second's counts are in one field less.
FIELDS = {0: "<IIIIIIQBI", 2: "<IIIIIIIQB"}
#: Records of one part of a scan, and entries of the prefix table in memory at a time.
PART, ENTRIES = 1 << 22, 1 << 20
SIGNATURE = 5  # length of the signatures in what is written here


@dataclass
class Database:
    """The header of one database: what its files are called, and what is in them."""

    name: str
    version: int
    k: int
    counter_bytes: int
    prefix_len: int
    signature_len: int
    min_count: int
    max_count: int
    kmers: int
    both_strands: bool
    entries: int

    @property
    def suffix_bytes(self) -> int:
        return (self.k - self.prefix_len) // 4

    @property
    def record(self) -> int:
        return self.suffix_bytes + self.counter_bytes


INFO = "name string, version int, k int, counter_bytes int, prefix_len int, signature_len int, min_count long, max_count long, kmers long, both_strands boolean, entries long"


def read_header(files: fs.FileSystem, path: str) -> Database:
    """The database whose prefix file is at path; raises where the two files do not agree with each other."""
    size, name = files.get_file_info(path).size, path.removesuffix(PREFIXES)
    with files.open_input_file(path) as f:
        first = f.read(4)
        f.seek(max(size - 12, 0))
        tail = f.read(12)
        if size < 16 or first != PREFIX_MARK or tail[8:] != PREFIX_MARK:
            raise ValueError(f"{path}: not a prefix file")
        code, header = struct.unpack("<II", tail[:8])
        version = next((v for v, c in VERSIONS.items() if c == code), None)
        if version is None:
            raise ValueError(f"{path}: version {code:#x}")
        header &= 0xFF  # one byte counts
        f.seek(size - 8 - header)
        values = struct.unpack(FIELDS[version], f.read(struct.calcsize(FIELDS[version])))
    if version == 0:
        k, mode, counter, prefix, least, low, kmers, strand, high = values
        signature, most, entries = 0, low | high << 32, 4**prefix
    else:
        k, mode, counter, prefix, signature, least, most, kmers, strand = values
        entries = (size - 12 - header - 4 * (4**signature + 1)) // 8 - 1
    if mode != 0:
        raise ValueError(f"{path}: counts with qualities are not read")
    check_k(k)
    found = Database(name, version, k, counter, prefix, signature, least, most, kmers, strand == 0, entries)
    if (k - prefix) % 4 or entries % 4**prefix:
        raise ValueError(f"{path}: {entries} prefixes of {prefix} bases for k = {k}")
    suffixes = files.get_file_info(name + SUFFIXES)
    if suffixes.size != 8 + kmers * found.record:
        raise ValueError(f"{name}{SUFFIXES}: {kmers} records of {found.record} bytes declared in {suffixes.size} bytes")
    return found


def databases(path: str) -> list[Database]:
    """The databases of a folder by name, or the one that path names with or without its ending; headers alone are read."""
    files, root = fs.FileSystem.from_uri(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.Directory:
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(PREFIXES) and not f.base_name.startswith("_"))
    else:
        found = [root.removesuffix(PREFIXES) + PREFIXES]
    return [read_header(files, f) for f in found]


@dataclass
class Records(InputPartition):
    db: Database
    first: int
    end: int


class CountDbSource(DataSource):
    """The format "countdb": (file, code, cnt), by ranges of records.

    Options: path; range, the records of one part; least and most, counts to keep,
    which the database's own bounds narrow further.
    """

    @classmethod
    def name(cls) -> str:
        return "countdb"

    def schema(self) -> str:
        return "file string, code long, cnt long"

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return CountDbReader(o["path"], int(o.get("range", PART)), int(o.get("least", 0)), int(o.get("most", 2**63 - 1)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return CountDbWriter(o["path"], int(o["k"]), int(o["prefix"]), int(o["counter"]), int(o["version"]), o["both"] == "true", overwrite)


class CountDbReader(DataSourceReader):
    """A part is a range of records, whatever their prefixes are, so one frequent prefix is many parts."""

    def __init__(self, path: str, size: int, least: int, most: int):
        self.path, self.size, self.least, self.most = path, size, least, most

    def partitions(self) -> list[Records]:
        return [Records(db, a, min(a + self.size, db.kmers)) for db in databases(self.path) for a in range(0, db.kmers, self.size)]

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no parts
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        db = partition.db
        with files.open_input_file(db.name + PREFIXES) as prefixes, files.open_input_file(db.name + SUFFIXES) as suffixes:

            def table(i: int, n: int) -> np.ndarray:
                """The first records of n prefixes from the i-th on, and of the one after; past the last there are none."""
                prefixes.seek(4 + 8 * i)
                got = np.frombuffer(prefixes.read(8 * min(n + 1, db.entries - i)), "<u8").astype(np.int64)
                return got if len(got) == n + 1 else np.append(got, db.kmers)

            low, high = 0, db.entries  # the last prefix whose first record is not past the part's
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if table(middle, 0)[0] <= partition.first else (low, middle)
            at = partition.first
            while at < partition.end:
                starts = table(low, min(ENTRIES, db.entries - low))
                end = min(int(starts[-1]), partition.end)
                while at < end:
                    to = min(at + ENTRIES, end)
                    suffixes.seek(4 + at * db.record)
                    yield self._batch(db, suffixes.read((to - at) * db.record), low + np.searchsorted(starts, np.arange(at, to), "right") - 1)
                    at = to
                low += len(starts) - 1

    def _batch(self, db: Database, data: bytes, entry: np.ndarray) -> pa.RecordBatch:
        rows = np.frombuffer(data, np.uint8).reshape(len(entry), db.record) if db.record else np.zeros((len(entry), 0), np.uint8)
        code = (entry % 4**db.prefix_len).astype(np.uint64)
        for i in range(db.suffix_bytes):
            code = code << np.uint64(8) | rows[:, i]
        cnt = np.zeros(len(entry), np.int64) if db.counter_bytes else np.ones(len(entry), np.int64)
        for i in range(db.counter_bytes):
            cnt |= rows[:, db.suffix_bytes + i].astype(np.int64) << (8 * i)
        if db.counter_bytes:
            kept = (cnt >= max(db.min_count, self.least)) & (cnt <= min(db.max_count, self.most))
            code, cnt = code[kept], cnt[kept]
        return pa.RecordBatch.from_arrays([pa.array([db.name] * len(cnt), pa.string()), pa.array(code.view(np.int64)), pa.array(cnt)], ["file", "code", "cnt"])


@dataclass
class Pair(WriterCommitMessage):
    name: str
    part: int


class CountDbWriter(DataSourceArrowWriter):
    """Each partition's counts, sorted by code, become a database of their own, named when all are done."""

    def __init__(self, path: str, k: int, prefix: int, counter: int, version: int, both: bool, overwrite: bool):
        self.path, self.k, self.prefix, self.counter, self.version, self.both, self.overwrite = path, k, prefix, counter, version, both, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pair:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        context, shift = TaskContext.get(), 2 * (self.k - self.prefix)
        name = f"{root}/_part-{context.partitionId():06d}-{uuid.uuid4().hex}"
        sizes, n, least, most, last = np.zeros(4**self.prefix, np.int64), 0, 2**32 - 1, 1, -1
        with files.open_output_stream(name + SUFFIXES) as out:
            out.write(SUFFIX_MARK)
            for b in iterator:
                code = b.column(b.schema.get_field_index("code")).to_numpy().view(np.uint64)
                cnt = b.column(b.schema.get_field_index("cnt")).to_numpy()
                if not len(code):
                    continue
                if cnt.min() < 1 or cnt.max() >= 256**self.counter:
                    raise ValueError(f"counts from {cnt.min()} to {cnt.max()} in counters of {self.counter} bytes")
                if int(code[0]) <= last or (code[1:] <= code[:-1]).any():
                    raise ValueError("k-mers repeat, or do not increase")
                last, n = int(code[-1]), n + len(code)
                least, most = min(least, int(cnt.min())), max(most, int(cnt.max()))
                sizes += np.bincount((code >> np.uint64(shift)).astype(np.int64), minlength=len(sizes))
                big = code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - shift // 8 :]
                little = cnt.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.counter]
                out.write(np.hstack([big, little]).tobytes())
            out.write(SUFFIX_MARK)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")  # the last is the guard
        common = (self.k, 0, self.counter, self.prefix)
        strand = 0 if self.both else 1
        if self.version == 0:
            middle, header = b"", struct.pack(FIELDS[0], *common, min(least, most), most & 0xFFFFFFFF, n, strand, most >> 32)
        else:  # one bin, to which all signatures go
            middle, header = bytes(4 * (4**SIGNATURE + 1)), struct.pack(FIELDS[2], *common, SIGNATURE, min(least, most), min(most, 2**32 - 1), n, strand)
        with files.open_output_stream(name + PREFIXES) as out:
            out.write(PREFIX_MARK + first.tobytes() + middle + header + struct.pack("<II", VERSIONS[self.version], len(header) + 4) + PREFIX_MARK)
        return Pair(name, context.partitionId())

    def commit(self, messages: list[Pair | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        there = [db.name for db in databases(self.path)] if self.overwrite else []
        run, moved = uuid.uuid4().hex, []
        try:
            for m in filter(None, messages):
                for ending in (SUFFIXES, PREFIXES):  # a scan looks for the second
                    files.move(m.name + ending, f"{root}/{run}-part-{m.part:06d}{ending}")
                    moved.append(f"{root}/{run}-part-{m.part:06d}{ending}")
        except BaseException:
            for name in moved:
                files.delete_file(name)
            raise
        for name in there:
            files.delete_file(name + PREFIXES)
            files.delete_file(name + SUFFIXES)

    def abort(self, messages: list[Pair | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.path)
        for name in [m.name + e for m in messages if m for e in (PREFIXES, SUFFIXES)]:
            if files.get_file_info(name).is_file:
                files.delete_file(name)


def read_counts(spark: SparkSession, path: str, least: int = 0, most: int = 2**63 - 1, size: int = PART) -> DataFrame:
    """(file, code, cnt) of one database, or of a folder's; k-mers whose counts are outside least and most, or the header's own bounds, are left out.

    Databases without counters give 1 for each k-mer and are not filtered.  The
    rows are in no order over bins; a k-mer in two databases is two rows.
    """
    spark.dataSource.register(CountDbSource)
    return spark.read.format("countdb").options(range=size, least=least, most=most).load(path)


def count_db_info(spark: SparkSession, path: str) -> DataFrame:
    """INFO: a row a database, from its header."""
    return spark.createDataFrame([tuple(asdict(db).values()) for db in databases(path)], INFO)


def write_counts(counts: DataFrame, k: int, path: str, prefix: int | None = None, counter: int = 4, version: int = 2, both_strands: bool = False, overwrite: bool = False) -> None:
    """Distinct counts(code, cnt) as databases over ranges of k-mers, one a partition; a folder with databases raises unless overwrite.

    prefix: bases of a k-mer that the table of prefixes takes, some number that
    leaves whole bytes; counter: bytes of a counter, 1 to 4; larger counts raise.
    """
    check_k(k)
    prefix = prefix if prefix is not None else k % 4 + 4 * (k >= k % 4 + 4)
    if not 1 <= prefix <= min(k, 12) or (k - prefix) % 4 or not 1 <= counter <= 4 or version not in VERSIONS:
        raise ValueError(f"prefix {prefix}, counter {counter}, version {version} for k = {k}")
    files, root = fs.FileSystem.from_uri(path)
    if not overwrite and files.get_file_info(root).type == fs.FileType.Directory and databases(path):
        raise ValueError(f"{path} has databases already")
    counts.sparkSession.dataSource.register(CountDbSource)
    # the 32nd base takes the sign bit: k-mers are ordered without a sign, negative codes last
    sign, cut = F.col("code") < 0, counts.select("code", F.col("cnt").cast("long").alias("cnt"))
    ranges = cut.repartitionByRange(sign, "code").sortWithinPartitions(sign, "code")
    ranges.write.format("countdb").options(k=k, prefix=prefix, counter=counter, version=version, both=str(both_strands).lower()).mode("overwrite" if overwrite else "append").save(path)
