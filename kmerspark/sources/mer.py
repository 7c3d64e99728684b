"""The flat k-mer file: k (4 bytes), the number of k-mers (8), then 8 bytes each, all little endian."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from kmerspark.functions.codec import check_k

HEADER = "<IQ"
#: K-mers in one part.
PART = 1 << 20


def to_parts(table: DataFrame, k: int, part: int = PART) -> DataFrame:
    """(part, data) of table(pos, code): runs of positions as files of their own, each with its header.

    Read in order of the part, the k-mers after the headers are those of one whole file.
    """
    check_k(k)
    cut = table.select(F.floor(F.col("pos") / part).alias("part"), "pos", "code").repartition("part").sortWithinPartitions("part", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            parts, codes = b.column(0).to_numpy(), b.column(2).to_numpy()
            for p in np.unique(parts):
                if last is not None and p != last:
                    yield done(last, held)
                    held = []
                held.append(codes[parts == p])
                last = p
        if held:
            yield done(last, held)

    def done(at: int, held: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([int(at)], pa.int64()), pa.array([struct.pack(HEADER, k, len(codes)) + codes.astype("<i8").tobytes()], pa.binary())], ["part", "data"])

    return cut.mapInArrow(run, "part long, data binary")


def from_parts(parts: DataFrame) -> DataFrame:
    """(part, place, k, code) of every k-mer in parts(part, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = data.as_buffer()
                k, n = struct.unpack_from(HEADER, raw)
                if len(raw) != struct.calcsize(HEADER) + 8 * n:
                    raise ValueError(f"part {part}: {n} k-mers declared in {len(raw)} bytes")
                codes = np.frombuffer(raw, "<i8", offset=struct.calcsize(HEADER))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(n)), pa.array(np.full(n, k, np.int32)), pa.array(codes)], ["part", "place", "k", "code"])

    return parts.select("part", "data").mapInArrow(run, "part long, place long, k int, code long")


class MerSource(DataSource):
    """The format "mer": (file, pos, k, code) of flat k-mer files, by ranges of bytes; written as a file for each partition.

    Options: path, a file or a folder of them as any URI that pyarrow knows, and
    range, the k-mers of one range.
    """

    @classmethod
    def name(cls) -> str:
        return "mer"

    def schema(self) -> str:
        return "file string, pos long, k int, code long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MerReader(self.options["path"], int(self.options.get("range", PART)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MerWriter(self.options["path"], int(self.options["k"]), overwrite)


@dataclass
class Range(InputPartition):
    file: str
    k: int
    first: int
    n: int


class MerReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        """Ranges of every file, once its length is what its header says; headers alone are read."""
        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else _mer_files(files, root)
        out = []
        for f in found:
            with files.open_input_file(f.path) as stream:
                k, n = struct.unpack(HEADER, stream.read(struct.calcsize(HEADER)))
            if f.size != struct.calcsize(HEADER) + 8 * n:
                raise ValueError(f"{f.path}: {n} k-mers declared in {f.size} bytes")
            out += [Range(f.path, k, a, min(self.size, n - a)) for a in range(0, n, self.size)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no parts
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.file) as stream:
            stream.seek(struct.calcsize(HEADER) + 8 * partition.first)
            codes = np.frombuffer(stream.read(8 * partition.n), "<i8")
        n = len(codes)
        yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array(np.arange(partition.first, partition.first + n)), pa.array(np.full(n, partition.k, np.int32)), pa.array(codes)], ["file", "pos", "k", "code"])


@dataclass
class Written(WriterCommitMessage):
    file: str
    part: int


def _mer_files(files: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """The flat files of a folder, by name; names that begin with "_" are of writes under way."""
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name.endswith("mer") and not f.base_name.startswith("_")), key=lambda f: f.path)


class MerWriter(DataSourceArrowWriter):
    """Each partition's codes, in their order, become a file of their own, which is renamed when all are done.

    A name holds the number of its write, one more than any in the folder, so that
    files of a later write come after those that are there.
    """

    def __init__(self, path: str, k: int, overwrite: bool):
        self.path, self.k, self.overwrite = path, k, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        context = TaskContext.get()
        name = f"{root}/_part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        codes = [b.column(b.schema.get_field_index("code")).to_numpy() for b in iterator]
        with files.open_output_stream(name) as out:
            out.write(struct.pack(HEADER, self.k, sum(map(len, codes))))
            for c in codes:
                out.write(c.astype("<i8").tobytes())
        return Written(name, context.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        there = _mer_files(files, root)
        numbers = [int(m[1]) for f in there if (m := re.fullmatch(r"write-(\d+)-part-\d+\.smer", f.base_name))]
        moved: list[str] = []
        try:
            for m in filter(None, messages):
                name = f"{root}/write-{max(numbers, default=-1) + 1:06d}-part-{m.part:06d}.smer"
                files.move(m.file, name)
                moved.append(name)
        except BaseException:
            for name in moved:
                files.delete_file(name)
            raise
        for f in there if self.overwrite else []:  # only once all that is new is in place
            files.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.path)
        for m in filter(None, messages):
            if files.get_file_info(m.file).is_file:
                files.delete_file(m.file)


def read_mer(spark: SparkSession, path: str, size: int = PART) -> DataFrame:
    """(file, pos, k, code) of a flat k-mer file, or of a folder's in the order of their names, read by ranges of ``size`` k-mers."""
    spark.dataSource.register(MerSource)
    return spark.read.format("mer").option("range", size).load(path)


def write_mer(kmers: DataFrame, k: int, path: str, mode: str = "error") -> None:
    """kmers(code) in their order as flat files, one for each partition; in name order they are one sorted file if kmers are sorted.

    mode: what happens where the folder has flat files already.  "error" raises,
    "append" adds files whose names come after those, "overwrite" removes those
    once the new ones are written.
    """
    check_k(k)
    files, root = fs.FileSystem.from_uri(path)
    if mode not in ("error", "append", "overwrite"):
        raise ValueError(f"mode {mode!r}")
    if mode == "error" and _mer_files(files, root):
        raise ValueError(f"{path} has flat k-mer files already")
    kmers.sparkSession.dataSource.register(MerSource)
    kmers.select("code").write.format("mer").option("k", k).mode("append" if mode == "error" else mode).save(path)
