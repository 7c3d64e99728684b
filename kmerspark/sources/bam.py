"""Alignments as BAM: binary records in block gzip, read by ranges of bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerspark.rows import MAX_BROADCAST
from kmerspark.scratch import materialize
from kmerspark.sources import bgzf, entries
from kmerspark.sources.entries import Window

# Fixed values of the format.
MAGIC = b"BAM\x01"
BASES = "=ACMGRSVTWYHKDBN"
#: A record's length, and its fields up to the name.
LENGTH, FIXED = "<i", "<iiBBHHHiiii"
HEAD = 4 + struct.calcsize(FIXED)
#: Bytes of a file in a range, some four times as many of text; places that are tried at once.
RANGE, PLACES = 1 << 21, 1 << 18

_CODES = np.frombuffer(BASES.encode(), np.uint8)


def _header(w: Window) -> tuple[list[str], int]:
    """The names of the references, and where the first record begins."""

    def take(fmt: str, at: int) -> int:
        if not w.holds(at + struct.calcsize(fmt)):
            raise ValueError("the header is cut short")
        return struct.unpack_from(fmt, w.text, at)[0]

    if not w.holds(8) or w.text[:4] != MAGIC:
        raise ValueError("not a BAM file")
    at = 8 + take(LENGTH, 4)
    n, names = take(LENGTH, at), []
    at += 4
    for _ in range(n):
        size = take(LENGTH, at)
        take(LENGTH, at + 4 + size)
        names.append(bytes(w.text[at + 4 : at + 3 + size]).decode())
        at += 8 + size
    return names, at


def _candidates(w: Window) -> Sequence[int]:
    """Where the numbers at a place fit those of a record: none negative that cannot be, and the parts no longer than the whole."""
    own = w.own
    w.holds(own + HEAD + 255)
    n = min(own, len(w.text) - HEAD)
    if n <= 0:
        return []
    found: list[int] = []
    for a in range(0, n, PLACES):  # numbers of all places of a range would take some hundred bytes a place
        found += _fitting(bytes(w.text[a : min(a + PLACES, n) + HEAD + 255]), min(PLACES, n - a), a)
    return found


def _fitting(data: bytes, n: int, begin: int) -> list[int]:
    """Of the first n places of data, which begins at a place of the range, those that could be a record's."""
    number = lambda o, kind: np.ndarray((n,), kind, data, o, (1,))  # noqa: E731  at every byte
    name, cigar, seq = number(12, "u1").astype(np.int64), number(16, "<u2").astype(np.int64), number(20, "<i4").astype(np.int64)
    fits = (number(4, "<i4") >= -1) & (number(8, "<i4") >= -1) & (number(24, "<i4") >= -1) & (number(28, "<i4") >= -1) & (name > 0) & (seq >= 0)
    at = np.flatnonzero(fits & (number(0, "<i4") >= HEAD - 4 + name + 4 * cigar + (seq + 1) // 2 + seq))
    return [begin + i for i, k in zip(at.tolist(), name[at].tolist(), strict=True) if data.find(b"\x00", i + HEAD, i + HEAD + k) == i + HEAD + k - 1]


def _parse(w: Window, i: int) -> tuple[int, tuple] | None:
    if not w.holds(i + HEAD):
        return None
    size = struct.unpack_from(LENGTH, w.text, i)[0]
    ref, pos, name, _, _, cigar, flag, seq, *_ = struct.unpack_from(FIXED, w.text, i + 4)
    end, at = i + 4 + size, i + HEAD + name + 4 * cigar
    if name < 1 or seq < 0 or ref < -1 or end < at + (seq + 1) // 2 + seq or not w.holds(end):
        return None
    both = np.frombuffer(bytes(w.text[at : at + (seq + 1) // 2]), np.uint8)
    bases = _CODES[np.stack([both >> 4, both & 15], axis=1).reshape(-1)[:seq]].tobytes().decode()
    qname = bytes(w.text[i + HEAD : i + HEAD + name - 1]).decode(errors="replace")
    return end, (qname, flag, ref, pos + 1, bases or "*")


_BAM = entries.Format(
    lambda w: _header(w)[1], _candidates, _parse, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()], ["qname", "flag", "ref", "pos", "seq"], "qname string, flag int, ref int, pos long, seq string"
)


def references(spark: SparkSession, uris: Sequence[str]) -> DataFrame:
    """(file, ref, rname) of the files' headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                files, path = bgzf.filesystem(uri)
                with files.open_input_file(path) as stream:
                    names, _ = _header(Window(stream, files.get_file_info(path).size, 0, 1, True))
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], ["file", "ref", "rname"])

    return spark.createDataFrame([(u,) for u in uris], "file string").mapInArrow(run, "file string, ref int, rname string")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, rname, pos, seq) of the alignments, as sources.sam.read_sam has them: pos counts from 1, "*" for no reference or sequence.

    Files end in .bam.  They are read twice: where a record begins in a range is
    known only from those before it (sources.entries).
    """
    uris = sorted(spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).inputFiles())
    records = entries.read_records(spark, uris, _BAM, packed=min(RANGE, entries.PACKED))
    refs = materialize(references(spark, uris), "references")
    few = refs.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    named = records.join(F.broadcast(refs) if few else refs, ["file", "ref"], "left")
    return named.select("qname", "flag", F.coalesce("rname", F.lit("*")).alias("rname"), "pos", "seq")


def write_bam(alignments: DataFrame, path: str, refs: Sequence[str]) -> None:
    """alignments(qname, flag, rname, pos, seq) as a BAM file a partition, without qualities; letters that BAM has no code for become N.

    refs: names of the references; an alignment to another has none.  A null name,
    sequence or reference is "*", null numbers are 0.
    """
    code = np.full(256, 15, np.uint8)
    for i, c in enumerate(BASES):
        code[[ord(c), ord(c.lower())]] = i
    place = {r: i for i, r in enumerate(refs)}
    text = b"@HD\tVN:1.6\tSO:unknown\n" + b"".join(f"@SQ\tSN:{r}\tLN:{2**31 - 1}\n".encode() for r in refs)
    head = MAGIC + struct.pack(LENGTH, len(text)) + text + struct.pack(LENGTH, len(refs))
    head += b"".join(struct.pack(LENGTH, len(r.encode()) + 1) + r.encode() + b"\x00" + struct.pack(LENGTH, 2**31 - 1) for r in refs)

    def encode(b: pa.RecordBatch) -> bytes:
        out = []
        for qname, flag, rname, pos, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
            name, bases = (qname or "*").encode() + b"\x00", code[np.frombuffer(("" if seq in (None, "*") else seq).encode("ascii", "replace"), np.uint8)]
            if len(name) > 255:
                raise ValueError(f"a name of {len(name) - 1} bytes: {qname[:40]}")
            even = np.append(bases, np.zeros(len(bases) % 2, np.uint8))
            start = (pos or 0) - 1
            size = struct.calcsize(FIXED) + len(name) + len(even) // 2 + len(bases)
            fixed = struct.pack(LENGTH + FIXED[1:], size, place.get(rname, -1), start, len(name), 255, 4681 + (start >> 14) & 0xFFFF, 0, flag or 0, len(bases), -1, -1, 0)
            out += [fixed, name, (even[0::2] << 4 | even[1::2]).tobytes(), b"\xff" * len(bases)]
        return b"".join(out)

    cut = alignments.select("qname", F.col("flag").cast("int"), "rname", F.col("pos").cast("long"), "seq")
    bgzf.write_blocks(cut, path, encode, head, ".bam")
