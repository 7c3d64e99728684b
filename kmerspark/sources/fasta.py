"""FASTA and FASTQ text, split over records by Spark's own text reader; gzip by the file's name, block gzip by ranges of bytes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kmerspark.sources import bgzf, entries
from kmerspark.sources.entries import Window

#: A record's place: ordered by these, records are as in the files, and the files as the paths were given.
PLACE = ["number", "file", "part", "at"]
SCHEMA = "number int, file string, part long, at long, name string, comment string, id string, seq string"


def _found(spark: SparkSession, paths: str | Sequence[str], numbers: Sequence[int] | None) -> list[tuple[str, int]]:
    """(file, number) of what each path finds; number: that of the path, so a path given twice is read twice."""
    given = [paths] if isinstance(paths, str) else list(paths)
    return [(f, int(n)) for n, p in zip(range(len(given)) if numbers is None else numbers, given, strict=True) for f in dict.fromkeys(spark.read.text(p).inputFiles())]


def _numbered(spark: SparkSession, raw: DataFrame, found: list[tuple[str, int]]) -> DataFrame:
    """(number, file, part, at, value) of raw(file, part, at, value)."""
    places = spark.createDataFrame(found, "found string, number int")  # a row a file, which the driver has listed
    plain = lambda c: F.regexp_replace(c, "^(\\w+):/+", "$1:/")  # noqa: E731  the two write a scheme with one or with three slashes
    return raw.join(F.broadcast(places), plain("file") == plain("found")).select("number", "file", "part", "at", "value")


def _pieces(spark: SparkSession, paths: str | Sequence[str], numbers: Sequence[int] | None, separator: str) -> DataFrame:
    """The text between separators."""
    given = [paths] if isinstance(paths, str) else list(paths)
    read, found = spark.read.option("lineSep", separator), _found(spark, paths, numbers)
    blocks = bgzf.block_gzip(list(dict.fromkeys(f for f, _ in found)))
    rest = list(dict.fromkeys(f for f, _ in found if f not in blocks)) if blocks else list(dict.fromkeys(given))
    read_as = []
    if rest:
        read_as.append(read.text(rest).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value"))
    if blocks:
        read_as.append(bgzf.read_pieces(spark, sorted(blocks), separator))
    return _numbered(spark, reduce(DataFrame.unionByName, read_as), found)


def _records(pieces: DataFrame, parse: Callable[[str, str, bool], tuple[str, str] | None]) -> DataFrame:
    """SCHEMA from pieces, in the order of the files; parse(file, text, whether it opens its file) gives a header line and a sequence, or None."""

    types = [pa.int32(), pa.string(), pa.int64(), pa.int64()] + 4 * [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[str | None, int | None] = None, None  # of the file that rows are from
        for b in batches:
            rows: list[tuple] = []
            for number, file, part, at, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = first if file == first[0] else (file, at)
                found = parse(file, text, part == 0 and at == first[1])
                if found is not None:
                    name, _, comment = re.sub(r"\s", "\t", found[0], count=1).partition("\t")
                    rows.append((number, file, part, at, name, comment or None, f"{name} {comment}" if comment else name, found[1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[i]) for i, c in enumerate(zip(*rows, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])

    return pieces.mapInArrow(run, SCHEMA)


def _fasta(file: str, text: str, opens: bool) -> tuple[str, str] | None:
    if opens:  # only the first record of a file has kept its ">", as no line end comes before it
        text = text.lstrip()
        if text.startswith("@") and re.match(r"@[^\n]*\n[^\n]*\n\+", text):
            raise ValueError(f"{file}: FASTQ records, not FASTA; use read_fastq")
        if not text.startswith(">"):
            return None  # leading text
        text = text[1:]
    head, _, body = text.partition("\n")
    return head.rstrip("\r"), "".join(body.split())


def read_fasta(spark: SparkSession, paths: str | Sequence[str], numbers: Sequence[int] | None = None) -> DataFrame:
    """(number, file, part, at, name, comment, id, seq) of FASTA files.

    number: the path's place among those given, or its own of ``numbers``; files
    that one path finds are in the order of their names.

    A record starts at a line with ">".  The name goes up to the first blank, the
    comment is the rest of the line, id is both.  Sequence lines are joined,
    carriage returns and blanks dropped; a record without sequence has an empty
    one, text before a file's first record is dropped, and blank files give no
    rows.  A file of FASTQ records raises.
    """
    return _records(_pieces(spark, paths, numbers, "\n>"), _fasta)


def _fastq(file: str, text: str, opens: bool) -> tuple[str, str] | None:
    if opens:
        text = text.lstrip()
        if text.startswith(">"):
            raise ValueError(f"{file}: FASTA records, not FASTQ; use read_fasta")
        if not text.startswith("@"):
            return None  # leading text
        text = text[1:]
    lines = [x.rstrip("\r") for x in text.rstrip("\n").split("\n")]
    if len(lines) == 1 and not opens:
        return None  # what follows the "@" that a quality line begins with
    if len(lines) not in (3, 4) or not lines[2].startswith("+") or (len(lines) == 4 and len(lines[3]) != len(lines[1])):
        raise ValueError(f"{file}: not a record of four lines: @{text[:80]!r}")
    return lines[0], lines[1]


def _next_header(w: Window, i: int) -> tuple[bool, int]:
    """Whether a record or the end of the file comes at i, blank lines aside, and where."""
    while (found := w.line(i)) is not None:
        if found[0].strip():
            return found[0].startswith(b"@"), i
        i = found[1]
    return True, i


def _wrapped(w: Window, i: int) -> tuple[int, tuple] | None:
    """A record of any number of lines: qualities have as many characters as the sequence, whatever they begin with."""
    head = w.line(i)
    if head is None or not head[0].startswith(b"@"):
        return None
    seq, i = [], head[1]
    while True:
        found = w.line(i)
        if found is None or found[0][:1] in (b"@", b">"):
            return None
        line, i = found
        if line.startswith(b"+"):
            break
        seq.append(b"".join(line.split()))
    left = sum(map(len, seq))
    while left > 0:
        found = w.line(i)
        if found is None:
            return None
        left, i = left - len(found[0].rstrip()), found[1]
    fits, i = _next_header(w, i)
    return (i, ((head[0][1:] + b"\n" + b"".join(seq)).decode(errors="replace"),)) if fits and left == 0 else None


def _first_fastq(w: Window) -> int:
    i = 0
    while (found := w.line(i)) is not None and not found[0].lstrip().startswith(b"@"):
        i = found[1]
    return i + (len(found[0]) - len(found[0].lstrip()) if found else 0)


def _at_lines(w: Window) -> list[int]:
    """Where a line of the range begins with "@"; what a line's end outside of the range comes before is seen from its first byte."""
    out, i = [0] if w.text[:1] == b"@" and w.own else [], w.text.find(b"\n@", 0, w.own)
    while i >= 0:
        out.append(i + 1)
        i = w.text.find(b"\n@", i + 1, w.own)
    return out


_FASTQ = entries.Format(_first_fastq, _at_lines, _wrapped, [pa.string()], ["value"], "value string")


def read_fastq(spark: SparkSession, paths: str | Sequence[str], numbers: Sequence[int] | None = None, wrapped: bool = False) -> DataFrame:
    """The same columns of FASTQ files; qualities are read and dropped.

    Text before a file's first record is dropped.  Records have four lines, else
    they raise, as does a quality of another length; a quality that begins with
    "@" is not measured, since it looks like a record's start.

    wrapped: sequences and qualities may take any number of lines, and a quality's
    length alone says where it ends, so that its lines may begin with "@" or "+".
    Files are read twice, plain ones and block gzip by ranges; other gzip raises.
    """
    if not wrapped:
        return _records(_pieces(spark, paths, numbers, "\n@"), _fastq)
    found = _found(spark, paths, numbers)
    raw = entries.read_records(spark, list(dict.fromkeys(f for f, _ in found)), _FASTQ)
    return _records(_numbered(spark, raw, found), lambda file, text, opens: text.partition("\n")[::2])


def fasta_record(name: str, seq: str) -> Column:
    """A FASTA record on two lines."""
    return F.concat(F.lit(">"), F.coalesce(F.col(name), F.lit("")), F.lit("\n"), F.col(seq))


def fasta_text(seqs: DataFrame, width: int = 60) -> DataFrame:
    """(value): seqs(name, seq) as FASTA records, wrapped at ``width``; 0 for one line."""
    wrapped = seqs.withColumn("seq", F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")) if width else seqs
    return wrapped.select(fasta_record("name", "seq").alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60, compression: str | None = None, order: Sequence[str] = ()) -> None:
    """seqs(name, seq) as FASTA files; in the given order over the files by name, if there is one."""
    out = fasta_text(seqs.orderBy(*order) if order else seqs, width).write
    (out.option("compression", compression) if compression else out).text(path)
