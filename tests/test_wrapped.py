"""FASTQ records over many lines, by ranges that begin anywhere, against the records that were written."""

import random

import pytest

from kmerspark.jobs import cli
from kmerspark.sources import bgzf, entries, fasta


def wrap(text, width):
    return "\n".join(text[a : a + width] for a in range(0, len(text), width))


def some_records(rng, n, end="\n"):
    """Qualities whose lines look like headers, separators, sequences or whole records."""
    out, want = [], []
    for i in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 5, 30, 200])))
        kind = rng.randrange(3)
        if kind == 0:
            quality = "@" * len(seq)
        elif kind == 1:
            quality = "".join(rng.choices("@+>IA#", k=len(seq)))
        else:  # a record inside of the quality, line for line
            quality = ("@ACGT" + "ACGTA" + "+ACGT" + "IIIII") * 20
            quality = quality[: len(seq)]
        width = rng.choice([5, 5, 60, 1000])
        body = f"@r{i} c{i}\n{wrap(seq, width)}\n+{rng.choice(['', f'r{i} c{i}'])}\n{wrap(quality, 5 if kind == 2 else width)}\n"
        out.append(body.replace("\n", end) + rng.choice(["", "", "\n"]))
        want.append((f"r{i} c{i}", seq))
    return "".join(out), want


@pytest.mark.parametrize(("size", "end"), [(40, "\n"), (150, "\r\n"), (900, "\n"), (1 << 20, "\n")])
def test_any_range(spark, tmp_path, monkeypatch, size, end):
    rng = random.Random(size)
    text, want = some_records(rng, 60, end)
    (tmp_path / "a.fq").write_text("leading\n" + text, newline="")
    (tmp_path / "b.fq.gz").write_bytes(bgzf.compress(text.encode(), max(size // 2, 30)))
    (tmp_path / "c.fq").write_text("")
    monkeypatch.setattr(entries, "PLAIN", size)
    monkeypatch.setattr(entries, "PACKED", size)
    got = fasta.read_fastq(spark, [f"file://{tmp_path}/{n}" for n in ("b.fq.gz", "a.fq", "c.fq")], wrapped=True).orderBy(*fasta.PLACE).collect()
    assert [(r.number, r.id, r.seq) for r in got] == [(0, *x) for x in want] + [(1, *x) for x in want]


def test_four_lines_agree(spark, tmp_path):
    text = "".join(f"@n{i}\nACGTN\n+\nIIIII\n" for i in range(50)).rstrip("\n")
    (tmp_path / "x.fq").write_text(text)
    read = lambda w: [(r.name, r.comment, r.seq) for r in fasta.read_fastq(spark, f"file://{tmp_path}/x.fq", wrapped=w).orderBy(*fasta.PLACE).collect()]
    assert read(True) == read(False) and len(read(True)) == 50


@pytest.mark.parametrize("bad", ["@a\nACGT\n+\nIII\n@b\nA\n+\nI\n", "@a\nACGT\n+\nIIII\njunk\n", "@a\nACGT\n", "@a\nAC\n+\nIII\n"])
def test_broken(spark, tmp_path, bad):
    (tmp_path / "x.fq").write_text("@o\nAC\n+\nII\n" + bad)
    with pytest.raises(Exception, match="no record at"):
        fasta.read_fastq(spark, f"file://{tmp_path}/x.fq", wrapped=True).collect()


def test_plain_gzip(spark, tmp_path):
    import gzip

    (tmp_path / "x.fq.gz").write_bytes(gzip.compress(b"@a\nA\n+\nI\n"))
    with pytest.raises(ValueError, match="not of blocks"):
        fasta.read_fastq(spark, f"file://{tmp_path}/x.fq.gz", wrapped=True)


def test_command_line(spark, tmp_path):
    text, want = some_records(random.Random(5), 30)
    (tmp_path / "x.fq").write_text(text)
    (tmp_path / "x.fa").write_text("".join(f">{n}\n{s}\n" for n, s in want))
    counts = []
    for name, flags in (("x.fq", ["--wrapped"]), ("x.fa", [])):
        cli.main(["count", "-k", "5", *flags, "-o", f"file://{tmp_path}/{name}-counts", f"file://{tmp_path}/{name}"], spark)
        counts.append(sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/{name}-counts").collect())))
    assert counts[0] == counts[1] and counts[0]
