"""Block gzip by ranges against the same text whole."""

import gzip
import random

import pytest

from kmerspark.sources import bgzf, fasta


def test_pieces():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("\n>a", k=rng.randrange(40))).encode()
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randrange(6)))
        blocks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        bounds = sorted({0, len(blocks), *rng.choices(range(len(blocks) + 1), k=2)})
        got = []
        for a, b in zip(bounds, bounds[1:]):
            got += bgzf.pieces([(i < b, blocks[i]) for i in range(a, len(blocks))], b"\n>", a == 0)
        want = text.split(b"\n>")
        assert got == (want if want[-1] else want[:-1]), (text, blocks, bounds)


@pytest.mark.parametrize("level", [0, 6])
def test_members_at_any_place(tmp_path, level):
    """Every place finds the next member, also where texts hold what looks like one."""
    rng = random.Random(2)
    fake = bgzf.compress(b"inner" * 30)
    data = b"".join(rng.choice([fake, rng.randbytes(300), bgzf.MAGIC, fake[:18], b"A" * 900]) for _ in range(200))
    raw = bgzf.compress(data, 0xFF00 if level == 0 else 1500)
    assert gzip.decompress(raw) == data
    (tmp_path / "x.gz").write_bytes(raw)
    files, path = bgzf.filesystem(f"file:{tmp_path}/x.gz")
    with files.open_input_file(path) as f:
        every = list(bgzf.members(f, len(raw), 0))
        assert b"".join(t for _, t in every) == data
        starts = [a for a, _ in every]
        for at in [*rng.sample(range(len(raw)), 200), *starts, *(a + 1 for a in starts)]:
            assert bgzf.first_member(f, len(raw), at) == min((a for a in starts if a >= at), default=len(raw))


def records(df):
    return [(r.number, r.id, r.seq) for r in df.orderBy(*fasta.PLACE).collect()]


@pytest.mark.parametrize(("kind", "size", "member"), [("fasta", 300, 90), ("fasta", 5000, 0xFF00), ("fastq", 700, 200)])
def test_reads_as_plain(spark, tmp_path, monkeypatch, kind, size, member):
    rng = random.Random(size)
    out = ["junk\n" if kind == "fasta" else ""]
    for i in range(200):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([1, 7, 60, 400])))
        out.append(f">r{i} é c\r\n{seq[:50]}\n{seq[50:]}\n" if kind == "fasta" else f"@r{i} é\n{seq}\n+\n{'@' * len(seq)}\n")
    text = "".join(out).encode()
    (tmp_path / "plain.txt").write_bytes(text)
    (tmp_path / "a b.gz").write_bytes(bgzf.compress(text, member))
    (tmp_path / "one.gz").write_bytes(gzip.compress(text))
    (tmp_path / "none.gz").write_bytes(bgzf.compress(b""))
    read = fasta.read_fasta if kind == "fasta" else fasta.read_fastq
    monkeypatch.setattr(bgzf, "PART", size)
    at = lambda name: f"file://{tmp_path}/{name}"
    want = [x[1:] for x in records(read(spark, at("plain.txt")))]
    df = read(spark, [at("one.gz"), at("a b.gz"), at("none.gz"), at("plain.txt"), at("a b.gz")])
    assert records(df) == [(n, *x) for n in (0, 1, 3, 4) for x in want] and len(want) == 200
    blocks = read(spark, at("a b.gz"))
    assert records(blocks) == [(0, *x) for x in want]
    if member < size:
        assert len({r.part for r in blocks.collect()}) > 5


def test_long_record_and_broken_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bgzf, "PART", 1000)
    seq = "".join(random.Random(3).choices("ACGT", k=400_000))
    (tmp_path / "x.fa.gz").write_bytes(bgzf.compress(f">a\nAC\n>long\n{seq}\n>b\nGT".encode(), 5000))
    assert records(fasta.read_fasta(spark, f"file://{tmp_path}/x.fa.gz")) == [(0, "a", "AC"), (0, "long", seq), (0, "b", "GT")]
    (tmp_path / "y.fa.gz").write_bytes((tmp_path / "x.fa.gz").read_bytes()[:-1000])
    with pytest.raises(Exception, match="no whole member|no member begins"):
        records(fasta.read_fasta(spark, f"file://{tmp_path}/y.fa.gz"))


def test_written(spark, tmp_path):
    df = spark.createDataFrame([(f"line {i} é" if i % 50 else None,) for i in range(20000)], "value string").repartition(3)
    bgzf.write_lines(df, f"{tmp_path}/out", ("value",))  # a path without a scheme
    files = sorted((tmp_path / "out").iterdir())
    assert all(bgzf.member_size(f.read_bytes()[:100]) for f in files)
    got = b"".join(gzip.decompress(f.read_bytes()) for f in files).decode().splitlines()
    assert got == sorted(f"line {i} é" for i in range(20000) if i % 50)
