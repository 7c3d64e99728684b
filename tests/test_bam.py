"""BAM files that the test writes by the published layout, and those that the library writes."""

import random
import struct

import pytest

from kmerspark.sources import bam, bgzf, entries, sam

CODES = "=ACMGRSVTWYHKDBN"


def record(qname, flag, ref, pos, seq, cigar=(), extra=b""):
    bases = [CODES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(qname) + 1, 60, 4680, len(cigar), flag, len(seq), -1, -1, 0)
    body += qname.encode() + b"\0" + b"".join(struct.pack("<I", x) for x in cigar)
    body += bytes(a << 4 | b for a, b in zip(bases[::2], bases[1::2], strict=True)) + b"\xff" * len(seq) + extra
    return struct.pack("<i", len(body)) + body


def header(refs, text=b"@HD\tVN:1.6\n"):
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 9) for r in refs)


def some_records(seed, n, refs):
    """Some carry whole records inside of a tag, as a reader that begins there would like them."""
    rng, out, want = random.Random(seed), [], []
    for i in range(n):
        seq = "".join(rng.choices(CODES, k=rng.choice([0, 1, 2, 31, 500])))
        row = (f"q{i}", rng.choice([0, 16, 256, 2064]), rng.randrange(-1, len(refs)), rng.choice([0, 1, 10**8]), seq)
        inside = b"".join(record("fake", 0, 0, 5, "ACGT") for _ in range(rng.choice([0, 0, 3, 20])))
        tag = b"XXBC" + struct.pack("<I", len(inside)) + inside + bytes(rng.randrange(9)) if inside else b""
        out.append(record(*row, cigar=[16] * rng.randrange(3), extra=tag))
        want.append((row[0], row[1], refs[row[2]] if row[2] >= 0 else "*", row[3], seq or "*"))
    return b"".join(out), want


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("size", "member"), [(60, 40), (400, 333), (3000, 0xFF00), (1 << 20, 0xFF00)])
def test_any_range(spark, tmp_path, monkeypatch, size, member):
    refs = ["chr1", "chrUn long"]
    body, want = some_records(size, 80, refs)
    (tmp_path / "a.bam").write_bytes(bgzf.compress(header(refs) + body, member))
    (tmp_path / "b.bam").write_bytes(bgzf.compress(header(refs[:1], b"@CO\t" + b"long " * 300)))
    (tmp_path / "a.bam.bai").write_bytes(b"an index")
    monkeypatch.setattr(entries, "PACKED", size)
    assert rows(bam.read_bam(spark, f"file://{tmp_path}")) == sorted(want)


def test_broken(spark, tmp_path):
    body, _ = some_records(1, 30, ["r"])
    (tmp_path / "x.bam").write_bytes(bgzf.compress(header(["r"]) + body[:-9]))
    with pytest.raises(Exception, match="no record at"):
        bam.read_bam(spark, f"file://{tmp_path}/x.bam").collect()
    (tmp_path / "x.bam").write_bytes(bgzf.compress(b"SAM, not BAM"))
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, f"file://{tmp_path}/x.bam").collect()


def test_written(spark, tmp_path):
    given = [("a", 0, "r1", 7, "ACGTN"), ("b", 16, "r2", 0, "acg#é"), ("c", 256, "other", 3, "A"), ("d", 0, None, None, None), (None, None, "r1", 2, "")]
    df = spark.createDataFrame(given, "qname string, flag int, rname string, pos long, seq string")
    bam.write_bam(df, f"{tmp_path}/out", ["r1", "r2"])
    got = bam.read_bam(spark, f"{tmp_path}/out")
    assert rows(got) == sorted([("a", 0, "r1", 7, "ACGTN"), ("b", 16, "r2", 0, "ACGNN"), ("c", 256, "*", 3, "A"), ("d", 0, "*", 0, "*"), ("*", 0, "r1", 2, "*")])
    assert [tuple(r) for r in sam.totals(got).collect()] == [(4, 10, 1)]


def test_looking_for_records_takes_little_memory(tmp_path):
    """Numbers were made for all places of a range at once, some hundred bytes for one of text."""
    import tracemalloc

    import pyarrow as pa

    body = b"".join(record(f"q{i}", 0, -1, 5, "ACGT" * 2000) for i in range(700))
    (tmp_path / "plain").write_bytes(body)
    with pa.OSFile(str(tmp_path / "plain")) as f:
        w = entries.Window(f, len(body), 0, len(body), False)
    tracemalloc.start()
    found = bam._candidates(w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = len(record("q0", 0, -1, 5, "ACGT" * 2000))
    assert {0, size} <= set(found) and len(found) >= 700 and peak < 3 * len(body)
