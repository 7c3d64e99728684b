"""Count databases that the tests write by the published layout, and those that the library writes."""

import random
import struct

import pytest

from kmerspark.functions import codec
from kmerspark.jobs import cli
from kmerspark.sources import countdb, mer


def signed(c):
    return c - (1 << 64) if c >> 63 else c


def plain(path, k, prefix, counter, bins, version, least=1, most=10**9, both=False, signature=5):
    """bins: a dict of code to count for each, written byte by byte."""
    rest, suffixes, starts, n = k - prefix, b"", [], 0
    for b in bins:
        for p in range(4**prefix):
            starts.append(n)
            for c in sorted(x for x in b if x >> 2 * rest == p):
                suffixes += (c & (4**rest - 1)).to_bytes(rest // 4, "big") + b[c].to_bytes(counter, "little")
                n += 1
    starts.append(n + 1)  # what stands there is not to be relied on
    lut = struct.pack(f"<{len(starts)}Q", *starts)
    if version == 0:
        head = struct.pack("<IIIII", k, 0, counter, prefix, least) + struct.pack("<I", most & 0xFFFFFFFF) + struct.pack("<QB", n, not both) + struct.pack("<I", most >> 32) + bytes(23)
        sigs, code = b"", 0
    else:
        head = struct.pack("<IIIIIII", k, 0, counter, prefix, signature, least, most) + struct.pack("<QB", n, not both) + bytes(27)
        sigs, code = b"".join(struct.pack("<I", random.randrange(len(bins))) for _ in range(4**signature + 1)), 0x200
    head += struct.pack("<I", code)
    with open(f"{path}.kmc_pre", "wb") as f:
        f.write(b"KMCP" + lut + sigs + head + struct.pack("<I", len(head)) + b"KMCP")
    with open(f"{path}.kmc_suf", "wb") as f:
        f.write(b"KMCS" + suffixes + b"KMCS")


def counted(k, n, seed, top=300):
    rng = random.Random(seed)
    first = [rng.randrange(4**k) for _ in range(n)] + [0, 4**k - 1]
    return {c: rng.randrange(1, top) for c in first + [x ^ 1 for x in first[: n // 2]]}


@pytest.mark.parametrize(("k", "prefix", "counter", "version", "bins"), [(11, 3, 2, 0, 1), (11, 3, 2, 2, 5), (32, 4, 4, 2, 3), (9, 5, 0, 0, 1), (7, 7, 2, 2, 2), (5, 1, 3, 0, 1)])
def test_published_layout(spark, tmp_path, k, prefix, counter, version, bins):
    every = counted(k, 200, k)
    if not counter:
        every = dict.fromkeys(every, 1)
    split = [{c: n for c, n in every.items() if hash(c) % bins == b} for b in range(bins)]
    plain(tmp_path / "db", k, prefix, counter, split if counter else [dict.fromkeys(every, 0)], version, most=250, both=True)
    expect = {signed(c): n for c, n in every.items() if n <= 250}
    for size in (7, 1 << 20):
        got = countdb.read_counts(spark, f"file://{tmp_path}", size=size)
        rows = got.collect()
        assert {(r.code, r.cnt) for r in rows} == set(expect.items()) and len(rows) == len(expect)
    if counter:
        assert {(r.code, r.cnt) for r in countdb.read_counts(spark, f"file://{tmp_path}/db", 20, 90).collect()} == {x for x in expect.items() if 20 <= x[1] <= 90}
    info = countdb.count_db_info(spark, f"file://{tmp_path}/db.kmc_pre").first()
    assert (info.k, info.version, info.kmers, info.both_strands, info.max_count, info.entries) == (k, version, len(every), True, 250, 4**prefix * bins)


def test_table_of_prefixes_in_slices(tmp_path, monkeypatch):
    """Slices end within runs of one prefix and within runs of empty ones."""
    every = {**counted(10, 30, 1), **dict.fromkeys(range(5000, 5200), 3)}
    plain(tmp_path / "db", 10, 6, 2, [every], 0)
    for slice_ in (1, 3, 64, 5000):
        monkeypatch.setattr(countdb, "ENTRIES", slice_)
        for size in (1, 13, 10**6):
            reader = countdb.CountDbReader(f"file://{tmp_path}", size, 0, 10**9)
            got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            assert got == sorted(every.items())


def test_broken(spark, tmp_path):
    plain(tmp_path / "db", 8, 4, 1, [{1: 1, 77: 2}], 0)
    whole = (tmp_path / "db.kmc_suf").read_bytes()
    (tmp_path / "db.kmc_suf").write_bytes(whole[:-2])
    with pytest.raises(ValueError, match="2 records"):
        countdb.databases(f"file://{tmp_path}")
    pre = (tmp_path / "db.kmc_pre").read_bytes()
    (tmp_path / "db.kmc_pre").write_bytes(pre[:-12] + struct.pack("<I", 7) + pre[-8:])
    with pytest.raises(ValueError, match="version 0x7"):
        countdb.databases(f"file://{tmp_path}")
    (tmp_path / "db.kmc_pre").write_bytes(b"junk" + pre[4:])
    with pytest.raises(ValueError, match="not a prefix file"):
        countdb.databases(f"file://{tmp_path}")


@pytest.mark.parametrize(("k", "version"), [(9, 0), (9, 2), (32, 2), (3, 0)])
def test_written(spark, tmp_path, k, version):
    every = {signed(c): n for c, n in counted(k, 500, k).items()}
    df = spark.createDataFrame(list(every.items()), "code long, cnt int").repartition(3)
    at = f"file://{tmp_path}/db"
    countdb.write_counts(df, k, at, version=version, both_strands=True)
    got = countdb.read_counts(spark, at, size=50).collect()
    assert {(r.code, r.cnt) for r in got} == set(every.items()) and len(got) == len(every)
    info = countdb.count_db_info(spark, at)
    assert {(r.k, r.both_strands) for r in info.collect()} == {(k, True)} and info.agg({"kmers": "sum"}).first()[0] == len(every)
    with pytest.raises(ValueError, match="already"):
        countdb.write_counts(df, k, at)
    countdb.write_counts(df.where("cnt < 10"), k, at, overwrite=True)
    assert countdb.read_counts(spark, at).count() == sum(n < 10 for n in every.values())


def test_odd_counts(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "code long, cnt long, file string")  # noqa: E731  the last is of another kind
    countdb.write_counts(make([]), 9, f"file://{tmp_path}/none")
    assert countdb.read_counts(spark, f"file://{tmp_path}/none").count() == 0
    for name, rows in {"large": [(1, 256, "")], "twice": [(1, 2, ""), (1, 3, "")], "zero": [(1, 0, "")]}.items():
        with pytest.raises(Exception, match="counts from|k-mers repeat"):
            countdb.write_counts(make(rows), 9, f"file://{tmp_path}/{name}", counter=1)
        assert not countdb.databases(f"file://{tmp_path}/{name}")


def test_convert(spark, tmp_path):
    every = counted(9, 100, 4)
    plain(tmp_path / "db", 9, 5, 2, [every], 0)
    cli.main(["convert", "-o", f"file://{tmp_path}/flat", f"file://{tmp_path}/db"], spark)
    got = mer.read_mer(spark, f"file://{tmp_path}/flat").orderBy("file", "pos").collect()
    assert [r.code for r in got] == sorted(every) and {r.k for r in got} == {9}
    assert codec.MAX_K == 32


def test_no_flat_kmers(spark, tmp_path):
    mer.write_mer(spark.createDataFrame([], "code long"), 9, f"file://{tmp_path}/flat")
    assert mer.read_mer(spark, f"file://{tmp_path}/flat").count() == 0
