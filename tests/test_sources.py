"""File sources, streaming and the command line."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from kmerspark.functions import codec
from kmerspark.jobs import catalog, cli
from kmerspark import scratch
from kmerspark.operators import brc, counting, graph, sets
from kmerspark.operators.windows import kmer_codes
from kmerspark.ranks import numbered_within, ranked, salt_of
from kmerspark.sources import fasta, mer, sam, tables
from kmerspark.streaming.counting import streaming_counts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">s1 demo  x\r\nACGT\r\nAC GT\r\n>s2\n>s3|a%b\tc\nNN\n\nAC\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write("\n>z\nTT")
    (tmp_path / "empty.fa").write_text("")
    got = {(r.name, r.comment, r.id, r.seq) for r in fasta.read_fasta(spark, f"file://{tmp_path}/*").collect()}
    assert got == {("s1", "demo  x", "s1 demo  x", "ACGTACGT"), ("s2", None, "s2", ""), ("s3|a%b", "c", "s3|a%b c", "NNAC"), ("z", None, "z", "TT")}
    (tmp_path / "junk").mkdir()
    (tmp_path / "junk" / "c.fa").write_text("junk\nmore\n>q\nA\n")
    assert [r.name for r in fasta.read_fasta(spark, f"file://{tmp_path}/junk").collect()] == ["q"]


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "ACGT" * 50), ("b c", ""), ("d", "N")]
    fasta.write_fasta(spark.createDataFrame(rows, "name string, seq string"), f"file://{tmp_path}/out", 7)
    assert {(r.id, r.seq) for r in fasta.read_fasta(spark, f"file://{tmp_path}/out").collect()} == set(rows)


def test_mer_parts(spark):
    table = spark.createDataFrame([(i, i * 3) for i in range(1000)], "pos long, code long")
    parts = mer.to_parts(table, 9, 300)
    assert sorted(len(r.data) for r in parts.collect()) == [812, 2412, 2412, 2412]
    assert sorted((r.part * 300 + r.place, r.code) for r in mer.from_parts(parts).collect()) == [(i, 3 * i) for i in range(1000)]
    with pytest.raises(Exception, match="declared"):
        mer.from_parts(spark.createDataFrame([(0, b"\x09\0\0\0" + b"\x02" + b"\0" * 7 + b"\0" * 8)], "part long, data binary")).collect()


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nq1\t0\tr\t1\t60\t*\t*\t0\t0\tACGT\t*\nq1\t256\tr\t1\t60\t*\t*\t0\t0\tAC\t*\nq2\t16\tr\t1\t60\t*\t*\t0\t0\tACG\t*\nq3\t2064\tr\t1\t60\t*\t*\t0\t0\tA\t*\n")
    reads = sam.read_sam(spark, f"file://{tmp_path}/x.sam")
    assert tuple(sam.totals(reads).first()) == (2, 7, 1) and {r.qname for r in sam.primary(reads).collect()} == {"q1", "q2"}


def test_sam_without_sequence(spark, tmp_path):
    """An empty SEQ is no sequence, as "*" is none."""
    line = "{}\t{}\tr\t1\t60\t*\t*\t0\t0\t{}\t*\n"
    (tmp_path / "x.sam").write_text("".join(line.format(*r) for r in [("q1", 0, "AC"), ("q2", 0, ""), ("q3", 16, "*"), ("q4", 16, ""), ("q5", 256, "A"), ("q6", 16, "N")]))
    reads = sam.read_sam(spark, f"file://{tmp_path}/x.sam")
    assert {tuple(r) for r in sam.sequences(reads).collect()} == {("q1", "AC"), ("q6", "N")}
    assert tuple(sam.totals(reads).first()) == (5, 3, 3)


def test_sam_fasta_of_odd_rows(spark, tmp_path):
    """As the SQL has them: no record for a text without bases or a row without an id, and the dotted capital I is one letter."""
    rows = [(5, "abz"), (5, "abz"), (6, ""), (9, None), (10, "*"), (11, "\u0130x"), (12, "a"), (13, "a"), (-5, " \n"), (-7, "b"), (-9, ""), (None, "abz"), (None, None)]
    spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([">5\nACC", ">5\nACC", ">10\nN", ">11\nAT", ">-5\nGT", ">-7\nC"])
    assert sorted(r.record for r in catalog.sam_fasta(spark, str(tmp_path)).collect()) == want
    assert sorted(r.record for r in catalog.bam_fasta(spark, str(tmp_path)).collect()) == want
    assert tuple(catalog.sam_primary(spark, str(tmp_path)).first()) == (11, 15, 2)


def test_streaming_counts(spark, tmp_path):
    for i, s in enumerate(["ACGTN", "ACG", "CGTACG"]):
        spark.createDataFrame([(i, s)], "seq_id long, seq string").write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streaming_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("kmers").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    got = {r.kmer: r.cnt for r in counting.with_kmers(spark.table("kmers"), 3).collect()}
    assert got == {"ACG": 3, "CGT": 2, "GTA": 1, "TAC": 1}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">s1 first\nACGTACGANN\nTTACGTAG\n>s1 first\nACGTACGAACGT\n>|odd|\nAC\n")
    at = lambda name: f"file://{tmp_path}/{name}"
    run = lambda *a: cli.main(list(a), spark)
    run("count", "-k", "4", "-o", at("counts"), at("a.fa"))
    run("split", "-k", "4", "-o", at("branches"), at("counts"))
    run("walk", "-k", "4", "-s", at("branches/o"), "-o", at("brc"), at("a.fa"))
    run("restore", "-k", "4", "-e", at("counts"), "-o", at("back"), at("brc"))
    records = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert records("back") == ">s1 first\nACGTACGANNTTACGTAG\n>s1 first\nACGTACGAACGT\n>|odd|\nAC\n"
    assert records("brc").startswith(">0|8|0|good|s1 first\nACGTCA\n\n>1|2|8|bad|s1 first\nNN\n\n")
    run("merge", "-d", "-o", at("io"), at("branches/o"), at("branches/i"))
    run("walk", "-k", "4", "-s", at("io"), "-o", at("brc2"), at("a.fa"))
    for name, most in (("back2", "1000"), ("back3", "2")):  # in memory, and by joins
        run("restore", "-k", "4", "-e", at("counts"), "-s", at("io"), "--in-memory", most, "-o", at(name), at("brc2"))
        assert records(name) == records("back")
    run("unitig", "-k", "4", "-s", at("io"), "-o", at("unitigs"), at("a.fa"))
    run("export", "-k", "4", "-o", at("flat"), at("counts"))
    run("import", "-o", at("again"), at("flat"))
    run("view", "-k", "4", "--header", at("again"))
    run("flag", "-k", "4", "-s", at("branches/o"), "-o", at("flags"), at("a.fa"))
    run("sort", "-o", at("sorted"), at("counts"))
    run("compare", "-k", "4", "-r", at("counts"), "-t", at("io"), "-o", at("info"))
    run("view", "-k", "4", "-n", "2", at("io"))
    run("check", "-d", at("io"))
    run("search", "-m", "GTAC", at("counts"))
    out = capsys.readouterr().out
    assert "AACG" in out and "true" in out and "GTAC" in out and "n\t" in out
    assert sorted(r.code for r in spark.read.parquet(at("again")).collect()) == sorted(r.code for r in spark.read.parquet(at("counts")).collect())
    assert records("unitigs").startswith(">0|0|s1 first\nACG\n\n>1|1|s1 first\nCGTA\n\n") and records("unitigs").endswith(">0|0||odd|\nAC\n\n")
    assert records("flags") == ">s1 first\nACG3A1G0NNTTACG3A2\n>s1 first\nACG3A1G0ACG3\n>|odd|\nAC\n"
    a, b = (spark.read.parquet(at(n)).select("code").distinct() for n in ("counts", "io"))
    assert spark.read.parquet(at("info/rmt")).count() == a.exceptAll(b).count() and spark.read.parquet(at("info/tmr")).count() == b.exceptAll(a).count()


def test_names_and_order_come_back(spark, tmp_path):
    """A restored file is the upper-cased input, record by record, over several files and splits."""
    rng = random.Random(4)
    lines, want = [], []
    for i in range(300):
        name = rng.choice(["same name", f"n{i}", "a|b % c", "x"])
        seq = "".join(rng.choices("ACGTacgtN-", [9] * 8 + [1, 1], k=rng.choice([0, 1, 8, 9, 40, 300])))
        lines.append(f">{name}\n" + "".join(f"{seq[a : a + 60]}\n" for a in range(0, len(seq), 60)))
        want.append(f">{name}\n{seq.upper()}\n")
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.fa").write_text("".join(lines[100 * part : 100 * part + 100]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        run = lambda *a: cli.main(list(a), spark)
        at = lambda name: f"file://{tmp_path}/{name}"
        run("count", "-k", "5", "-o", at("counts"), at("in"))
        run("split", "-k", "5", "-o", at("branches"), at("counts"))
        run("walk", "-k", "5", "-s", at("branches/o"), "-o", at("brc"), at("in"))
        run("restore", "-k", "5", "-e", at("counts"), "-o", at("back"), at("brc"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "".join(p.read_text() for p in sorted((tmp_path / "back").glob("part-*"))) == "".join(want)


def test_fastq(spark, tmp_path):
    text = "junk\n@r1 c\nACGT\n+\n@@II\n@r2\n\n+r2\n\n@r3\nACG\n+\n+I@\n@r4\nA\n+\n@\n"
    (tmp_path / "a.fq").write_text(text.removeprefix("junk\n"))
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    got = sorted((r.name, r.comment, r.seq) for r in fasta.read_fastq(spark, f"file://{tmp_path}/a.fq").collect())
    assert got == [("r1", "c", "ACGT"), ("r2", None, ""), ("r3", None, "ACG"), ("r4", None, "A")]
    for name, wrong in (("c", "@r\nACGT\n+\nII\n"), ("d", "@r\nACGT\nAC\n"), ("e", ">r\nAC\n")):
        (tmp_path / f"{name}.fq").write_text(wrong)
        with pytest.raises(Exception, match="four lines|FASTA"):
            fasta.read_fastq(spark, f"file://{tmp_path}/{name}.fq").collect()
    with pytest.raises(Exception, match="FASTQ"):
        fasta.read_fasta(spark, f"file://{tmp_path}/a.fq").collect()


def test_mer_files(spark, tmp_path):
    rows = spark.range(0, 5000).select((F.col("id") * 3).alias("code")).repartition(3)
    mer.write_mer(sets.sort_kmers(rows), 9, str(tmp_path / "flat"))
    back = mer.read_mer(spark, str(tmp_path / "flat"), 700)
    found = back.orderBy("file", "pos").collect()
    assert back.rdd.getNumPartitions() >= 8 and [r.code for r in found] == [3 * i for i in range(5000)] and {r.k for r in found} == {9}
    (tmp_path / "bad.mer").write_bytes(b"\x09\0\0\0" + b"\x02" + b"\0" * 7 + b"\0" * 8)
    with pytest.raises(Exception, match="declared"):
        mer.read_mer(spark, str(tmp_path / "bad.mer")).collect()


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            applicationId = "x"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_numbering(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(3)], "g string, x long").withColumn("_salt", salt_of("x", salts=8))
    out = numbered_within(df, ["g"], ["x"], "n").collect()
    assert sorted(r.n for r in out if r.g == "a") == list(range(500)) and sorted(r.n for r in out if r.g == "b") == [0, 1, 2]
    got = ranked(df.repartition(5), ["x", "g"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(503)) and [(r.x, r.g) for r in got] == sorted((r.x, r.g) for r in got)


def test_turns_of_long_conversations_stay_apart(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: "".join(rng.choices("abcdefg \n", k=rng.randint(20, 60)))
    rows = [(c, t, "user", text()) for c, n in ((7, 1500), (8, 600), (9, 2)) for t in range(n)]
    rows.append((1 << 31, 1200, "user", text()))
    rows.append((9, 2, "user", "ab" * 700_000))  # more parts than 100,000 of 12 columns
    rows.append((9, 3, "user", text()))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    at, seqs = str(tmp_path), tables.conversations(spark, str(tmp_path))
    ids = [r.seq_id for r in seqs.select("seq_id").collect()]
    assert len(set(ids)) == len(rows) and {7 * 1000 + t for t in range(1000)} | {8 * 1000 + t for t in range(600)} <= set(ids)
    block = catalog._block(spark, at)
    assert block.select("block", "row").distinct().count() == block.count()
    short = seqs.where("length(seq) < 100")
    kmers = kmer_codes(short, 9).select("code").distinct()
    back = brc.restore(brc.walk(short, graph.multi_out(kmers), 9), kmers, 9)
    assert sorted(map(tuple, back.select("seq_id", "seq").collect())) == sorted(map(tuple, short.select("seq_id", "seq").collect()))
    with pytest.raises(Exception, match="no sequence id"):
        spark.range(1).select(tables.turn_id(F.lit(-1), F.lit(0))).collect()


def test_flat_files_are_added_to(spark, tmp_path):
    at, rows = f"file://{tmp_path}/flat", lambda a, b: spark.range(a, b).select(F.col("id").alias("code"))
    read = lambda: [r.code for r in mer.read_mer(spark, at).orderBy("file", "pos").collect()]
    mer.write_mer(rows(0, 100).repartitionByRange(3, "code"), 9, at)
    with pytest.raises(ValueError, match="already"):
        mer.write_mer(rows(1000, 1100), 9, at)
    assert read() == list(range(100))
    mer.write_mer(rows(1000, 1100).repartitionByRange(2, "code"), 9, at, mode="append")
    assert read() == [*range(100), *range(1000, 1100)]
    mer.write_mer(rows(5, 7).coalesce(1), 9, at, mode="overwrite")
    assert read() == [5, 6] and len(list((tmp_path / "flat").iterdir())) == 1 + sum(f.name.endswith(".crc") for f in (tmp_path / "flat").iterdir())


def test_a_failed_commit_leaves_what_was_there(tmp_path):
    at = f"file://{tmp_path}/flat"
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "old.smer").write_bytes(b"old")
    (tmp_path / "flat" / "_a").write_bytes(b"new")
    writer = mer.MerWriter(at, 9, True)
    messages = [mer.Written(f"{tmp_path}/flat/_a", 0), mer.Written(f"{tmp_path}/flat/_gone", 1)]
    with pytest.raises(OSError):
        writer.commit(messages)
    writer.abort(messages)
    assert [f.name for f in (tmp_path / "flat").iterdir()] == ["old.smer"]


def test_bad_segments_hold_any_character(spark, tmp_path):
    """Every printable character, and what looks like a header, comes back from .brc text."""
    odd = ["".join(map(chr, range(33, 127))), ">", ">>1|2|3|good|x", "5|1|0|bad|y", "é>日", ">0|8|0|good|z"]
    seqs = [(i, f"ACGTACCGTA{x}ACGTTACGACC{x}") for i, x in enumerate(odd)] + [(i + len(odd), x) for i, x in enumerate([*odd, "", ">A"])]
    df = spark.createDataFrame(seqs, "seq_id long, seq string")
    edges = kmer_codes(df, 4).select("code").distinct()
    brc.write_text(brc.walk(df, graph.multi_out(edges), 4), f"file://{tmp_path}/brc", ["seq_id"])
    back = brc.restore(brc.read_text(spark, f"file://{tmp_path}/brc"), edges, 4).orderBy("row")
    assert [(r.name, r.seq) for r in back.collect()] == [(str(i), "".join(c.upper() if c.isascii() else c for c in s)) for i, s in seqs]
    # text of others, with one line's end between records
    (tmp_path / "close.brc").write_text(">0|2|0|bad|a\n>A\n>0|0|0|bad|b\n\n>0|2|0|bad|c d\nNN")
    assert [(r.name, r.brc) for r in brc.read_text(spark, f"file://{tmp_path}/close.brc").orderBy("at").collect()] == [("a", ">A"), ("b", ""), ("c d", "NN")]


def test_inputs_keep_the_order_given(spark, tmp_path):
    """Files are read in the order of the arguments, whatever their names and sizes, and one given twice is read twice."""
    (tmp_path / "x.fa").write_text(">x1\nACGTACGA\n>x2\nTTACGTAG\n")
    (tmp_path / "b.fa").write_text(">b1\n" + "ACGTTGCA" * 500 + "\n>b2\nACGTACGA\n")
    (tmp_path / "q.fastq").write_text("@q1\nACGTAC\n+\n@@@@@@\n")
    at = lambda name: f"file://{tmp_path}/{name}"
    run = lambda *a: cli.main(list(a), spark)
    names = ["x.fa", "q.fastq", "b.fa", "x.fa"]
    run("count", "-k", "4", "-o", at("counts"), *map(at, names))
    run("split", "-k", "4", "-o", at("branches"), at("counts"))
    run("walk", "-k", "4", "-s", at("branches/o"), "-o", at("brc"), *map(at, names))
    run("restore", "-k", "4", "-e", at("counts"), "-o", at("back"), at("brc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "back").glob("part-*")))
    assert text == (tmp_path / "x.fa").read_text() + ">q1\nACGTAC\n" + (tmp_path / "b.fa").read_text() + (tmp_path / "x.fa").read_text()
    # a unitig that several files hold is kept where it comes first
    run("merge", "-d", "-o", at("io"), at("branches/o"), at("branches/i"))
    (tmp_path / "z.fa").write_text(">z\n" + "T" * 30 + "GATTACAGATCGATT" + "A" * 40 + "\n" + "C" * 5000 + "\n")
    (tmp_path / "a.fa").write_text(">a\nAAAGATTACAGATCGATTCCC\n")
    spark.createDataFrame([(kmer,) for kmer in ("TGAT", "AGAT", "ATTA", "ATTC")], "kmer string").select(codec.encode("kmer").alias("code")).write.parquet(at("cuts"))
    run("unitig", "-k", "4", "-s", at("cuts"), "-o", at("cut"), at("z.fa"), at("a.fa"))
    cut = "".join(p.read_text() for p in sorted((tmp_path / "cut").glob("part-*")))
    kept = [r.split("\n") for r in cut.strip().split("\n\n")]
    assert [h for h, _ in kept if h.endswith("|z")] and all(int(h[1:].split("|")[0]) in (0, max(int(g[1:].split("|")[0]) for g, _ in kept if g.endswith("|a"))) for h, _ in kept if h.endswith("|a"))


def test_long_sequences_go_by_blocks(spark, tmp_path, monkeypatch):
    """The command line writes the same text whether sequences are cut into blocks or not."""
    rng = random.Random(2)
    text = "".join(f">s{i} x\n{''.join(rng.choices('ACGTacgtN', k=rng.choice([0, 5, 200])))}\n" for i in range(12))
    (tmp_path / "a.fa").write_text(text)
    at = lambda name: f"file://{tmp_path}/{name}"
    run = lambda *a: cli.main(list(a), spark)
    run("count", "-k", "5", "-o", at("counts"), at("a.fa"))
    run("split", "-k", "5", "-o", at("branches"), at("counts"))
    for name, long in (("whole", 1 << 24), ("blocks", 100)):
        monkeypatch.setattr(cli, "LONG", long)
        run("walk", "-k", "5", "-s", at("branches/o"), "-o", at(f"{name}-brc"), at("a.fa"))
        run("unitig", "-k", "5", "-s", at("branches/o"), "-o", at(f"{name}-cut"), at("a.fa"))
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert read("whole-brc") == read("blocks-brc") and read("whole-cut") == read("blocks-cut") and read("whole-brc")
