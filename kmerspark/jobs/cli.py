"""Command line over the operators: k-mer tables are Parquet (code), sequences FASTA or FASTQ.

Records keep their names and their order through text files: walk, unitig and
flag write text in the order of the input, and restore brings the input back.

    python -m kmerspark.jobs.cli count -k 21 -o counts.parquet a.fa.gz b.fa
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerspark.functions import codec
from kmerspark.operators import brc, chains, counting, flags, graph, index, sets, unitigs
from kmerspark.sources import countdb, fasta, mer

#: Names of files that are read as FASTQ.
FASTQ = (".fq", ".fastq")


#: Records of several files are ordered by these.
ORDER = fasta.PLACE


def _seqs(spark: SparkSession, paths: Sequence[str], wrapped: bool = False) -> DataFrame:
    """(number, file, part, at, seq_id, name, seq): the id of a record is its place among all inputs in their order, and its name the record's."""
    kinds = [[(i, p) for i, p in enumerate(paths) if p.removesuffix(".gz").endswith(FASTQ) == own] for own in (False, True)]
    readers = fasta.read_fasta, partial(fasta.read_fastq, wrapped=wrapped)
    read = [f(spark, [x for _, x in p], [i for i, _ in p]) for f, p in zip(readers, kinds, strict=True) if p]
    rows = reduce(DataFrame.unionByName, read)
    return rows.select(*ORDER, F.struct(*ORDER).alias("seq_id"), F.col("id").alias("name"), "seq")


#: Characters of a sequence from which on it is cut into blocks.
LONG = 1 << 24


def _by_blocks(seqs: DataFrame) -> bool:
    """Whether there is a sequence that one task should not do alone."""
    return not seqs.where(F.length("seq") >= LONG).isEmpty()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, inputs: str | None = None) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        known = {
            "k": lambda: p.add_argument("-k", type=int, required=True, help="bases of a k-mer (of an edge, for graph commands)"),
            "out": lambda: p.add_argument("-o", "--out", required=True),
            "set": lambda: p.add_argument("-s", "--set", required=True, help="Parquet table of branch edges"),
            "edges": lambda: p.add_argument("-e", "--edges", required=True, help="Parquet table of edges"),
            "canonical": lambda: p.add_argument("--canonical", action="store_true"),
            "distinct": lambda: p.add_argument("-d", "--distinct", action="store_true"),
            "kmer": lambda: p.add_argument("--kmer-format", action="store_true"),
            "pass": lambda: p.add_argument("--pass-special", action="store_true"),
            "tail": lambda: p.add_argument("-t", "--tail", action="store_true"),
            "header": lambda: p.add_argument("--header", action="store_true", help="only k and the number of k-mers"),
            "io": lambda: p.add_argument("-s", "--set", help="the branch edges that the records were written with, if these are not the multi-out edges alone"),
            "indexed": lambda: p.add_argument("--indexed", action="store_true", help="the input is an index, of which only what can hold the k-mer is read"),
            "memory": lambda: p.add_argument("--in-memory", type=int, default=brc.MAX_EDGES, help="k-mers whose successors may pass the driver to all workers; larger graphs are decoded by joins"),
            "rows": lambda: p.add_argument("-n", "--rows", type=int, default=20),
            "mer": lambda: p.add_argument("-m", "--mer", required=True, help="the k-mer to look for"),
            "ref": lambda: (p.add_argument("-r", "--ref", required=True), p.add_argument("-t", "--tgt", required=True)),
        }
        for o in options:
            known[o]()
        if name in ("count", "walk", "unitig", "flag"):
            p.add_argument("--wrapped", action="store_true", help="FASTQ records may take more than four lines")
        if inputs:
            p.add_argument("inputs", nargs=1 if inputs == "one" else inputs)
        return p

    command("count", "k", "out", "canonical", inputs="+")
    command("merge", "out", "distinct", inputs="+")
    command("compare", "k", "ref", "out")
    command("sort", "out", "distinct", inputs="one")
    command("view", "k", "rows", "tail", "header", inputs="one")
    command("check", "distinct", inputs="one")
    command("split", "k", "out", inputs="one")
    command("walk", "k", "set", "out", "kmer", "pass", inputs="+")
    command("restore", "k", "edges", "out", "kmer", "io", "memory", inputs="one")
    command("index", "out", inputs="one")  # a table to a sorted index
    command("search", "mer", "indexed", inputs="one")
    command("unitig", "k", "set", "out", inputs="+")
    command("flag", "k", "set", "out", inputs="+")
    command("convert", "out", inputs="one")  # a count database to .smer files, in its order
    command("counts", "out", inputs="one")  # a count database to a table
    command("import", "out", inputs="one")  # .mer and .smer files to a table
    command("export", "k", "out", inputs="one")  # a table to sorted .smer files
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kmerspark").getOrCreate()
    table = lambda path: spark.read.parquet(path)
    save = lambda df: df.write.mode("errorifexists").parquet(a.out)
    match a.command:
        case "count":
            save(counting.count_kmers(_seqs(spark, a.inputs, a.wrapped), a.k, canonical=a.canonical, spread=True))
        case "merge":
            save(sets.sort_kmers(sets.merge([table(p) for p in a.inputs], a.distinct)))
        case "sort":
            save(sets.sort_kmers(table(a.inputs[0]).select("code"), a.distinct))
        case "compare":
            ref, tgt = table(a.ref), table(a.tgt)
            sets.compare_info(ref, tgt, a.k).write.option("sep", "\t").option("header", True).csv(f"{a.out}/info")
            sets.difference(ref, tgt).write.parquet(f"{a.out}/rmt")
            sets.difference(tgt, ref).write.parquet(f"{a.out}/tmr")
        case "view" if a.header:
            print(f"k\t{a.k}\nn\t{table(a.inputs[0]).count()}")
        case "view":
            rows = sets.view(sets.with_positions(table(a.inputs[0])), a.rows, a.tail)
            rows.select("pos", codec.decode("code", a.k).alias("kmer")).orderBy("pos").show(a.rows, truncate=False)
        case "check":
            sets.check_order(sets.with_positions(table(a.inputs[0])), strict=a.distinct).show()
        case "split":
            edges = table(a.inputs[0])
            graph.multi_out(edges).write.parquet(f"{a.out}/o")
            graph.multi_in(edges, a.k).write.parquet(f"{a.out}/i")
        case "walk":
            seqs = _seqs(spark, a.inputs, a.wrapped)
            walk = brc.walk_blocks if _by_blocks(seqs) else brc.walk
            brc.write_text(walk(seqs, table(a.set), a.k, a.kmer_format, a.pass_special), a.out, ORDER)
        case "restore":
            both = table(a.set) if a.set else None
            edges, records = table(a.edges), brc.read_text(spark, a.inputs[0])
            few = a.in_memory >= edges.select(codec.prefix("code")).distinct().count()
            seqs = (brc.restore if few else chains.restore_chains)(records, edges, a.k, a.kmer_format, both)
            fasta.write_fasta(seqs, a.out, width=0, order=["row"])
        case "index":
            index.write_index(table(a.inputs[0]), a.out)
        case "search" if a.indexed:
            probe = spark.createDataFrame([(a.mer,)], "kmer string").select("kmer", codec.encode("kmer").alias("code"))
            index.search_index(spark, a.inputs[0], probe).show(truncate=False)
        case "search":
            probe = spark.createDataFrame([(a.mer,)], "kmer string").select("kmer", codec.encode("kmer").alias("code"))
            sets.search(sets.with_positions(table(a.inputs[0])), probe).show(truncate=False)
        case "unitig":
            seqs = _seqs(spark, a.inputs, a.wrapped)
            cut = unitigs.cut_unitigs_blocks if _by_blocks(seqs) else unitigs.cut_unitigs
            cut = unitigs.dedup_unitigs(cut(seqs, table(a.set), a.k), a.k - 1)
            unitigs.to_text(cut.orderBy(*ORDER, "idx")).select("record").write.text(a.out)
        case "flag":
            flagged = flags.flag_branches(_seqs(spark, a.inputs, a.wrapped), table(a.set), a.k).withColumnRenamed("flagged", "seq")
            fasta.write_fasta(flagged, a.out, width=0, order=ORDER)
        case "convert":
            ks = {db.k for db in countdb.databases(a.inputs[0])}
            if len(ks) != 1:
                raise SystemExit(f"databases of k = {sorted(ks)}")
            mer.write_mer(countdb.read_counts(spark, a.inputs[0]), ks.pop(), a.out)
        case "counts":
            save(countdb.read_counts(spark, a.inputs[0]).select("code", "cnt"))
        case "import":
            save(mer.read_mer(spark, a.inputs[0]).select("code"))
        case "export":
            mer.write_mer(sets.sort_kmers(table(a.inputs[0]).select("code")), a.k, a.out)


if __name__ == "__main__":
    main()
