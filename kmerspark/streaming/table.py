"""A table of k-mer counts that a stream adds to, batch by batch.

A batch's counts become a folder of their own, named by the query and the batch,
so a batch that comes again replaces what it wrote, and nothing of the table is
rewritten for it.  From time to time the folders are folded into a base, which says
up to which batch of each query it holds; batches up to there are not written
again.  A reader takes the newest whole base and the whole batches after it, so it
sees each batch once at any time.

    path/kind/                         k and whether both strands are one
    path/batches/<query>/<batch>/      (code, cnt)
    path/bases/<number>/counts, upto   (code, cnt); (query, batch), written last

One query writes at a time; any number read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerspark.functions.codec import check_k
from kmerspark.operators.counting import count_kmers

COUNTS, UPTO = "code long, cnt long", "query string, batch long"
#: What Spark's writer leaves in a folder once all of it is there.
WHOLE = "_SUCCESS"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    files, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()) if files.exists(at) else []


def _whole(spark: SparkSession, path: str) -> bool:
    files, at = _fs(spark, f"{path}/{WHOLE}")
    return files.exists(at)


def _bases(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _children(spark, f"{path}/bases") if _whole(spark, f"{path}/bases/{n}/upto"))


def _state(spark: SparkSession, path: str) -> tuple[int | None, dict[str, int], list[tuple[str, int]]]:
    """The newest base, the last batch in it of each query, and the whole batches after."""
    base = max(_bases(spark, path), default=None)
    upto = {} if base is None else {r.query: r.batch for r in spark.read.schema(UPTO).parquet(f"{path}/bases/{base}/upto").collect()}  # a row a query
    later = [(q, int(b)) for q in _children(spark, f"{path}/batches") for b in _children(spark, f"{path}/batches/{q}") if int(b) > upto.get(q, -1)]
    return base, upto, [(q, b) for q, b in later if _whole(spark, f"{path}/batches/{q}/{b}")]


def _same_kind(spark: SparkSession, path: str, k: int, canonical: bool) -> None:
    if _whole(spark, f"{path}/kind"):
        found = spark.read.parquet(f"{path}/kind").first()
        if (found.k, found.canonical) != (k, canonical):
            raise ValueError(f"{path} counts k = {found.k}, canonical = {found.canonical}, not k = {k}, canonical = {canonical}")
    else:
        spark.createDataFrame([(k, canonical)], "k int, canonical boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")


def _parts(spark: SparkSession, path: str, base: int | None, later: list[tuple[str, int]]) -> DataFrame:
    folders = [f"{path}/batches/{q}/{b}" for q, b in later] + ([] if base is None else [f"{path}/bases/{base}/counts"])
    rows = spark.read.schema(COUNTS).parquet(*folders) if folders else spark.createDataFrame([], COUNTS)
    return rows.groupBy("code").agg(F.sum("cnt").alias("cnt"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(code, cnt) of all that has been added so far; no table, no rows."""
    base, _, later = _state(spark, path)
    return _parts(spark, path, base, later)


def fold_table(spark: SparkSession, path: str) -> None:
    """The batches folded into a new base.  What only bases before the last one hold is removed, so reads that have begun still end."""
    base, upto, later = _state(spark, path)
    cut = {q: min((int(b) for b in _children(spark, f"{path}/batches/{q}") if int(b) > upto.get(q, -1) and (q, int(b)) not in later), default=None) for q, _ in later}
    later = [(q, b) for q, b in later if cut[q] is None or b < cut[q]]  # not past a batch that is still to come again
    if not later:
        return
    number = 0 if base is None else base + 1
    _parts(spark, path, base, later).write.mode("overwrite").parquet(f"{path}/bases/{number}/counts")
    for q, b in later:
        upto[q] = max(upto.get(q, -1), b)
    spark.createDataFrame(list(upto.items()), UPTO).coalesce(1).write.mode("overwrite").parquet(f"{path}/bases/{number}/upto")
    if base is None:
        return
    before = {r.query: r.batch for r in spark.read.schema(UPTO).parquet(f"{path}/bases/{base}/upto").collect()}
    old = [f"{path}/batches/{q}/{b}" for q in _children(spark, f"{path}/batches") for b in _children(spark, f"{path}/batches/{q}") if int(b) <= before.get(q, -1)]
    for gone in old + [f"{path}/bases/{n}" for n in _bases(spark, path) if n < base]:
        files, at = _fs(spark, gone)
        files.delete(at, True)


def add_batch(seqs: DataFrame, k: int, path: str, query: str, batch: int, canonical: bool = False) -> bool:
    """The counts of seqs(seq) as a query's batch, of which each comes after the ones before it; False where the table's base holds that batch, so that nothing is to be done."""
    spark = seqs.sparkSession
    _same_kind(spark, path, check_k(k), canonical)
    base = max(_bases(spark, path), default=None)
    done = None if base is None else spark.read.schema(UPTO).parquet(f"{path}/bases/{base}/upto").where(F.col("query") == query).agg(F.max("batch")).first()[0]
    if done is not None and batch <= done:
        return False
    count_kmers(seqs, k, canonical, spread=True).select("code", F.col("cnt").cast("long").alias("cnt")).write.mode("overwrite").parquet(f"{path}/batches/{query}/{batch}")
    return True


def into_table(k: int, path: str, canonical: bool = False, every: int = 32) -> Callable[[DataFrame, int], None]:
    """What foreachBatch takes: adds each batch of seqs(seq_id, seq) to the table, and folds after so many of them.

    The query is named by the id that its checkpoint keeps; a stream that starts
    from a new checkpoint is another query, whose batches are added.
    """

    def add(seqs: DataFrame, batch: int) -> None:
        spark = seqs.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if query is None:
            raise RuntimeError("not called by a stream; use add_batch")
        add_batch(seqs, k, path, query, batch, canonical)
        if (batch + 1) % every == 0:
            fold_table(spark, path)

    return add
