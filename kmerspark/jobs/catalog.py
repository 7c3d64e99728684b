"""The registered queries over the given tables, each with its SQL oracle.

Sequences are whole texts as bases (sources/tables.py).  ``D`` in a query's SQL
stands for those of the documents and ``C`` for those of the conversations'
turns; ``windows`` and the other helpers below write the common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerspark.functions import codec, table
from kmerspark.operators import bits, brc, chains, compress, counting, edgebits, flags, graph, index, lookup, minimizers, sets, stats, unitigs, wide
from kmerspark.operators.windows import kmer_codes, kmer_strings
from kmerspark.scratch import materialize, scratch_path
from kmerspark.sources import bam, bgzf, countdb, fasta, mer, sam, tables
from kmerspark.streaming import table as count_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Bases of a k-mer in dense and in sparse graphs; edges have one more.
K, LONG = 8, 14
KP, LONGP = K + 1, LONG + 1

_BASES = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z \n]', '#', 'g'), '{tables.LETTERS}', '{tables.AS_BASES}')"
_SEQS = f"""D AS (SELECT doc_id AS seq_id, lang, source, {_BASES} AS seq FROM documents),
C AS (SELECT conv_id * 1000 + turn AS seq_id, role, {_BASES} AS seq FROM conversations),
B AS (SELECT item_id AS seq_id, {_BASES} AS seq FROM benchmark)"""


def windows(name: str, table: str, k: int) -> str:
    """CTE: (seq_id, pos, kmer) of the clean windows."""
    return f"""{name} AS (SELECT seq_id, pos, kmer FROM (SELECT seq_id, i AS pos, substr(seq, i + 1, {k}) AS kmer
  FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - {k - 1}, 0))) AS i FROM {table})) WHERE regexp_full_match(kmer, '[ACGT]+'))"""


def edges(name: str, w: str) -> str:
    return f"{name} AS (SELECT DISTINCT kmer FROM {w})"


def branching(name: str, e: str, k: int, side: str) -> str:
    """CTE: edges of e whose k first (left) or last (right) bases occur in more than one."""
    return f"{name} AS (SELECT kmer FROM (SELECT kmer, count(*) OVER (PARTITION BY {side}(kmer, {k})) AS n FROM {e}) WHERE n > 1)"


def pieces(name: str, table: str, least: int) -> str:
    """CTE: (seq_id, id, start, len, good, piece): stretches of at least so many bases, and what is between."""
    return f"""{name} AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY p) - 1 AS id, st AS start, length(piece) AS len, p % 2 = 1 AS good, piece FROM
  (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY seq_id ORDER BY p) - length(piece) AS BIGINT) AS st FROM
    (SELECT seq_id, generate_subscripts(a, 1) - 1 AS p, unnest(a) AS piece FROM (SELECT seq_id, string_split(regexp_replace(seq, '([ACGT]{{{least},}})', '|\\1|', 'g'), '|') AS a FROM {table})))
  WHERE piece <> '' UNION ALL SELECT seq_id, 0, 0, 0, false, '' FROM {table} WHERE seq = '')"""


def code(kmer: str) -> str:
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({kmer}, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT))), lambda a, b: a * 4 + b)"


def sql(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join([_SEQS, *ctes])} {body}"


def register(oracle: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return keep


def _graph_rows(spark: SparkSession, sf: str, k: int = 9) -> DataFrame:
    """Edges of the conversations' graph, for what reads repeated rows as one."""
    return graph.edge_rows(tables.conversations(spark, sf), k)


def _conv_edges(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return kmer_codes(tables.conversations(spark, sf), k).select("code")


_W, _E = windows("w", "C", KP), edges("e", "w")
_O, _I = branching("o", "e", K, "left"), branching("i", "e", K, "right")
_GRAPH = [_W, _E, _O, _I]
_WD, _ED = windows("w", "D", LONGP), edges("e", "w")
_OD, _ID = branching("o", "e", LONG, "left"), branching("i", "e", LONG, "right")

# ---- counting ----


@register(sql([windows("w", "D", 12)], "SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer"))
def kmer_count(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(counting.count_kmers(tables.documents(spark, sf), 12), 12)


@register(sql([windows("w", "D", 12), "n AS (SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer)"], "SELECT CAST(sum(cnt) AS BIGINT) AS total, count(*) AS distinct_kmers, count(*) FILTER (cnt < 2) AS below, count(*) FILTER (cnt > 50) AS above, (SELECT count(*) FROM D) AS sequences FROM n"))
def kmer_totals(spark: SparkSession, sf: str) -> DataFrame:
    return counting.count_totals(tables.documents(spark, sf), 12, 2, 50)


@register(sql([windows("w", "C", 11)], "SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS cnt FROM w GROUP BY 1"))
def kmer_count_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(counting.count_kmers(tables.conversations(spark, sf), 11, canonical=True), 11)


@register(sql([windows("w", "C", 11)], "SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer HAVING count(*) BETWEEN 3 AND 20"))
def kmer_count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(counting.count_kmers(tables.conversations(spark, sf), 11, least=3, most=20), 11)


@register(sql([windows("w", "C", 6)], "SELECT kmer, least(count(*), 255) AS cnt FROM w GROUP BY kmer"))
def kmer_listing(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(counting.count_kmers(tables.conversations(spark, sf), 6, counter_max=255), 6)


@register(sql(["A AS (SELECT seq_id, seq FROM C UNION ALL SELECT seq_id, seq FROM B)", windows("w", "A", 10)], "SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer"))
def kmer_count_multi(spark: SparkSession, sf: str) -> DataFrame:
    both = tables.conversations(spark, sf).select("seq_id", "seq").unionByName(tables.benchmark(spark, sf))
    return counting.with_kmers(counting.count_kmers(both, 10), 10)


@register(sql([windows("w", "C", KP)], "SELECT DISTINCT kmer FROM w"))
def kmer_set(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(counting.count_kmers(tables.conversations(spark, sf), KP).select("code"), KP)


@register(sql([windows("w", "C", 11), "n AS (SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer)"], "SELECT 11 AS k, false AS both_strands, count(*) AS kmers, min(cnt) AS min_count, max(cnt) AS max_count, CAST(sum(cnt) AS BIGINT) AS total FROM n"))
def kmer_db_info(spark: SparkSession, sf: str) -> DataFrame:
    return counting.database_info(counting.count_kmers(tables.conversations(spark, sf), 11), 11, False)


@register(sql([windows("w", "D", 12)], "SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer HAVING count(*) <= 1000"))
def kmer_db_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Through an external counter's database files, with a bound on the counts."""
    path = scratch_path(spark, "countdb")
    countdb.write_counts(counting.count_kmers(tables.documents(spark, sf), 12), 12, path)
    return counting.with_kmers(countdb.read_counts(spark, path, most=1000).select("code", "cnt"), 12)


@register(sql([windows("w", "C", 11)], "SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer"))
def stream_count_table(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of six files, a batch each, into a table that is folded after every fourth batch."""
    source, at = scratch_path(spark, "arriving"), scratch_path(spark, "count-table")
    tables.conversations(spark, sf).select("seq_id", "seq").repartition(6).write.parquet(source)
    stream = spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(count_table.into_table(11, at, every=4)).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return counting.with_kmers(count_table.read_table(spark, at), 11)


# ---- k-mers as values ----


@register(sql([windows("w", "C", 15)], "SELECT seq_id, pos, kmer FROM w"))
def kmer_windows(spark: SparkSession, sf: str) -> DataFrame:
    return kmer_strings(tables.conversations(spark, sf), 15)


@register(sql([windows("w", "C", 15)], "SELECT seq_id, pos, kmer FROM w"))
def kmers_udtf(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the table function of SQL."""
    table.register(spark)
    return spark.sql("SELECT seq_id, k.pos, k.kmer FROM {seqs}, LATERAL kmers(seq, 15) AS k", seqs=tables.conversations(spark, sf))


@register(sql([windows("w", "C", 15)], f"SELECT DISTINCT kmer, {code('kmer')} AS code FROM w"))
def kmer_encode(spark: SparkSession, sf: str) -> DataFrame:
    return kmer_strings(tables.conversations(spark, sf), 15).select("kmer", codec.encode("kmer").alias("code")).distinct()


@register(sql([windows("w", "C", 32)], "SELECT seq_id, pos, kmer FROM w"))
def kmer_decode(spark: SparkSession, sf: str) -> DataFrame:
    return kmer_codes(tables.conversations(spark, sf), 32).select("seq_id", "pos", codec.decode("code", 32).alias("kmer"))


@register(sql([windows("w", "C", 11)], "SELECT DISTINCT kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM w"))
def revcomp(spark: SparkSession, sf: str) -> DataFrame:
    return kmer_strings(tables.conversations(spark, sf), 11).select("kmer").distinct().withColumn("rc", codec.revcomp("kmer"))


@register(sql([windows("w", "C", 11)], "SELECT DISTINCT kmer, right(kmer, 3) || left(kmer, 8) AS to_right, substr(kmer, 3) || left(kmer, 2) AS to_left FROM w"))
def kmer_rotate(spark: SparkSession, sf: str) -> DataFrame:
    return kmer_strings(tables.conversations(spark, sf), 11).select("kmer").distinct().select("kmer", codec.rotate("kmer", 3).alias("to_right"), codec.rotate("kmer", -2).alias("to_left"))


@register(sql([windows("w", "C", 11)], "SELECT DISTINCT kmer, i, CASE WHEN i BETWEEN 0 AND 10 THEN substr(kmer, i + 1, 1) END AS base FROM w, (SELECT unnest([-1, 0, 5, 10, 11]) AS i)"))
def kmer_symbol_at(spark: SparkSession, sf: str) -> DataFrame:
    kmers = kmer_strings(tables.conversations(spark, sf), 11).select("kmer").distinct()
    return kmers.select("kmer", F.explode(F.array(*map(F.lit, (-1, 0, 5, 10, 11)))).alias("i")).withColumn("base", codec.symbol_at("kmer", F.col("i")))


@register(sql([], "SELECT CAST(c AS INTEGER) AS code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c, CASE c WHEN 4 THEN length(regexp_replace(seq, '[ACGTacgt-]', '', 'g')) WHEN 5 THEN length(seq) - length(replace(seq, '-', '')) ELSE length(seq) - length(replace(seq, substr('ACGT', c + 1, 1), '')) END AS n FROM D, (SELECT unnest(range(0, 6)) AS c)) GROUP BY c"))
def base_composition(spark: SparkSession, sf: str) -> DataFrame:
    return stats.base_composition(tables.documents(spark, sf))


# ---- bags and sets: assistants' k-mers against the other roles' ----

_ALL = windows("w", "C", 10)
_A, _T = windows("wa", "(SELECT * FROM C WHERE role = 'assistant')", 10), windows("wt", "(SELECT * FROM C WHERE role IS DISTINCT FROM 'assistant')", 10)


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    seqs = tables.conversations(spark, sf)
    own = F.col("role").eqNullSafe("assistant")
    return kmer_codes(seqs.where(own), 10).select("code"), kmer_codes(seqs.where(~own), 10).select("code")


@register(sql([_ALL], "SELECT kmer FROM w"))
def kmer_sort(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(sets.sort_kmers(_conv_edges(spark, sf, 10)), 10)


@register(sql([_A, _T], "SELECT kmer FROM wa UNION ALL SELECT kmer FROM wt"))
def merge_all(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(sets.merge(_two(spark, sf)), 10)


@register(sql([_A, _T], "SELECT kmer FROM wa UNION SELECT kmer FROM wt"))
def merge_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(sets.merge(_two(spark, sf), distinct=True), 10)


@register(sql([_A, _T], "SELECT kmer FROM wa EXCEPT ALL SELECT kmer FROM wt"))
def compare_rmt(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    return counting.with_kmers(sets.difference(a, b), 10)


@register(sql([_A, _T], "SELECT kmer FROM wt EXCEPT ALL SELECT kmer FROM wa"))
def compare_tmr(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    return counting.with_kmers(sets.difference(b, a), 10)


@register(sql([_A, _T], "SELECT 10 AS k, (SELECT count(*) FROM wa) AS ref, (SELECT count(*) FROM wt) AS tgt, (SELECT count(*) FROM (SELECT kmer FROM wa EXCEPT ALL SELECT kmer FROM wt)) AS rmt, (SELECT count(*) FROM (SELECT kmer FROM wt EXCEPT ALL SELECT kmer FROM wa)) AS tmr"))
def compare_info(spark: SparkSession, sf: str) -> DataFrame:
    return sets.compare_info(*_two(spark, sf), 10)


@register(sql([_A, _T], "SELECT kmer FROM wa INTERSECT SELECT kmer FROM wt"))
def kmer_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(sets.intersection(*_two(spark, sf)), 10)


@register(sql([_ALL], "SELECT count(*) AS n, true AS sorted, CAST(NULL AS BIGINT) AS first_violation FROM w"))
def check_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return sets.check_order(sets.with_positions(_conv_edges(spark, sf, 10)))


@register(sql([_ALL, "p AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS pos FROM w)"], "SELECT (SELECT count(*) FROM w) AS n, min(pos) IS NULL AS sorted, min(pos) AS first_violation FROM (SELECT pos, kmer, lag(kmer) OVER (ORDER BY pos) AS b FROM p) WHERE b >= kmer"))
def check_strict(spark: SparkSession, sf: str) -> DataFrame:
    return sets.check_order(sets.with_positions(_conv_edges(spark, sf, 10)), strict=True)


_P = "p AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS pos FROM e)"


def _file(spark: SparkSession, sf: str) -> DataFrame:
    return sets.with_positions(_graph_rows(spark, sf).distinct())


@register(sql([_W, _E, _P], "SELECT pos, kmer FROM p ORDER BY pos LIMIT 20"))
def view_head(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(sets.view(_file(spark, sf), 20), KP).select("pos", "kmer")


@register(sql([_W, _E, _P], "SELECT pos, kmer FROM p ORDER BY pos DESC LIMIT 20"))
def view_tail(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(sets.view(_file(spark, sf), 20, tail=True), KP).select("pos", "kmer")


@register(sql([_W, _E, _P, windows("bw", "B", KP)], "SELECT b.kmer, pos FROM (SELECT DISTINCT kmer FROM bw) b LEFT JOIN p ON b.kmer = p.kmer"))
def search_exact(spark: SparkSession, sf: str) -> DataFrame:
    probes = kmer_codes(tables.benchmark(spark, sf), KP).select("code").distinct()
    return counting.with_kmers(sets.search(_file(spark, sf), probes), KP)


@register(sql([_W, _E, _P, windows("bw", "B", KP)], "SELECT b.kmer, pos FROM (SELECT DISTINCT kmer FROM bw) b LEFT JOIN p ON b.kmer = p.kmer"))
def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Through an index on disk, of which only files that can hold a probe are read."""
    path = scratch_path(spark, "index")
    index.write_index(_graph_rows(spark, sf).distinct(), path, 1 << 12)
    probes = kmer_codes(tables.benchmark(spark, sf), KP).select("code").distinct()
    return counting.with_kmers(index.search_index(spark, path, probes), KP)


@register(sql([_W, _E, _P, windows("bw", "B", K), "q AS (SELECT kmer, m, s FROM (SELECT DISTINCT kmer FROM bw), (SELECT unnest(['A', 'C', 'G', 'T']) AS m), (SELECT unnest(['pred', 'succ']) AS s))"], "SELECT q.kmer, s AS side, m AS base, pos FROM q LEFT JOIN p ON p.kmer = CASE s WHEN 'pred' THEN m || q.kmer ELSE q.kmer || m END"))
def search_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    probes = kmer_strings(tables.benchmark(spark, sf), K).select("kmer").distinct()
    return sets.search(_file(spark, sf), sets.neighbours(probes, KP)).select("kmer", "side", "base", "pos")


@register(sql([_W, _E], "SELECT kmer FROM e"))
def mer_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Through sorted flat files, read by ranges."""
    path = scratch_path(spark, "mer")
    mer.write_mer(sets.sort_kmers(_graph_rows(spark, sf), distinct=True), KP, path)
    return counting.with_kmers(mer.read_mer(spark, path, 1 << 14).select("code"), KP)


# ---- the graph ----


@register(sql([_WD, _ED, _OD], "SELECT kmer FROM o"))
def split_o(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(graph.multi_out(graph.edge_rows(tables.documents(spark, sf), LONGP), distinct=True), LONGP)


@register(sql([_WD, _ED, _ID], "SELECT kmer FROM i"))
def split_i(spark: SparkSession, sf: str) -> DataFrame:
    return counting.with_kmers(graph.multi_in(graph.edge_rows(tables.documents(spark, sf), LONGP), LONGP, distinct=True), LONGP)


@register(sql([_W, _E], f"SELECT left(kmer, {K}) AS kmer, CAST(bit_or(CAST(1 << (instr('ACGT', right(kmer, 1)) - 1) AS INTEGER)) AS INTEGER) AS mask, count(*) = 1 AS single FROM e GROUP BY 1"))
def successor_mask(spark: SparkSession, sf: str) -> DataFrame:
    masks = graph.successor_masks(_graph_rows(spark, sf))
    return masks.select(codec.decode("kmer", K).alias("kmer"), "mask", (F.bit_count("mask") == 1).alias("single"))


@register(sql([_W, _E], f"SELECT kmer, left(kmer, {K}) AS source, right(kmer, {K}) AS target, left(kmer, 1) AS first FROM e"))
def edge_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    ends = graph.endpoints(_graph_rows(spark, sf).distinct(), KP)
    return ends.select(codec.decode("code", KP).alias("kmer"), codec.decode("source", K).alias("source"), codec.decode("target", K).alias("target"), codec.decode(codec.first_base("code", KP), 1).alias("first"))


@register(sql(_GRAPH, f"SELECT seq_id, pos + {K} AS pos FROM w WHERE kmer IN (SELECT kmer FROM o)"))
def branch_positions(spark: SparkSession, sf: str) -> DataFrame:
    edges_, seqs = _graph_rows(spark, sf), tables.conversations(spark, sf)
    return graph.branch_positions(seqs, graph.multi_out(edges_, distinct=True), KP).select("seq_id", "pos")


def _both(edges_: DataFrame, kp1: int) -> DataFrame:
    return sets.merge([graph.multi_out(edges_, distinct=True), graph.multi_in(edges_, kp1, distinct=True)], distinct=True)


@register(sql(_GRAPH, f"SELECT seq_id, pos + {K} AS pos FROM w WHERE kmer IN (SELECT kmer FROM o UNION SELECT kmer FROM i)"))
def unitig_cuts(spark: SparkSession, sf: str) -> DataFrame:
    edges_, seqs = _graph_rows(spark, sf), tables.conversations(spark, sf)
    return graph.branch_positions(seqs, _both(edges_, KP), KP).select("seq_id", "pos")


_FLAG = f"SELECT seq_id, c.p, CASE WHEN o.kmer IS NULL THEN substr(seq, c.p + 1, 1) ELSE CAST(instr('ACGT', substr(seq, c.p + 1, 1)) - 1 AS VARCHAR) END AS x FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS p FROM C) c LEFT JOIN o ON c.p >= {K} AND o.kmer = substr(seq, c.p - {K} + 1, {KP})"


@register(sql([*_GRAPH, f"f AS ({_FLAG})"], "SELECT C.seq_id, coalesce(string_agg(x, '' ORDER BY p), '') AS flagged FROM C LEFT JOIN f ON C.seq_id = f.seq_id GROUP BY C.seq_id"))
def okmerflag(spark: SparkSession, sf: str) -> DataFrame:
    edges_, seqs = _graph_rows(spark, sf), tables.conversations(spark, sf)
    return flags.flag_branches(seqs, graph.multi_out(edges_, distinct=True), KP).select("seq_id", "flagged")


# ---- branch-only encoding ----


@register(sql([pieces("sg", "D", LONGP)], "SELECT seq_id, id AS brc_id, len, start, CASE WHEN good THEN 'good' ELSE 'bad' END AS type FROM sg"))
def brc_segments(spark: SparkSession, sf: str) -> DataFrame:
    return brc.segments(tables.documents(spark, sf), LONGP).select("seq_id", "brc_id", "len", "start", "type")


def _walk_sql(table: str, ctes: list[str], kp1: int, item: str, columns: str, where: str = "") -> str:
    k = kp1 - 1
    # a good piece has clean windows only, so they are made from the piece itself
    own = f"SELECT seq_id, id, i AS pos, substr(piece, i + 1, {kp1}) AS kmer FROM (SELECT seq_id, id, piece, unnest(range(0, len - {k})) AS i FROM sg WHERE good)"
    body = f"bd AS (SELECT seq_id, id, string_agg({item}, '' ORDER BY pos) AS s FROM ({own}) WHERE kmer IN (SELECT kmer FROM o) GROUP BY 1, 2)"
    rec = f"r AS (SELECT sg.seq_id, sg.id AS brc_id, len, start, CASE WHEN good THEN 'good' ELSE 'bad' END AS type, CASE WHEN good THEN left(piece, {k}) || coalesce(s, '') ELSE piece END AS brc FROM sg LEFT JOIN bd ON bd.seq_id = sg.seq_id AND bd.id = sg.id)"
    return sql([*ctes, pieces("sg", table, kp1), body, rec], f"SELECT {columns} FROM r {where}")


_RECORD = "seq_id, brc_id, len, start, type, brc"
_FIELDS = _RECORD.split(", ")
_DOCS = [_WD, _ED, _OD]


def _walk_conv(spark: SparkSession, sf: str, **kw) -> DataFrame:
    seqs = tables.conversations(spark, sf).select("seq_id", "seq")
    return brc.walk(seqs, graph.branch_set(seqs, KP), KP, **kw)


def _walk_docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    seqs = tables.documents(spark, sf).select("seq_id", "seq")
    edges_ = edgebits.of_sequences(seqs, LONGP)
    return brc.walk(seqs, edgebits.several(edges_, LONGP), LONGP), edges_


@register(_walk_sql("D", _DOCS, LONGP, "right(kmer, 1)", _RECORD))
def brc_walk(spark: SparkSession, sf: str) -> DataFrame:
    return _walk_docs(spark, sf)[0].select(*_FIELDS)


@register(_walk_sql("D", _DOCS, LONGP, "right(kmer, 1)", _RECORD))
def brc_walk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """By blocks that are shorter than most documents, whose records go on over several."""
    seqs = tables.documents(spark, sf)
    return brc.walk_blocks(seqs, graph.branch_set(seqs, LONGP), LONGP, size=1 << 10).select(*_FIELDS)


@register(_walk_sql("C", _GRAPH, KP, "kmer", _RECORD))
def brc_walk_kmer(spark: SparkSession, sf: str) -> DataFrame:
    return _walk_conv(spark, sf, kmer_format=True).select(*_FIELDS)


@register(_walk_sql("C", _GRAPH, KP, "right(kmer, 1)", _RECORD, "WHERE type = 'good'"))
def brc_pass_n(spark: SparkSession, sf: str) -> DataFrame:
    return _walk_conv(spark, sf, pass_special=True).select(*_FIELDS)


@register(_walk_sql("C", _GRAPH, KP, "right(kmer, 1)", "seq_id, brc_id, '>' || brc_id || '|' || len || '|' || start || '|' || type || '|' || seq_id || chr(10) || brc || chr(10) AS record"))
def brc_text(spark: SparkSession, sf: str) -> DataFrame:
    return brc.to_text(_walk_conv(spark, sf)).select("seq_id", "brc_id", "record")


@register(_walk_sql("C", _GRAPH, KP, "right(kmer, 1)", "CAST(seq_id AS VARCHAR) AS name, brc_id, len, start, type, brc"))
def brc_parse(spark: SparkSession, sf: str) -> DataFrame:
    return brc.from_text(brc.to_text(_walk_conv(spark, sf)).select("record")).select("name", "brc_id", "len", "start", "type", "brc")


@register(sql([], "SELECT seq_id, seq FROM D"))
def restore_seq(spark: SparkSession, sf: str) -> DataFrame:
    records, edges_ = _walk_docs(spark, sf)
    return brc.restore(records, edges_, LONGP).select("seq_id", "seq")


@register(sql([], "SELECT seq_id, seq FROM C"))
def restore_seq_kmer(spark: SparkSession, sf: str) -> DataFrame:
    return brc.restore(_walk_conv(spark, sf, kmer_format=True), edgebits.of_sequences(tables.conversations(spark, sf), KP), KP, kmer_format=True).select("seq_id", "seq")


@register(sql([], "SELECT seq_id, seq FROM C"))
def restore_seq_io(spark: SparkSession, sf: str) -> DataFrame:
    """With the set of both kinds of branch edges, which needs them again to be read."""
    edges_, seqs = _graph_rows(spark, sf), tables.conversations(spark, sf)
    both = materialize(_both(edges_, KP), "branches")
    return brc.restore(brc.walk(seqs, both, KP), edges_, KP, branch_set=both).select("seq_id", "seq")


@register(sql([], "SELECT seq_id, seq FROM C"))
def restore_seq_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The way for graphs of any size: groups of sequences, each with its own edges."""
    numbered = tables.conversations(spark, sf).withColumn("row", F.monotonically_increasing_id())
    seqs = materialize(brc.with_groups(materialize(numbered, "numbered"), 1 << 18), "groups")
    branches = materialize(graph.multi_out(graph.edge_rows(seqs, KP), distinct=True), "branches")
    edges_ = materialize(brc.group_edges(seqs, branches, KP), "group-edges")
    return brc.restore_by_group(brc.walk(seqs, branches, KP), edges_, KP).select("seq_id", "seq")


@register(sql([], "SELECT seq_id, seq FROM C"))
def restore_chains(spark: SparkSession, sf: str) -> DataFrame:
    """From records and the graph alone, in rounds of joins, with nodes of 21 bases."""
    seqs = tables.conversations(spark, sf)
    masks = materialize(graph.successor_masks(graph.edge_rows(seqs, 22)), "edges", "zstd")
    return chains.restore_chains(brc.walk(seqs, graph.branches_of_masks(masks), 22), masks, 22).select("seq_id", "seq")


@register(sql([], "SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM C"))
def fasta_parse(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    fasta.write_fasta(tables.conversations(spark, sf).select(F.concat(F.col("seq_id").cast("string"), F.lit(" from a conversation")).alias("name"), "seq"), path)
    return fasta.read_fasta(spark, path).select("name", "seq")


@register(sql([], "SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM D"))
def fasta_bgzf(spark: SparkSession, sf: str) -> DataFrame:
    """Through block gzip, which is read by ranges of bytes."""
    path = scratch_path(spark, "bgzf")
    bgzf.write_lines(fasta.fasta_text(tables.documents(spark, sf).withColumn("name", F.col("seq_id").cast("string"))), path)
    return fasta.read_fasta(spark, path).select("name", "seq")


@register(sql([], "SELECT '>' || seq_id || chr(10) || seq AS record FROM C"))
def restore_fasta(spark: SparkSession, sf: str) -> DataFrame:
    seqs = restore_seq_kmer(spark, sf).select(F.col("seq_id").cast("string").alias("name"), "seq")
    return seqs.select(fasta.fasta_record("name", "seq").alias("record"))


_NAMED = "'turn ' || seq_id % 7 || ' of|' || coalesce(role, '')"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Turns under names that repeat and hold bars and blanks."""
    name = F.concat(F.lit("turn "), (F.col("seq_id") % 7).cast("string"), F.lit(" of|"), F.coalesce("role", F.lit("")))
    return tables.conversations(spark, sf).select("seq_id", name.alias("name"), "seq")


def _walk_named(spark: SparkSession, sf: str) -> DataFrame:
    return brc.walk(_named(spark, sf), graph.multi_out(_graph_rows(spark, sf), distinct=True), KP)


@register(_walk_sql("C", _GRAPH, KP, "right(kmer, 1)", f"seq_id, brc_id, '>' || brc_id || '|' || len || '|' || start || '|' || type || '|' || {_NAMED} || chr(10) || brc || chr(10) AS record").replace(" FROM r ", " FROM r JOIN C USING (seq_id) "))
def brc_text_named(spark: SparkSession, sf: str) -> DataFrame:
    return brc.to_text(_walk_named(spark, sf)).select("seq_id", "brc_id", "record")


@register(sql([], f"SELECT row_number() OVER (ORDER BY seq_id) AS n, '>' || {_NAMED} || chr(10) || seq AS record FROM C"))
def restore_fasta_named(spark: SparkSession, sf: str) -> DataFrame:
    """Through .brc text files in the order of the turns, and back to FASTA records in that order."""
    path = scratch_path(spark, "brc")
    brc.write_text(_walk_named(spark, sf), path, ["seq_id"])
    back = brc.restore(brc.read_text(spark, path), _graph_rows(spark, sf), KP)
    return back.select(F.col("row").alias("n"), fasta.fasta_record("name", "seq").alias("record"))


@register(sql([], f"SELECT page_id AS n, translate({_BASES.replace('text', 'html')}, '#', '>') AS seq FROM pages"))
def brc_file_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Pages through .brc text files, with specials that look like the start of a header."""
    seqs = tables.pages(spark, sf).withColumn("seq", F.translate("seq", "#", ">"))
    edges_, path = edgebits.of_sequences(seqs, KP), scratch_path(spark, "brc")
    brc.write_text(brc.walk(seqs, edgebits.several(edges_, KP), KP), path, ["seq_id"])
    return brc.restore(brc.read_text(spark, path), edges_, KP).select(F.col("name").cast("long").alias("n"), "seq")


@register(sql([], f"SELECT 'turn' AS name, substr({_NAMED}, 6) AS comment, seq FROM C WHERE seq <> ''"))
def fastq_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Through FASTQ files whose qualities begin with "@" and "+" as they come."""
    path = scratch_path(spark, "fastq")
    quality = F.translate("seq", "ACGTN", "@+I>#")
    _named(spark, sf).where("seq <> ''").select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), F.regexp_replace(quality, r"[^@+I>#]", "!"))).write.text(path)
    return fasta.read_fastq(spark, path).select("name", "comment", "seq")


@register(sql([], "SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM D"))
def fastq_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Through FASTQ files of 60 characters a line, whose quality lines begin with "@" and "+" as they come."""
    path = scratch_path(spark, "fastq-wrapped")
    wrap = lambda c: F.regexp_replace(c, "(.{60})(?=.)", "$1\n")
    quality = F.regexp_replace(F.translate("seq", "ACGTN", "@+I>#"), r"[^@+I>#]", "!")
    tables.documents(spark, sf).select(F.concat_ws("\n", F.concat(F.lit("@"), "seq_id"), wrap("seq"), F.lit("+"), wrap(quality))).write.text(path)
    return fasta.read_fastq(spark, path, wrapped=True).select("name", "seq")


# ---- unitigs ----

_STRETCH = pieces("sg", "D", 1)
_CUT = f"""cu AS (SELECT sg.seq_id, sg.id, start AS s0, start + len AS e0, pos + {LONG} AS i FROM sg JOIN w ON w.seq_id = sg.seq_id AND pos >= start AND pos < start + len WHERE good AND kmer IN (SELECT kmer FROM o UNION SELECT kmer FROM i)),
s AS (SELECT seq_id, id, s0, e0, s0 AS st FROM (SELECT seq_id, id, start AS s0, start + len AS e0 FROM sg WHERE good) UNION ALL SELECT seq_id, id, s0, e0, i - {LONG} + 1 FROM cu),
x AS (SELECT seq_id, st, coalesce(lead(st) OVER (PARTITION BY seq_id, id ORDER BY st) + {LONG} - 1, e0) AS en FROM s UNION ALL SELECT seq_id, start, start + len FROM sg WHERE NOT good),
u AS (SELECT x.seq_id, row_number() OVER (PARTITION BY x.seq_id ORDER BY st, en) - 1 AS idx, st AS start, substr(seq, st + 1, en - st) AS unitig FROM x JOIN D ON D.seq_id = x.seq_id)"""
_UNITIGS = [_WD, _ED, _OD, _ID, _STRETCH, _CUT]


def _unitigs(spark: SparkSession, sf: str, **kw) -> DataFrame:
    seqs = tables.documents(spark, sf)
    return unitigs.cut_unitigs(seqs.select("seq_id", "seq"), graph.branch_set(seqs, LONGP, into=True), LONGP, **kw)


_PIECE = ["seq_id", "idx", "start", "unitig"]


@register(sql(_UNITIGS, "SELECT seq_id, idx, start, unitig FROM u"))
def unitig_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _unitigs(spark, sf).select(*_PIECE)


@register(sql(_UNITIGS, "SELECT seq_id, idx, start, unitig FROM u"))
def unitig_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """By blocks that are shorter than most documents."""
    seqs = tables.documents(spark, sf)
    return unitigs.cut_unitigs_blocks(seqs.select("seq_id", "seq"), graph.branch_set(seqs, LONGP, into=True), LONGP, size=1 << 10).select(*_PIECE)


_DEDUP = f"""l AS (SELECT *, max(idx) OVER (PARTITION BY seq_id) AS last FROM u),
inn AS (SELECT *, CASE WHEN regexp_full_match(left(unitig, {LONG}), '[ACGT]+') THEN left(unitig, {LONG}) ELSE 'special:' || CASE WHEN substr(unitig, {LONG}, 1) = '-' THEN 'true' ELSE 'false' END END AS key FROM l WHERE idx > 0 AND idx < last AND length(unitig) > {LONG}),
kept AS (SELECT seq_id, idx, start, unitig FROM l WHERE idx = 0 OR idx = last UNION ALL SELECT seq_id, idx, start, unitig FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq_id, idx) AS n FROM inn) WHERE n = 1)"""


@register(sql([*_UNITIGS, _DEDUP], "SELECT seq_id, idx, start, unitig FROM kept"))
def unitig_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return unitigs.dedup_unitigs(_unitigs(spark, sf, inner_over=LONG), LONG).select(*_PIECE)


@register(sql([*_UNITIGS, _DEDUP], "SELECT seq_id, idx, '>' || idx || '|' || start || '|' || seq_id || chr(10) || unitig || chr(10) AS record FROM kept"))
def unitig_text(spark: SparkSession, sf: str) -> DataFrame:
    return unitigs.to_text(unitig_dedup(spark, sf)).select("seq_id", "idx", "record")


_CONV_CUT = _CUT.replace("JOIN D ON D.", "JOIN C ON C.").replace(f"{LONG}", f"{K}")
_UC = [*_GRAPH, pieces("sg", "C", 1), _CONV_CUT]


@register(sql(_UC, f"SELECT seq_id, idx, '>' || idx || '|' || start || '|' || {_NAMED} || chr(10) || unitig || chr(10) AS record FROM u JOIN C USING (seq_id)"))
def unitig_text_named(spark: SparkSession, sf: str) -> DataFrame:
    cut = unitigs.cut_unitigs(_named(spark, sf), _both(_graph_rows(spark, sf), KP), KP)
    return unitigs.to_text(cut).select("seq_id", "idx", "record")


# ---- lookups ----

_COUNTS = [windows("w", "C", 10), "n AS (SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer)", windows("bw", "B", 10)]


@register(sql(_COUNTS, "SELECT b.kmer, coalesce(cnt, 0) AS cnt, cnt IS NOT NULL AS found FROM (SELECT DISTINCT kmer FROM bw) b LEFT JOIN n ON n.kmer = b.kmer"))
def kmer_lookup(spark: SparkSession, sf: str) -> DataFrame:
    probes = kmer_codes(tables.benchmark(spark, sf), 10).select("code").distinct()
    return counting.with_kmers(lookup.lookup(counting.count_kmers(tables.conversations(spark, sf), 10), probes), 10)


def _counters_sql(ctes: list[str], key: str) -> str:
    cells = "x AS (SELECT q.seq_id, i, coalesce(cnt, 0) AS c FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 9, 0))) AS i FROM B) q LEFT JOIN bw ON bw.seq_id = q.seq_id AND bw.pos = i LEFT JOIN n ON n.kmer = " + key + ")"
    return sql([*ctes, cells], "SELECT B.seq_id, greatest(length(any_value(seq)) - 9, 0) AS n, CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) FILTER (c > 0) AS nonzero, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i), '') AS counters FROM B LEFT JOIN x ON x.seq_id = B.seq_id GROUP BY B.seq_id")


@register(_counters_sql(_COUNTS, "bw.kmer"))
def read_counters(spark: SparkSession, sf: str) -> DataFrame:
    out = lookup.read_counters(tables.benchmark(spark, sf), counting.count_kmers(tables.conversations(spark, sf), 10), 10)
    return out.withColumn("counters", F.array_join("counters", ","))


_RC = "least({0}, reverse(translate({0}, 'ACGT', 'TGCA')))"


@register(_counters_sql([windows("w", "C", 10), f"n AS (SELECT {_RC.format('kmer')} AS kmer, count(*) AS cnt FROM w GROUP BY 1)", windows("bw", "B", 10)], _RC.format("bw.kmer")))
def read_counters_canonical(spark: SparkSession, sf: str) -> DataFrame:
    counts = counting.count_kmers(tables.conversations(spark, sf), 10, canonical=True)
    return lookup.read_counters(tables.benchmark(spark, sf), counts, 10, canonical=True).withColumn("counters", F.array_join("counters", ","))


# ---- minimizers ----

_MM = "CASE WHEN regexp_matches({0}, '(TT.|TGT)$|.AA|^ACA') THEN 1024 ELSE " + code("{0}") + " END"
_SIGS = [
    windows("m5", "C", 5),
    f"nm AS (SELECT kmer, least({_MM.format('kmer')}, {_MM.format('rc')}) AS v FROM (SELECT kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM (SELECT DISTINCT kmer FROM m5)))",
    windows("w", "C", 12),
    "sig AS (SELECT w.seq_id, w.pos, min(v) AS signature FROM w JOIN m5 ON m5.seq_id = w.seq_id AND m5.pos BETWEEN w.pos AND w.pos + 7 JOIN nm ON nm.kmer = m5.kmer GROUP BY 1, 2)",
]


@register(sql(_SIGS, "SELECT seq_id, pos, signature FROM sig"))
def mmer_signature(spark: SparkSession, sf: str) -> DataFrame:
    return minimizers.signatures(tables.conversations(spark, sf), 12, 5)


@register(sql([*_SIGS, "g AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, signature ORDER BY pos) AS island FROM sig)"], "SELECT seq_id, min(pos) AS start, count(*) + 11 AS len, signature FROM g GROUP BY seq_id, signature, island"))
def super_kmers(spark: SparkSession, sf: str) -> DataFrame:
    return minimizers.super_kmers(tables.conversations(spark, sf), 12, 5)


# ---- statistics ----

_CODES = [windows("w", "C", 12), f"co AS (SELECT {code('kmer')} AS code FROM (SELECT DISTINCT kmer FROM w))", "de AS (SELECT code - lag(code) OVER (ORDER BY code) AS delta FROM co)", "h AS (SELECT delta AS x, count(*) AS y FROM de WHERE delta IS NOT NULL GROUP BY 1)"]
_TAIL = "t AS (SELECT CAST(greatest(1, CASE WHEN x > 0 THEN floor(log2(x) / 2) + 1 ELSE 1 END) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y FROM h GROUP BY 1)"


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    return _graph_rows(spark, sf, 12).distinct()


@register(sql(_CODES, "SELECT x, y FROM h"))
def delta_hist(spark: SparkSession, sf: str) -> DataFrame:
    return stats.delta_histogram(_codes(spark, sf))


@register(sql([*_CODES, _TAIL], "SELECT x, y FROM t"))
def tail_diff_hist(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tail_histogram(_codes(spark, sf))


@register(sql([*_CODES, _TAIL], """SELECT '{"k":12,"filepath":"conversations","countBaseVar":true,"x":[' || string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) || '],"y":[' || string_agg(CAST(y AS VARCHAR), ',' ORDER BY x) || ']}' AS json FROM t"""))
def hist_json(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram_json(stats.tail_histogram(_codes(spark, sf)), 12, "conversations", True)


@register(sql(_CODES, "SELECT min(code) AS first, max(code) AS last, count(*) AS n, round((max(code) - min(code)) / (count(*) - 1), 4) AS mean_gap FROM co"))
def delta_mean(spark: SparkSession, sf: str) -> DataFrame:
    return stats.delta_mean(_codes(spark, sf))


@register(sql(_CODES, "SELECT CAST(sum(y) + 1 AS BIGINT) AS kmers, CAST(sum(x * y) AS BIGINT) AS cumulative, round(sum(x * y) / sum(y), 2) AS mean, min(x) AS least, max(x) AS most, count(*) AS types FROM h"))
def delta_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram_summary(stats.delta_histogram(_codes(spark, sf)))


_CLUSTERS = [windows("w", "C", 12), "cl AS (SELECT l, left(kmer, l) AS prefix, count(*) AS size FROM (SELECT DISTINCT kmer FROM w), (SELECT CAST(unnest(range(6, 11)) AS INTEGER) AS l) GROUP BY 1, 2)"]


@register(sql(_CLUSTERS, "SELECT l, prefix, size FROM cl"))
def prefix_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.prefix_clusters(_codes(spark, sf), 12)


@register(sql(_CLUSTERS, "SELECT l, size, count(*) AS n FROM cl GROUP BY 1, 2"))
def cluster_size_hist(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cluster_sizes(stats.prefix_clusters(_codes(spark, sf), 12))


@register(sql(_CLUSTERS, "SELECT l, round(quantile_cont(size, 0.2), 4) AS q20, round(quantile_cont(size, 0.5), 4) AS median, round(quantile_cont(size, 0.8), 4) AS q80 FROM cl GROUP BY 1"))
def cluster_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cluster_quantiles(stats.prefix_clusters(_codes(spark, sf), 12))


@register("SELECT CAST(length(text) AS BIGINT) AS length, count(*) AS n FROM documents GROUP BY 1")
def length_hist(spark: SparkSession, sf: str) -> DataFrame:
    return stats.lengths(spark.read.parquet(f"{sf}/documents.parquet"), "text")


# ---- codecs ----

_RUNS = ["ch AS (SELECT seq_id, unnest(range(0, length(seq))) AS p, seq FROM C)", "cc AS (SELECT seq_id, p, substr(seq, p + 1, 1) AS v FROM ch)", "ii AS (SELECT *, p - row_number() OVER (PARTITION BY seq_id, v ORDER BY p) AS g FROM cc)", "r AS (SELECT seq_id AS row, min(p) AS start, v AS value, count(*) AS length FROM ii GROUP BY seq_id, v, g)"]
_DIGITS = "list_transform(list_reverse(string_split(CASE WHEN length < 4 THEN CAST(length AS VARCHAR) WHEN length < 16 THEN (length // 4) || '' || (length % 4) ELSE (length // 16) || '' || (length // 4 % 4) || '' || (length % 4) END, '')), lambda d: CAST(d AS INTEGER) + 256)"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.conversations(spark, sf).select(F.col("seq_id").alias("row"), F.col("seq").alias("s"))


@register(sql(_RUNS, "SELECT row, start, value, length FROM r"))
def rle_runs(spark: SparkSession, sf: str) -> DataFrame:
    return compress.rle_runs(_rows(spark, sf))


@register(sql(_RUNS, f"SELECT row, start, value, length, array_to_string({_DIGITS}, ',') AS digits FROM r"))
def rle_base4(spark: SparkSession, sf: str) -> DataFrame:
    return compress.rle_digits(compress.rle_runs(_rows(spark, sf))).withColumn("digits", F.array_join(F.col("digits").cast("array<string>"), ","))


@register(sql(_RUNS, f"SELECT symbol, count(*) AS n FROM (SELECT unnest(list_append({_DIGITS}, ascii(value))) AS symbol FROM r) GROUP BY 1"))
def huffman_freq(spark: SparkSession, sf: str) -> DataFrame:
    return compress.symbols(compress.rle_runs(_rows(spark, sf)))


_HUFFMAN = f"f AS (SELECT symbol, count(*) AS n FROM (SELECT unnest(list_append({_DIGITS}, ascii(value))) AS symbol FROM r) GROUP BY 1)"
#: Joins the two least weights until one is left; an optimal code's bits are the sum of what was joined.
_JOINED = "m AS (SELECT list_sort(list(n)) AS ws, CAST(0 AS HUGEINT) AS bits FROM f UNION ALL SELECT list_sort(list_append(ws[3:], ws[1] + ws[2])), bits + ws[1] + ws[2] FROM m WHERE len(ws) > 1)"


@register(sql([*_RUNS, _HUFFMAN, _JOINED], "SELECT (SELECT count(*) FROM f) AS symbols, CAST((SELECT sum(n) FROM f) AS BIGINT) AS written, CAST(greatest(max(bits), (SELECT sum(n) FROM f WHERE (SELECT count(*) FROM f) = 1)) AS BIGINT) AS bits FROM m").replace("WITH", "WITH RECURSIVE", 1))
def huffman_bits(spark: SparkSession, sf: str) -> DataFrame:
    return compress.huffman_bits(compress.rle_runs(_rows(spark, sf)))


@register(sql(_RUNS, "SELECT row, start, value, length FROM r"))
def huffman_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Runs as packed bits, in blocks of 256, and back."""
    rows = _rows(spark, sf)
    book = bits.run_code(compress.rle_runs(rows))
    return bits.decode_runs(materialize(bits.encode_runs(rows, book, 256), "bits"), book)


@register(sql([*_RUNS, _HUFFMAN, _JOINED], "SELECT (SELECT count(*) FROM r) AS runs, CAST(greatest(max(bits), (SELECT sum(n) FROM f WHERE (SELECT count(*) FROM f) = 1)) AS BIGINT) AS bits FROM m").replace("WITH", "WITH RECURSIVE", 1))
def huffman_packed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    packed = bits.encode_runs(rows, bits.run_code(compress.rle_runs(rows)))
    return packed.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.coalesce(F.sum("bits"), F.lit(0)).alias("bits"))


def _block(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 32 conversations' texts, in rows of 48 columns, padded with N."""
    seqs = tables.conversations(spark, sf)
    # a late turn's row, or a long text's later one, lies below zero; rows are told apart within their block
    row = F.expr("IF(row >= 0 AND part < 100000, row * 100000 + part, -1 - (pmod(row, 32000) * 1099511627776 + part))")
    block = F.expr("(seq_id - pmod(seq_id, 32000)) DIV 32000")
    return seqs.select(block.alias("block"), F.col("seq_id").alias("row"), F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 48))).alias("part"), "seq").where("length(seq) > 0").select("block", row.alias("row"), F.rpad(F.expr("substring(seq, CAST(part * 48 + 1 AS INT), 48)"), 48, "N").alias("s"))


_PB = "pb AS (SELECT CAST(floor(seq_id / 32000) AS BIGINT) AS block, seq_id * 100000 + part AS row, rpad(substr(seq, part * 48 + 1, 48), 48, 'N') AS s FROM (SELECT seq_id, seq, unnest(range(0, (length(seq) + 47) // 48)) AS part FROM C WHERE length(seq) > 0))"


@register(sql([_PB], "SELECT CAST(col AS INTEGER) AS col, row_number() OVER (PARTITION BY col ORDER BY reverse(left(s, col)), row) - 1 AS rank, row, substr(s, col + 1, 1) AS value FROM pb, (SELECT unnest(range(0, 48)) AS col)"))
def pbwt_wide(spark: SparkSession, sf: str) -> DataFrame:
    """All rows in one block."""
    return wide.pbwt_wide(_block(spark, sf).select("row", "s"), 48)


@register(sql([_PB], "SELECT block, CAST(col AS INTEGER) AS col, CAST(row_number() OVER (PARTITION BY block, col ORDER BY reverse(left(s, col)), row) - 1 AS INTEGER) AS rank, row, substr(s, col + 1, 1) AS value FROM pb, (SELECT unnest(range(0, 48)) AS col)"))
def pbwt_encode(spark: SparkSession, sf: str) -> DataFrame:
    return compress.pbwt_encode(_block(spark, sf), 48)


@register(sql([_PB], "SELECT block, row_number() OVER (PARTITION BY block ORDER BY row) - 1 AS row, s FROM pb"))
def pbwt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return compress.pbwt_decode(compress.pbwt_encode(_block(spark, sf), 48))


@register("SELECT doc_id AS id, CAST(f AS BIGINT) AS frag, string_agg(translate(substr('000102031011121320212223303132330', 1 + 2 * (instr('0123456789ABCDEF', substr(h, p + 1, 1)) - 1), 2), '0123', 'ACGT'), '' ORDER BY p) AS bases FROM (SELECT doc_id, h, p, p // 8192 AS f FROM (SELECT doc_id, h, unnest(range(0, length(h))) AS p FROM (SELECT page_id AS doc_id, hex(encode(html)) AS h FROM pages))) GROUP BY 1, 2")
def bytes_to_bases(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("data"))
    return compress.bytes_to_bases(pages, 4096)


@register("SELECT row, CAST(p AS BIGINT) AS col, CAST(unicode(substr(text, p + 1, 1)) AS BIGINT) AS v FROM (SELECT page_id AS row, html AS text, unnest(range(0, length(html))) AS p FROM pages)")
def qual_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return compress.quality_matrix(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("row"), F.col("html").alias("s")))


@register(sql(["a AS (SELECT seq, CAST(CASE seq_id % 5 WHEN 1 THEN 16 WHEN 2 THEN 256 WHEN 3 THEN 2064 ELSE 0 END AS INTEGER) AS flag FROM D)"], "SELECT count(*) AS seqs, CAST(sum(length(seq)) AS BIGINT) AS bases, count(*) FILTER (flag & 16 <> 0) AS reverse FROM a WHERE flag & 2304 = 0"))
def sam_primary(spark: SparkSession, sf: str) -> DataFrame:
    return sam.totals(sam.read_sam(spark, _sam(spark, sf)))


def _sam(spark: SparkSession, sf: str) -> str:
    """The documents as alignments, of which some are secondary or supplementary; "*" stands for no id and for no bases."""
    path = scratch_path(spark, "sam")
    kind = F.col("seq_id") % 5
    flag = F.when(kind == 1, 16).when(kind == 2, 256).when(kind == 3, 2064).otherwise(0)
    name, seq = F.coalesce(F.col("seq_id").cast("string"), F.lit("*")), F.coalesce(F.nullif("seq", F.lit("")), F.lit("*"))
    line = F.concat_ws("\t", name, flag.cast("string"), F.lit("ref"), F.lit("1"), F.lit("60"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*"))
    tables.documents(spark, sf).select(line).write.text(path)
    return path


def _sam_records(alignments: DataFrame) -> DataFrame:
    """The FASTA records of alignments with a name: the SQL has none for a null id."""
    return sam.sequences(alignments.where("qname <> '*'")).select(fasta.fasta_record("name", "seq").alias("record"))


@register(sql(["a AS (SELECT seq_id, seq FROM D WHERE seq_id % 5 NOT IN (2, 3) AND seq <> '')"], "SELECT '>' || seq_id || chr(10) || seq AS record FROM a"))
def sam_fasta(spark: SparkSession, sf: str) -> DataFrame:
    return _sam_records(sam.read_sam(spark, _sam(spark, sf)))


@register(sql(["a AS (SELECT seq_id, regexp_replace(seq, '[^=ACMGRSVTWYHKDBN]', 'N', 'g') AS seq FROM D WHERE seq_id % 5 NOT IN (2, 3) AND seq <> '')"], "SELECT '>' || seq_id || chr(10) || seq AS record FROM a"))
def bam_fasta(spark: SparkSession, sf: str) -> DataFrame:
    """The same through BAM files, which have no code for other letters."""
    path = scratch_path(spark, "bam")
    bam.write_bam(sam.read_sam(spark, _sam(spark, sf)), path, ["ref"])
    return _sam_records(bam.read_bam(spark, path))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
