"""Run lengths, base-4 digits, Huffman codes, the positional Burrows-Wheeler transform, and bytes as bases."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerspark.functions import codec


def rle_runs(rows: DataFrame) -> DataFrame:
    """(row, start, value, length) of the runs in rows(row, s), found inside the row; a null or empty s has none."""
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                points = np.frombuffer((b.column(1)[i].as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32)
                starts = np.flatnonzero(np.concatenate(([True], points[1:] != points[:-1]))) if len(points) else np.zeros(0, np.int64)
                own = b.column(0).take(pa.array(np.full(len(starts), i)))
                yield pa.RecordBatch.from_arrays([own, pa.array(starts, pa.int64()), pa.array([chr(c) for c in points[starts]], pa.string()), pa.array(np.diff(np.concatenate((starts, [len(points)]))), pa.int64())], ["row", "start", "value", "length"])

    return rows.select("row", "s").mapInArrow(run, f"row {kind}, start long, value string, length long")


def rle_digits(runs: DataFrame) -> DataFrame:
    """runs with digits: the length to base 4, lowest first, each plus 256."""
    return runs.withColumn("digits", F.transform(codec.base4_digits("length"), lambda d: d + 256))


def symbols(runs: DataFrame) -> DataFrame:
    """(symbol, n): how often each digit and value is written; values as their code points."""
    each = rle_digits(runs).select(F.explode(F.concat("digits", F.array(F.ascii("value")))).alias("symbol"))
    return each.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol's codeword in an optimal prefix code."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    bits, fresh = dict.fromkeys(counts, 0), len(heap)
    while len(heap) > 1:
        a, _, left = heapq.heappop(heap)
        b, _, right = heapq.heappop(heap)
        for s in left + right:
            bits[s] += 1
        heapq.heappush(heap, (a + b, fresh, left + right))
        fresh += 1
    return bits


def codebook(counts: dict[int, int]) -> dict[int, str]:
    """The canonical codewords of those lengths."""
    out, code, last = {}, 0, 0
    for s, n in sorted(huffman_lengths(counts).items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], last = format(code, f"0{n}b"), n
        code += 1
    return out


def huffman_bits(runs: DataFrame) -> DataFrame:
    """One row: the number of distinct symbols, of symbols, and of bits that an optimal code needs.

    The code is built on the driver from the symbol counts: one for each
    character that occurs, and four digits.
    """
    counts = symbols(runs)
    table = {r.symbol: r.n for r in counts.collect()}
    bits = huffman_lengths(table)
    spark = runs.sparkSession
    coded = spark.createDataFrame(sorted(bits.items()) or [], "symbol int, bits int")
    return counts.join(F.broadcast(coded), "symbol").agg(F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("written"), F.coalesce(F.sum(F.col("n") * F.col("bits")), F.lit(0)).cast("long").alias("bits"))


#: Cells of a block, which one task holds.
MAX_CELLS = 1 << 25


def pbwt_encode(rows: DataFrame, width: int, max_cells: int = MAX_CELLS) -> DataFrame:
    """(block, col, rank, row, value) of rows(block, row, s), strings of ``width`` characters.

    Column j lists its characters in the order of the rows by columns j - 1 down
    to 0, then by row.  Each column is one stable sort of the one before, so a
    block takes time and memory by its cells.  Blocks are transformed apart from
    each other; one of over max_cells cells raises.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        n = len(pdf)
        if n * width > max_cells:
            raise ValueError(f"block {pdf['block'].iloc[0]}: {n} rows of {width} are over {max_cells} cells; make smaller blocks")
        cells = np.array([list(s) for s in pdf["s"]], dtype="<U1").reshape(n, width)
        ids, order = pdf["row"].to_numpy(), np.arange(n)
        at = np.empty((width, n), np.int64)
        for j in range(width):
            at[j] = order
            order = order[np.argsort(cells[order, j], kind="stable")]
        col = np.repeat(np.arange(width, dtype=np.int32), n)
        return pd.DataFrame({"block": pdf["block"].iloc[0], "col": col, "rank": np.tile(np.arange(n, dtype=np.int32), width), "row": ids[at.ravel()], "value": cells[at.ravel(), col]})

    return rows.select("block", "row", "s").groupBy("block").applyInPandas(run, "block long, col int, rank int, row long, value string")


def pbwt_decode(encoded: DataFrame) -> DataFrame:
    """(block, row, s) from (block, col, rank, value): column by column, each block, bounded as in encoding, on its own; its rows numbered from 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["col", "rank"])
        width = int(pdf["col"].max()) + 1
        cells = pdf["value"].to_numpy(dtype="<U1").reshape(width, -1)
        back = np.empty(cells.shape[::-1], dtype="<U1")
        order = np.arange(cells.shape[1])
        for j in range(width):
            back[order, j] = cells[j]
            order = order[np.argsort(cells[j], kind="stable")]
        return pd.DataFrame({"block": pdf["block"].iloc[0], "row": np.arange(len(back)), "s": ["".join(r) for r in back]})

    return encoded.select("block", "col", "rank", "value").groupBy("block").applyInPandas(run, "block long, row long, s string")


def bytes_to_bases(rows: DataFrame, fragment: int | None = None) -> DataFrame:
    """(id, frag, bases) of rows(id, data): each byte as four bases, in fragments of so many bytes."""
    size = F.octet_length("data")
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(fragment)) if fragment else F.array(F.lit(0))
    cut = rows.select("id", "data", F.posexplode(starts).alias("frag", "at")).where(F.octet_length("data") > 0)
    part = F.expr(f"substring(data, at + 1, {fragment})") if fragment else F.col("data")
    pairs = F.hex(part)
    for hexa in "0123456789ABCDEF":  # a half byte is two bases; lower case keeps them apart from digits still to come
        v = int(hexa, 16)
        pairs = F.replace(pairs, F.lit(hexa), F.lit((codec.BASES[v >> 2] + codec.BASES[v & 3]).lower().translate(_AWAY)))
    return cut.select("id", F.col("frag").cast("long"), F.translate(pairs, "wxyz", codec.BASES).alias("bases"))


_AWAY = str.maketrans("acgt", "wxyz")


def bases_to_bytes(bases) -> object:
    """The bytes of a column of bases, four to a byte."""
    twos = F.regexp_extract_all(F.translate(bases, codec.BASES, codec.DIGITS), F.lit(".."), F.lit(0))
    return F.unhex(F.array_join(F.transform(twos, lambda d: F.conv(d, 4, 16)), ""))


def quality_matrix(rows: DataFrame) -> DataFrame:
    """(row, col, v): the code points of rows(row, s), long form."""
    return rows.select("row", F.posexplode(F.split("s", "")).alias("col", "c")).where("c <> ''").select("row", F.col("col").cast("long"), F.ascii("c").cast("long").alias("v"))
