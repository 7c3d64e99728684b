"""Table functions for SQL: lateral joins of sequences with what is made of them.

    register(spark)
    spark.sql("SELECT id, k.pos, k.kmer FROM seqs, LATERAL kmers(seq, 21) AS k")
    spark.sql("SELECT id, s.* FROM seqs, LATERAL segments(seq, 22) AS s")

Windows leave Python in upper case.  A null sequence counts as an empty one; one
shorter than k has no windows; an empty one is one empty bad segment; k outside 1
to 32 raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kmerspark.functions.codec import check_k
from kmerspark.operators.flat import Flat, segments
from kmerspark.operators.windows import base_windows


@udtf(returnType="pos long, code long, kmer string", useArrow=True)
class Kmers:
    """(pos, code, kmer) of the windows of k bases of a sequence."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, int, str]]:
        flat = Flat(pa.array([seq or ""], pa.string()))
        upper = (seq or "").upper() if (seq or "").isascii() else "".join(c.upper() if c.isascii() else c for c in seq)
        for pos, code in zip(*(x.tolist() for x in base_windows(flat.base, check_k(k))), strict=True):
            yield pos, code, upper[pos : pos + k]


@udtf(returnType="brc_id long, start long, len long, type string", useArrow=True)
class Segments:
    """(brc_id, start, len, type) of the good and bad segments of a sequence, for edges of so many bases."""

    def eval(self, seq: str, kp1: int) -> Iterator[tuple[int, int, int, str]]:
        s = segments(Flat(pa.array([seq or ""], pa.string())), check_k(kp1))
        for i, (start, end, good) in enumerate(zip(s.start.tolist(), s.end.tolist(), np.asarray(s.good).tolist(), strict=True)):
            yield i, start, end - start, "good" if good else "bad"


def register(spark: SparkSession) -> None:
    """Makes kmers(seq, k) and segments(seq, kp1) known to the session's SQL."""
    spark.udtf.register("kmers", Kmers)
    spark.udtf.register("segments", Segments)
