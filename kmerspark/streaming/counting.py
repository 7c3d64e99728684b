"""K-mer counts of sequences that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerspark.operators.graph import branch_positions
from kmerspark.operators.windows import kmer_codes


def streaming_counts(seqs: DataFrame, k: int) -> DataFrame:
    """(code, cnt) so far, of a stream seqs(seq_id, seq); write it in update or complete mode."""
    return kmer_codes(seqs, k).groupBy("code").agg(F.count(F.lit(1)).alias("cnt"))


def streaming_branches(seqs: DataFrame, branches: DataFrame, kp1: int) -> DataFrame:
    """branch_positions of a stream against a fixed set of branches(code); keeps no state."""
    return branch_positions(seqs, branches, kp1)
