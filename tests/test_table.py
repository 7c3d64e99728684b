"""Table functions in SQL against the operators."""

import pytest

from kmerspark.functions import table
from kmerspark.operators import brc
from kmerspark.operators.windows import kmer_codes

SEQS = [(1, "ACGTNacgtacc"), (2, None), (3, ""), (3, "éACGTT\U0001f600ACGTAC"), (None, "AC"), (5, "T" * 40)]


def test_lateral_joins(spark):
    df = spark.createDataFrame(SEQS, "seq_id long, seq string")
    df.createOrReplaceTempView("table_seqs")
    table.register(spark)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    for k in (1, 4, 32):
        assert rows(spark.sql(f"SELECT seq_id, k.pos, k.code FROM table_seqs, LATERAL kmers(seq, {k}) AS k")) == rows(kmer_codes(df, k))
    assert rows(spark.sql("SELECT seq_id, s.brc_id, s.len, s.start, s.type FROM table_seqs, LATERAL segments(seq, 4) AS s")) == rows(brc.segments(df, 4))
    assert [r.kmer for r in spark.sql("SELECT kmer FROM kmers('acgNtac', 3) ORDER BY pos").collect()] == ["ACG", "TAC"]
    with pytest.raises(Exception, match="must be 1 to 32"):
        spark.sql("SELECT * FROM kmers('ACGT', 33)").collect()
