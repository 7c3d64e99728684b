"""K-mers as columns: strings over ACGT, and the same as longs of two bits a base.

The first base takes the highest bits, so codes of one length sort as their
strings do.  A k-mer of 32 bases fills the long's sign bit; ``unsigned_order``
gives the column to sort such codes by.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASES = "ACGT"
DIGITS = "0123"
MAX_K = 32


def check_k(k: int, least: int = 1) -> int:
    if not least <= k <= MAX_K:
        raise ValueError(f"k must be {least} to {MAX_K}, not {k}")
    return k


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_code(base: Column | str) -> Column:
    """0 to 3 for ACGT in either case, 5 for "-", 4 for all else."""
    up = F.upper(_col(base))
    at = F.instr(F.lit(BASES), up)
    return F.when((F.length(up) == 1) & (at > 0), at - 1).when(up == "-", 5).otherwise(4)


def encode(kmer: Column | str) -> Column:
    """The code of a k-mer of ACGT (either case); null if it has anything else or over 32 bases."""
    up = F.upper(_col(kmer))
    return F.when(up.rlike(f"^[{BASES}]{{1,{MAX_K}}}$"), F.conv(F.translate(up, BASES, DIGITS), 4, -10).cast("long"))


def decode(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), k, "0"), DIGITS, BASES)


def unsigned_order(code: Column | str) -> Column:
    return _col(code).bitwiseXOR(F.lit(-(1 << 63)))


def prefix(code: Column | str, n: int = 1) -> Column:
    """Without the last n bases."""
    return F.shiftrightunsigned(_col(code), 2 * n)


def suffix(code: Column | str, k: int) -> Column:
    """The last k bases."""
    return _col(code) if k >= MAX_K else _col(code).bitwiseAND((1 << 2 * k) - 1)


def last_base(code: Column | str) -> Column:
    return _col(code).bitwiseAND(3).cast("int")


def first_base(code: Column | str, k: int) -> Column:
    return F.shiftrightunsigned(_col(code), 2 * (k - 1)).cast("int")


def rotate(kmer: Column | str, n: int) -> Column:
    """The last n bases moved to the front; for n below 0, the first -n to the back."""
    kmer = _col(kmer)
    at = F.length(kmer) - F.pmod(F.lit(n), F.length(kmer))
    return F.concat(kmer.substr(at + 1, F.length(kmer)), kmer.substr(F.lit(1), at))


def revcomp(kmer: Column | str) -> Column:
    return F.reverse(F.translate(F.upper(_col(kmer)), BASES, BASES[::-1]))


def canonical(kmer: Column | str) -> Column:
    """The lesser of the k-mer and its reverse complement."""
    return F.least(F.upper(_col(kmer)), revcomp(kmer))


def symbol_at(kmer: Column | str, i: Column | int) -> Column:
    """The base at 0-based i, or null outside."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when((i >= 0) & (i < F.length(_col(kmer))), _col(kmer).substr(i + 1, F.lit(1)))


def base4_digits(n: Column | str) -> Column:
    """The digits of a number to base 4, lowest first; none for 0."""
    return F.when(_col(n) == 0, F.array().cast("array<int>")).otherwise(F.reverse(F.split(F.conv(_col(n).cast("string"), 10, 4), "")).cast("array<int>"))


#: M-mers that no signature may be.
REFUSED = "(TT.|TGT)$|.AA|^ACA"


def normal_mmer(mmer: Column | str, m: int) -> Column:
    """The code of the lesser of the m-mer and its reverse complement among those allowed; 4 ** m if neither is."""
    none = F.lit(4**m).cast("long")
    own = [F.when(s.rlike(REFUSED), none).otherwise(encode(s)) for s in (_col(mmer), revcomp(mmer))]
    return F.least(*own)
