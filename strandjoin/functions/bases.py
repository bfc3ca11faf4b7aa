"""Column expressions over strings of bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_bases(seq: Column) -> Column:
    """Upper case, with everything that is not A, C, G or T turned into N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """Opposite strand; the case of a base is kept, other letters become N."""
    known = F.regexp_replace(seq, "[^ACGTacgt]", "N")
    return F.reverse(F.translate(known, "ACGTacgt", "TGCAtgca"))


def count_n(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def has_n(seq: Column) -> Column:
    return seq.contains("N")


def is_homopolymer(seq: Column) -> Column:
    """All letters equal to the first one."""
    return seq == F.repeat(F.substring(seq, 1, 1), F.length(seq))


def pack_kmer(seq: Column) -> Column:
    """2 bits a base (A=0 C=1 G=2 T=3), case-insensitive, up to 31 bases.

    NULL where the value would be meaningless: empty, too long or with another letter.
    """
    digits = F.translate(F.upper(seq), "ACGT", "0123")
    return F.when(digits.rlike("^[0-3]{1,31}$"), F.conv(digits, 4, 10).cast("bigint"))
