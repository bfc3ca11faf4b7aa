"""Binary interchange layouts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sequence layout: hexadecimal digit -> letter, 15 being the filler that
# completes the last byte. Codes that name no base read as N.
NIBBLE_DIGITS = "01248F35679ABCDE"
NIBBLE_LETTERS = "ACGTN NNNNNNNNNN"


def int32_from_bytes(value: Column, first: int) -> Column:
    """Signed big-endian 32-bit integer at a 1-based byte position."""
    unsigned = F.conv(F.hex(F.substring(value, first, 4)), 16, 10).cast("bigint")
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)


def int32_to_hex(value: Column) -> Column:
    """Eight hexadecimal digits of the low 32 bits; fails where the value does not fit."""
    fits = value.between(-(1 << 31), (1 << 31) - 1)
    low = value.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    checked = F.when(fits | value.isNull(), low).otherwise(
        F.raise_error(F.concat(F.lit("does not fit in 32 bits: "), value.cast("string")))
        .cast("bigint")
    )
    return F.lpad(F.hex(checked), 8, "0")


def decode_sequence(value: Column) -> Column:
    """Packed chunk -> struct(is_last, offset, seq)."""
    letters = F.translate(F.hex(F.substr(value, F.lit(6))), NIBBLE_DIGITS, NIBBLE_LETTERS)
    seq = F.regexp_replace(F.regexp_replace(letters, " $", ""), " ", "N")
    return F.struct(
        (F.substring(value, 1, 1) == F.unhex(F.lit("01"))).alias("is_last"),
        int32_from_bytes(value, 2).alias("offset"),
        seq.alias("seq"),
    )


def encode_sequence(is_last: Column, offset: Column, seq: Column) -> Column:
    """Inverse of :func:`decode_sequence`; case-insensitive, other letters become N."""
    letters = F.regexp_replace(F.upper(seq), "[^ACGT]", "N")
    return F.unhex(
        F.concat(
            F.when(is_last, "01").otherwise("00"),
            int32_to_hex(offset),
            F.translate(letters, "ACGTN", "01248"),
            F.when(F.length(seq) % 2 == 1, "F").otherwise(""),
        )
    )


def encode_alignment(
    ref_id: Column, ref_start: Column, ref_end: Column, differences: Column, is_rc: Column
) -> Column:
    """17 bytes: strand flag, then four big-endian integers."""
    fields: Sequence[Column] = (ref_id, ref_start, ref_end, differences)
    return F.unhex(
        F.concat(F.when(is_rc, "01").otherwise("00"), *[int32_to_hex(c) for c in fields])
    )


def decode_alignment(value: Column) -> Column:
    """Inverse of :func:`encode_alignment`."""
    return F.struct(
        int32_from_bytes(value, 2).alias("ref_id"),
        int32_from_bytes(value, 6).alias("ref_start"),
        int32_from_bytes(value, 10).alias("ref_end"),
        int32_from_bytes(value, 14).cast("int").alias("differences"),
        (F.substring(value, 1, 1) == F.unhex(F.lit("01"))).alias("is_rc"),
    )
