"""Readers and writers of alignment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import decode_alignment, encode_alignment

ALIGNMENT_SCHEMA = (
    "read_id bigint, ref_id bigint, ref_start bigint, ref_end bigint, "
    "differences int, is_rc boolean"
)


def write_alignments(alignments: DataFrame, path: str) -> None:
    """Parquet; an existing table is an error."""
    alignments.write.mode("errorifexists").parquet(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALIGNMENT_SCHEMA).parquet(path)


def alignments_to_text(alignments: DataFrame, with_read: bool = False) -> DataFrame:
    """One tab-separated ``value`` per alignment.

    Short form: reference, strand flag 1/0, start, end, differences. With ``with_read``:
    reference, start, end, read, differences, strand sign.
    """
    if with_read:
        sign = F.when(F.col("is_rc"), "-").otherwise("+")
        fields = ["ref_id", "ref_start", "ref_end", "read_id", "differences", sign]
    else:
        fields = ["ref_id", F.col("is_rc").cast("int"), "ref_start", "ref_end", "differences"]
    strings = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return alignments.select(F.concat_ws("\t", *strings).alias("value"))


def alignments_from_text(lines: DataFrame) -> DataFrame:
    """Parse the short form."""
    part = F.split("value", "\t", 5)
    return lines.select(
        part[0].cast("bigint").alias("ref_id"),
        part[2].cast("bigint").alias("ref_start"),
        part[3].cast("bigint").alias("ref_end"),
        part[4].cast("int").alias("differences"),
        (part[1].cast("int") == 1).alias("is_rc"),
    )


def alignments_to_packed(alignments: DataFrame) -> DataFrame:
    """(id, value): read id and the 17-byte record."""
    value = encode_alignment(
        *[F.col(c) for c in ("ref_id", "ref_start", "ref_end", "differences", "is_rc")]
    )
    return alignments.select(F.col("read_id").cast("int").alias("id"), value.alias("value"))


def alignments_from_packed(packed: DataFrame) -> DataFrame:
    return packed.select(
        F.col("id").cast("bigint").alias("read_id"), decode_alignment(F.col("value")).alias("a")
    ).select("read_id", "a.*")
