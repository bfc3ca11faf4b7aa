"""Sequences and reads derived from text tables, so that any corpus can serve as test input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sequences import computed_once
from .params import AlignParams

# The letter each letter of the alphabet stands for.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAN"
# Low bits of a read id that number the reads of one item.
TILE_BITS = 20


def bases(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), ALPHABET, BASES)


def spread(spark: SparkSession, scan: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the cluster has cores.

    A table of many files or row groups is left where it is.
    """
    cores = spark.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(4 * cores, key)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, offset, is_last, seq) from every text of ``documents``, short ones too."""
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return (
        spread(spark, scan, "doc_id")
        .select(
            F.col("doc_id").alias("seq_id"),
            F.lit(0).cast("bigint").alias("offset"),
            F.lit(True).alias("is_last"),
            computed_once(bases(F.col("text"))).alias("seq"),
        )
        .where("seq IS NOT NULL")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, seq) from ``benchmark``."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", computed_once(bases(F.col("text"))).alias("seq")
    )


def reads(spark: SparkSession, sf_dir: str, params: AlignParams = AlignParams()) -> DataFrame:
    """(read_id, seq): consecutive tiles of ``benchmark``; the last one ends where the text ends.

    A text shorter than one read gives none. Ids hold the item above the 20 bits of the tile.
    """
    n = params.max_len
    whole = items(spark, sf_dir).where(F.length("seq") >= n)
    tiles = whole.select(
        "item_id",
        "seq",
        F.explode(F.sequence(F.lit(0), F.ceil(F.length("seq") / n).cast("int") - 1)).alias("tile"),
    )
    return tiles.select(
        (F.col("item_id") * (1 << TILE_BITS) + F.col("tile")).alias("read_id"),
        F.substr("seq", F.least(F.col("tile") * n, F.length("seq") - n) + 1, F.lit(n)).alias("seq"),
    )
