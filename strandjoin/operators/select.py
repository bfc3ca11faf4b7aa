"""Ranking of alignments per read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ("ref_id", "ref_start", "ref_end", "is_rc")


def best_hit(alignments: DataFrame, k: int) -> DataFrame:
    """Per read the least differences, how many places reach it, and the first such place.

    (read_id, differences, n_best, ref_id, ref_start, ref_end, is_rc). One exchange: the counts
    per number of differences and the minimum are combined before it.
    """
    counts = [F.count_if(F.col("differences") == d).alias(f"n{d}") for d in range(k + 1)]
    first = F.min(F.struct("differences", *PLACE)).alias("first")
    n_best = F.element_at(
        F.array(*[F.col(f"n{d}") for d in range(k + 1)]), F.col("first.differences") + 1
    )
    return (
        alignments.groupBy("read_id")
        .agg(first, *counts)
        .select(
            "read_id",
            "first.differences",
            n_best.alias("n_best"),
            *[F.col(f"first.{c}").alias(c) for c in PLACE],
        )
    )


def unambiguous(alignments: DataFrame, k: int) -> DataFrame:
    """Reads whose best place is unique, with that place; tied reads vanish wholly.

    For each number of differences the aggregate keeps a count and the largest value of every
    field. Where the count is one, those are the fields of that one place. All buffers are
    plain numbers, so this is a single hash aggregate combined before its only exchange.
    """
    level_columns = []
    for d in range(k + 1):
        at = F.col("differences") == d
        level_columns.append(F.count_if(at).alias(f"n{d}"))
        level_columns += [
            F.max(F.when(at, F.col(c).cast("bigint"))).alias(f"{c}{d}") for c in PLACE
        ]
    levels = alignments.groupBy("read_id").agg(*level_columns)
    best = F.coalesce(
        *[
            F.when(
                F.col(f"n{d}") > 0,
                F.struct(
                    F.col(f"n{d}").alias("n"),
                    F.lit(d).alias("differences"),
                    *[F.col(f"{c}{d}").alias(c) for c in PLACE],
                ),
            )
            for d in range(k + 1)
        ]
    )
    return levels.select("read_id", best.alias("best")).where("best.n = 1").select(
        "read_id",
        "best.ref_id",
        "best.ref_start",
        "best.ref_end",
        "best.differences",
        F.col("best.is_rc").cast("boolean").alias("is_rc"),
    )


def ambiguous_reads(alignments: DataFrame, k: int) -> DataFrame:
    """Reads whose least number of differences is reached at several places."""
    levels = [F.count_if(F.col("differences") == d).alias(f"n{d}") for d in range(k + 1)]
    best = F.coalesce(
        *[
            F.when(
                F.col(f"n{d}") > 0,
                F.struct(F.lit(d).alias("differences"), F.col(f"n{d}").alias("n_best")),
            )
            for d in range(k + 1)
        ]
    )
    counted = alignments.groupBy("read_id").agg(*levels).select("read_id", best.alias("best"))
    return counted.where("best.n_best > 1").select("read_id", "best.differences", "best.n_best")


def count_alignments(alignments: DataFrame) -> DataFrame:
    return alignments.agg(F.count(F.lit(1)).alias("alignments"))


def alignment_summary(alignments: DataFrame) -> DataFrame:
    """Alignments by number of differences and strand."""
    return alignments.groupBy("differences", "is_rc").agg(F.count(F.lit(1)).alias("alignments"))
