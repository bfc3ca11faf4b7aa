"""Whole queries: all alignments of a read set, and the unambiguous ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gapped import gapped_substring_join
from ..operators.joins import (
    ReadStats,
    approx_substring_join,
    distinct_reads,
    has_repeated_ids,
    read_stats,
    uses_broadcast,
)
from ..operators.seeds import packed_read_tiles
from ..operators.select import best_hit, unambiguous
from ..operators.sequences import prepare_reads
from ..params import AlignParams


@dataclass(frozen=True)
class Search:
    """Alignments of distinct read texts, with what is needed to return to all reads."""

    reads: DataFrame
    distinct: DataFrame
    stats: ReadStats
    params: AlignParams
    hits: DataFrame

    def rows(self) -> DataFrame:
        return self.for_all_reads(self.hits)

    def for_all_reads(self, rows: DataFrame) -> DataFrame:
        """Rows of a distinct text, given to each of its copies."""
        if self.stats.max_copies <= 1:
            return rows
        first = self.distinct.select("seq", F.col("read_id").alias("first_id"))
        if uses_broadcast(self.params, self.stats):
            first = F.broadcast(first)
        copies = self.reads.join(first, "seq").select("first_id", "read_id")
        named = rows.withColumnRenamed("read_id", "first_id").join(copies, "first_id")
        return named.select(*rows.columns)


def _search(
    sequences: DataFrame, reads: DataFrame, params: AlignParams, edits: bool = False
) -> Search:
    prepared = prepare_reads(reads, params)
    # Rows that share an id are ranked together, so they must keep it: no copies are combined.
    repeated = has_repeated_ids(prepared)
    distinct = prepared.withColumn("copies", F.lit(1)) if repeated else distinct_reads(prepared)
    tiles = packed_read_tiles(distinct, params)
    stats = read_stats(tiles)
    join = gapped_substring_join if params.allow_differences else approx_substring_join
    hits = join(sequences, tiles, params, stats, edits)
    return Search(prepared, distinct, stats, params, hits)


def align(
    sequences: DataFrame,
    reads: DataFrame,
    params: AlignParams = AlignParams(),
    edits: bool = False,
) -> DataFrame:
    """Every place of every read, on both strands.

    ``sequences``: seq_id, seq and, for stored chunks, offset and is_last. ``reads``: read_id
    and seq; an id that several rows share has the places of all of them, and a place that two
    of them find counts twice, as a tie. Result: read_id, ref_id, ref_start, ref_end, differences, is_rc; with
    ``edits`` also where the differences are.
    """
    return _search(sequences, reads, params, edits).rows()


def align_best(
    sequences: DataFrame, reads: DataFrame, params: AlignParams = AlignParams()
) -> DataFrame:
    """Best place of every aligned read and the number of places that tie with it."""
    found = _search(sequences, reads, params)
    return found.for_all_reads(best_hit(found.hits, params.k))


def align_unique(
    sequences: DataFrame, reads: DataFrame, params: AlignParams = AlignParams()
) -> DataFrame:
    """Reads whose best place is unique. Ranking runs on distinct texts, before copies return."""
    found = _search(sequences, reads, params)
    return found.for_all_reads(unambiguous(found.hits, params.k))
