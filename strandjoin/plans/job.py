"""The complete job: all alignments to one table, unambiguous reads to another."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.select import unambiguous
from ..params import AlignParams
from ..sources.alignments import read_alignments, write_alignments
from .align import align


@dataclass(frozen=True)
class JobSummary:
    alignments: int
    unambiguous: int
    align_seconds: float
    filter_seconds: float


def _write_counted(rows: DataFrame, path: str) -> int:
    """Write a table and count its rows in the same pass."""
    counter = Observation()
    write_alignments(rows.observe(counter, F.count(F.lit(1)).alias("n")), path)
    return counter.get["n"]


def run_alignment(
    sequences: DataFrame, reads: DataFrame, output: str, params: AlignParams = AlignParams()
) -> JobSummary:
    """Write ``<output>-alignments`` and, ranked from that table, ``output``.

    The first table is the boundary between the stages: once written, nothing before it is
    computed again, whatever happens to the executors. Neither table may exist beforehand.
    """
    start = time.monotonic()
    all_hits = f"{output}-alignments"
    n_alignments = _write_counted(align(sequences, reads, params), all_hits)
    middle = time.monotonic()
    stored = read_alignments(reads.sparkSession, all_hits)
    n_unique = _write_counted(unambiguous(stored, params.k), output)
    return JobSummary(n_alignments, n_unique, middle - start, time.monotonic() - middle)
