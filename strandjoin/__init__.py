"""Approximate matching of short sequences against long ones, as Spark DataFrame work."""

from .params import AlignParams
from .plans.align import align, align_best, align_unique
from .plans.index import SeedIndex, align_indexed, build_seed_index, open_seed_index
from .plans.job import JobSummary, run_alignment

__all__ = [
    "AlignParams",
    "JobSummary",
    "SeedIndex",
    "align",
    "align_best",
    "align_indexed",
    "align_unique",
    "build_seed_index",
    "open_seed_index",
    "run_alignment",
]
