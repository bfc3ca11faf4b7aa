"""Residual predicates on seed candidates, as integer arithmetic on packed frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packing as P
from ..params import AlignParams, GridParams
from .seeds import frame_columns


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def mark_mismatches(candidates: DataFrame, params: AlignParams) -> DataFrame:
    """Add m0.., a low bit per base where read and reference differ, and o0.., a low bit per
    base of the read that lies beyond an end of the reference.
    """
    columns = {}
    for i, (c, f) in enumerate(zip(frame_columns("c", params), frame_columns("f", params))):
        covered = F.lit(P.LOW_BITS).bitwiseXOR(P.pad_bits(f))
        columns[f"m{i}"] = P.mismatch_bits(c, f).bitwiseAND(covered)
        columns[f"o{i}"] = P.pad_bits(c).bitwiseAND(covered)
    return candidates.withColumns(columns)


def count_differences(params: AlignParams) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(m) for m in frame_columns("m", params)])


def inside_sequence(params: AlignParams) -> Column:
    """No base of the read lies beyond an end of the reference."""
    return all_of([o == 0 for o in frame_columns("o", params)])


def touches(mismatches: list[Column], masks: list[int]) -> Column:
    """Some mismatch falls on the masked positions."""
    return any_of([m.bitwiseAND(F.lit(k)) != 0 for m, k in zip(mismatches, masks) if k])


def is_clean_tile(params: AlignParams) -> Column:
    """No mismatch in the tile itself; the join has compared its first ``key_len`` bases."""
    end = params.left_reach + params.seed_len
    masks = P.base_masks(range(params.left_reach + params.key_len, end), params.frame_words)
    return ~touches(frame_columns("m", params), masks)


def is_leftmost_seed(params: AlignParams) -> Column:
    """No earlier tile would have found the same place.

    Every tile to the left either differs from the reference or could not be a seed, so a
    place reached through several clean tiles is kept once, without a shuffle.
    """
    mismatches = frame_columns("m", params)
    conditions = []
    for d in range(1, params.n_tiles):
        start = params.left_reach - d * params.seed_len
        masks = P.base_masks(range(start, start + params.seed_len), params.frame_words)
        unused = F.col("need").bitwiseAND(F.lit(1 << (d - 1)).cast("bigint")) == 0
        conditions.append(unused | touches(mismatches, masks))
    return all_of(conditions)


def group_masks(params: AlignParams) -> list[list[list[int]]]:
    """Frame masks of the key extension, by tile and group.

    With one tile clean, all differences lie in the other bases. Cutting those into k + 1 groups
    leaves one group clean again, so (seed, group) still finds every place and is far rarer.
    """
    result = []
    for tile in range(params.min_len // params.seed_len):
        start = tile * params.seed_len
        rest = [b for b in range(params.min_len) if not start <= b < start + params.seed_len]
        bounds = [len(rest) * g // (params.k + 1) for g in range(params.k + 2)]
        result.append(
            [
                P.base_masks(
                    [params.left_reach - start + b for b in rest[lo:hi]], params.frame_words
                )
                for lo, hi in zip(bounds, bounds[1:])
            ]
        )
    return result


def group_lookup(params: AlignParams) -> list[Column]:
    """Per frame word an array of the group masks, indexed by tile * (k + 1) + group."""
    flat = [masks for groups in group_masks(params) for masks in groups]
    return [
        F.array(*[F.lit(m[w]).cast("bigint") for m in flat]) for w in range(params.frame_words)
    ]


def is_first_group(params: AlignParams) -> Column:
    """On an extended key: no earlier group of the same tile is clean as well."""
    lookup = group_lookup(params)
    mismatches = frame_columns("m", params)
    group = F.pmod(F.col("sub"), F.lit(params.k + 1))
    conditions = []
    for earlier in range(params.k):
        at = F.col("sub") - group + earlier
        dirty = any_of(
            [m.bitwiseAND(F.get(masks, at)) != 0 for m, masks in zip(mismatches, lookup)]
        )
        conditions.append((group <= earlier) | dirty)
    return (F.col("sub") < 0) | all_of(conditions)


def within_k(candidates: DataFrame, params: AlignParams) -> DataFrame:
    """Marked candidates within k substitutions that lie wholly inside the reference.

    Only this short test becomes part of the join condition. What follows reads the marks of the
    few survivors through a generator, which keeps the code generated for the join small enough
    for the JVM to compile it.
    """
    close = candidates.where((count_differences(params) <= params.k) & inside_sequence(params))
    if params.key_len < params.seed_len:
        close = close.where(is_clean_tile(params))
    marks = [f"m{i}" for i in range(params.frame_words)]
    others = [c for c in close.columns if c not in marks]
    kept = close.select(*others, F.inline(F.array(F.struct(*marks))))
    return kept.where(is_first_group(params)) if "sub" in kept.columns else kept


def verify_candidates(candidates: DataFrame, params: AlignParams) -> DataFrame:
    """Marked candidates within k substitutions, each place once."""
    return within_k(candidates, params).where(is_leftmost_seed(params))


def has_clean_tile(params: AlignParams, grid: GridParams) -> Column:
    """A tile of the plain search holds neither a mismatch nor N; in doubt for reads with N alone."""
    mismatches = frame_columns("m", grid)
    shift = F.lit(grid.left_reach) - F.col("start")

    def clean(at: Column) -> Column:
        bases = F.sequence(at, at + (params.seed_len - 1))
        return F.forall(bases, lambda p: ~P.test_bit_at(mismatches, p + shift))

    return F.col("free").isNull() | F.exists("free", clean)


def project_alignments(
    verified: DataFrame, params: AlignParams, edits: bool = False, tile_start: Column | None = None
) -> DataFrame:
    """(read_id, ref_id, ref_start, ref_end, differences, is_rc[, mismatch_positions])."""
    if tile_start is None:
        tile_start = F.col("tile") * params.seed_len
    ref_start = F.col("pos") - tile_start
    columns = [
        F.col("read_id"),
        F.col("ref_id"),
        ref_start.alias("ref_start"),
        (ref_start + F.col("read_len")).alias("ref_end"),
        count_differences(params).cast("int").alias("differences"),
        F.col("is_rc"),
    ]
    if edits:
        mismatches = frame_columns("m", params)
        shift = F.lit(params.left_reach) - tile_start
        positions = F.filter(
            F.sequence(F.lit(0), F.col("read_len") - 1),
            lambda p: P.test_bit_at(mismatches, p + shift),
        )
        columns.append(positions.alias("mismatch_positions"))
    return verified.select(*columns)
