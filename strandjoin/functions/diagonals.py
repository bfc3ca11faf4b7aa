"""Edit distance of a prefix by furthest-reaching diagonals, on one BIGINT a diagonal.

A side of a seed, read away from it, is a pattern (the read) against a text (the reference). Bit i
of the mask of diagonal d says that pattern base i and text base i + d differ or that the pattern
has ended. With e edits the furthest pattern row on a diagonal follows from three rows of e - 1
edits; matches after it are the zeros below the next set bit, counted at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import BASES_PER_WORD
from .generated import in_own_method

# Most bases of a side, with those that a diagonal can be off on either hand; two bits stay free.
MAX_WIDTH = 62
# Translations of octal digits to the bits of each plane.
PLANES = ("01010101", "00110011", "00001111")
# A row that no path reaches; it stays negative after k steps.
NOWHERE = -100_000
# Stands for more than k edits.
BEYOND = -1
# Steps that gather every third bit of 63 at the low end: distance and mask.
_GATHER = (
    (2, 0x10C30C30C30C30C3),
    (4, 0x100F00F00F00F00F),
    (8, 0x001F0000FF0000FF),
    (16, 0x001F00000000FFFF),
    (32, 0x00000000001FFFFF),
)
# Steps that reverse 64 bits: neighbours, pairs, nibbles, bytes, ...
_REVERSE = (
    (1, 0x5555555555555555),
    (2, 0x3333333333333333),
    (4, 0x0F0F0F0F0F0F0F0F),
    (8, 0x00FF00FF00FF00FF),
    (16, 0x0000FFFF0000FFFF),
    (32, 0x00000000FFFFFFFF),
)
_EVERY_THIRD = 0x1249249249249249


def _left(value: Column, n: int) -> Column:
    return F.call_function("shiftleft", value, F.lit(n)) if n else value


def _right(value: Column, n: int | Column) -> Column:
    if isinstance(n, int) and not n:
        return value
    return F.call_function("shiftrightunsigned", value, F.lit(n) if isinstance(n, int) else n)


def _and(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask).cast("bigint"))


def digit_planes(digits: Column) -> list[Column]:
    """The three bit planes of at most 63 octal digits, the last digit lowest."""
    planes = [F.conv(F.translate(digits, "01234567", p), 2, 10).cast("bigint") for p in PLANES]
    return [F.coalesce(p, F.lit(0).cast("bigint")) for p in planes]


def plane_columns(frame: DataFrame, words: list[str], regions: dict[str, tuple[int, int, bool]]) -> DataFrame:
    """Add the planes of regions of packed words: `{name}0`, `{name}1`, `{name}2`.

    A region is (first base, end, reversed): its last base is the lowest bit, or its first one if
    reversed. Each step is a projection of its own, so that no step is computed twice.
    """
    bits = {f"{w}_{p}": _and(_right(F.col(w), p), _EVERY_THIRD) for w in words for p in range(3)}
    frame = frame.withColumns(bits)
    for distance, mask in _GATHER:
        frame = frame.withColumns(
            {b: _and(F.col(b).bitwiseXOR(_right(F.col(b), distance)), mask) for b in bits}
        )
    planes = {}
    for name, (first, end, _) in regions.items():
        for p in range(3):
            parts = []
            for i, word in enumerate(words):
                begin = i * BASES_PER_WORD
                if begin < end and begin + BASES_PER_WORD > first:
                    shift = end - begin - BASES_PER_WORD
                    value = F.col(f"{word}_{p}")
                    parts.append(_left(value, shift) if shift >= 0 else _right(value, -shift))
            whole = reduce(lambda a, b: a.bitwiseOR(b), parts)
            planes[f"{name}{p}"] = _and(whole, (1 << (end - first)) - 1)
    frame = in_own_method(frame.withColumns(planes).drop(*bits))
    turned = [f"{name}{p}" for name, (_, _, backward) in regions.items() if backward for p in range(3)]
    for distance, mask in _REVERSE if turned else ():
        frame = frame.withColumns(
            {
                c: _and(_right(F.col(c), distance), mask).bitwiseOR(_left(_and(F.col(c), mask), distance))
                for c in turned
            }
        )
    widths = {f"{name}{p}": 64 - end + first for name, (first, end, _) in regions.items() for p in range(3)}
    return in_own_method(frame.withColumns({c: _right(F.col(c), widths[c]) for c in turned}))


def zeros_below(value: Column) -> Column:
    """Zeros below the lowest set bit, 64 if there is none."""
    return F.bit_count((value - 1).bitwiseAND(F.bitwise_not(value)))


def extend_side(frame: DataFrame, name: str, pattern: list[str], text: list[str], width: int, k: int) -> DataFrame:
    """Add `{name}_differences` and `{name}_aligned`, drop the planes, and rows beyond k edits.

    pattern: planes of ``width`` bases, padding behind its end, first base lowest. text: planes of
    width + 2k bases whose base k is the first. The text ends at its first padding. Least edits
    first, then the shortest prefix of the text.
    """
    ended = lambda planes: reduce(lambda a, b: a.bitwiseAND(b), [F.col(p) for p in planes])
    beyond = -1 << width
    frame = frame.withColumns(
        {
            f"{name}_end": ended(pattern).bitwiseOR(F.lit(beyond).cast("bigint")),
            f"{name}_stop": _right(ended(text), k).bitwiseOR(F.lit(beyond).cast("bigint")),
        }
    )
    m, n = F.col(f"{name}_m"), F.col(f"{name}_n")
    masks = {}
    for d in range(-k, k + 1):
        differ = [F.col(a).bitwiseXOR(_right(F.col(b), k + d)) for a, b in zip(pattern, text)]
        masks[f"{name}_x{d + k}"] = reduce(lambda a, b: a.bitwiseOR(b), [*differ, F.col(f"{name}_end")])
    frame = frame.withColumns(
        {
            f"{name}_m": zeros_below(F.col(f"{name}_end")),
            f"{name}_n": zeros_below(F.col(f"{name}_stop")),
            **masks,
        }
    )
    # The last row of each diagonal, or NOWHERE if it has none.
    last = {f"{name}_y{d + k}": F.least(m, n - d) for d in range(-k, k + 1)}
    last = {c: F.when(end < 0, NOWHERE).otherwise(end) for c, end in last.items()}
    frame = in_own_method(frame.drop(*pattern, *text, f"{name}_end", f"{name}_stop").withColumns(last).drop(f"{name}_n"))
    row = lambda e, d: F.col(f"{name}_{e}_{d + k}")
    for e in range(k + 1):
        if e > 1:
            frame = in_own_method(frame)
        begin = {}
        for d in range(-e, e + 1):
            if e == 0:
                before = [F.lit(0)]
            else:
                inside = lambda x, e=e: abs(x) <= e - 1
                before = [row(e - 1, d) + 1] if inside(d) else []
                before += [row(e - 1, d - 1)] if inside(d - 1) else []
                before += [row(e - 1, d + 1) + 1] if inside(d + 1) else []
            furthest = F.greatest(*before) if len(before) > 1 else before[0]
            begin[f"{name}_{e}_{d + k}"] = F.least(furthest, F.col(f"{name}_y{d + k}"))
        frame = frame.withColumns(begin)
        slid = {}
        for d in range(-e, e + 1):
            at = row(e, d)
            matched = zeros_below(_right(F.col(f"{name}_x{d + k}"), at))
            slid[f"{name}_{e}_{d + k}"] = F.least(at + matched, F.col(f"{name}_y{d + k}"))
        frame = frame.withColumns(slid)
        # Least edits first, then the shortest prefix; BEYOND where no diagonal is at its end yet.
        ends = F.coalesce(*[F.when(row(e, d) == m, e * 256 + d + 128) for d in range(-e, e + 1)], F.lit(BEYOND))
        known = f"{name}_found"
        ends = F.when(F.col(known) != BEYOND, F.col(known)).otherwise(ends) if e else ends
        frame = frame.withColumn(known, ends).drop(*[f"{name}_{e - 1}_{d + k}" for d in range(1 - e, e)])
    used = [f"{name}_{k}_{d + k}" for d in range(-k, k + 1)] + list(masks) + list(last)
    frame = in_own_method(frame.drop(*used)).where(F.col(f"{name}_found") != BEYOND)
    return frame.withColumns(
        {
            f"{name}_differences": F.call_function("shiftright", F.col(f"{name}_found"), F.lit(8)),
            f"{name}_aligned": F.col(f"{name}_m") + F.col(f"{name}_found").bitwiseAND(F.lit(255)) - 128,
        }
    ).drop(f"{name}_found", f"{name}_m")
