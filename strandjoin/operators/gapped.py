"""Alignment with insertions and deletions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packing as P
from ..functions.diagonals import MAX_WIDTH, digit_planes, extend_side, plane_columns
from ..functions.generated import in_own_method
from ..functions.edits import k_difference, trace_edits
from ..params import AlignParams
from .joins import ReadStats, join_packed_seeds
from .seeds import packed_reference_seeds
from .sequences import computed_once
from .verify import any_of

OPERATIONS = ("mismatch", "reference_base", "read_base")


def _probe_size(params: AlignParams) -> int:
    """Longest stretch of which k + 1 fit beside every tile, none straddling the tile."""
    size = (params.min_len - params.seed_len) // (params.k + 1)
    sides = [
        (tile * params.seed_len, params.min_len - (tile + 1) * params.seed_len)
        for tile in range(params.min_len // params.seed_len)
    ]
    while size and any(a // size + b // size < params.k + 1 for a, b in sides):
        size -= 1
    return size


def with_probes(tiles: DataFrame, params: AlignParams) -> DataFrame:
    """Add p0..pk, disjoint stretches of the read beside the tile, and their offsets at0..atk.

    An alignment within k edits leaves one of them intact and displaces it by at most k, so it
    occurs within size + 2k bases from its offset in the flanked seed of the reference.
    """
    size = _probe_size(params)
    start = F.col("tile") * params.seed_len
    # Tiles past min_len (mixed lengths) have at least min_len - seed_len bases on their left.
    on_left = F.least(F.floor(start / size), F.lit(params.k + 1)).cast("int")
    columns = {}
    for i in range(params.k + 1):
        begin = F.when(on_left > i, i * size).otherwise(
            start + params.seed_len + (F.lit(i) - on_left) * size
        )
        columns[f"p{i}"] = F.substr("digits", begin + 1, F.lit(size))
        columns[f"at{i}"] = begin - start + params.flank_len - params.k + 1
    return tiles.withColumns(columns)


def may_align(params: AlignParams) -> Column:
    """Necessary condition, cheap enough for every candidate: one probe occurs in its range."""
    width = _probe_size(params) + 2 * params.k
    return any_of(
        [
            F.substr("around", F.col(f"at{i}"), F.lit(width)).contains(F.col(f"p{i}"))
            for i in range(params.k + 1)
        ]
    )


def extend_both_sides(candidates: DataFrame, params: AlignParams) -> DataFrame:
    """Left flank with k edits, right flank with what is left of them."""
    left = k_difference(F.col("ref_left"), F.col("read_left"), params.k)
    right = k_difference(F.col("ref_right"), F.col("read_right"), params.k)
    sided = candidates.select("*", computed_once(left).alias("l")).where("l IS NOT NULL")
    sided = sided.select("*", computed_once(right).alias("r"))
    return sided.where(F.col("l.differences") + F.col("r.differences") <= params.k)


def gapped_candidates(
    sequences: DataFrame,
    tiles: DataFrame,
    params: AlignParams,
    stats: ReadStats,
    prune: bool = True,
) -> DataFrame:
    """Seed join with the flanks of both sides as digit strings.

    Only packed words travel with a place; its text is rebuilt for candidates alone. With
    ``prune`` candidates that fail the probes are left out: they cannot align within k edits.
    """
    s, flank, words = params.seed_len, params.flank_len, params.flank_words
    places = packed_reference_seeds(sequences, params, full_flanks=True)
    kept = ["read_id", "is_rc", "tile", "digits", "seed"]
    probed = tiles.select(*kept)
    prune = prune and _probe_size(params) > 0
    if prune:
        probed = with_probes(probed, params)
    joined = join_packed_seeds(places, probed, params, stats, refine=False)
    around = P.unpack_frame([F.col(f"c{i}") for i in range(words)])
    found = joined.select("*", computed_once(around).alias("around"))
    start = F.col("tile") * s
    if params.key_len < s:
        clean = F.substring("around", flank + 1, s) == F.substr("digits", start + 1, F.lit(s))
        found = found.where(clean)
    if prune:
        found = found.where(may_align(params))
    left = F.substring("around", 1, flank)
    right = F.substring("around", flank + s + 1, flank)
    return found.select(
        "read_id",
        "is_rc",
        "ref_id",
        "pos",
        start.alias("tile_start"),
        F.substring("around", flank + 1, s).alias("seed"),
        F.reverse(F.ltrim(left, F.lit(P.PAD_DIGIT))).alias("ref_left"),
        F.rtrim(right, F.lit(P.PAD_DIGIT)).alias("ref_right"),
        F.reverse(F.substr("digits", F.lit(1), start)).alias("read_left"),
        F.substr("digits", start + s + 1).alias("read_right"),
    )


def fits_planes(params: AlignParams) -> bool:
    """A side of the longest read, with k bases more on either hand, fits a BIGINT."""
    return params.flank_len + 2 * params.k <= MAX_WIDTH


def packed_extensions(
    sequences: DataFrame, tiles: DataFrame, params: AlignParams, stats: ReadStats
) -> DataFrame:
    """Seed hits within k edits, from bit planes: no text is built for a candidate.

    (read_id, is_rc, digits, ref_id, pos, tile, c0.., l_differences, l_aligned, r_differences,
    r_aligned): the edits on either side of the seed and the bases of the reference they cover.
    """
    s, flank, k = params.seed_len, params.flank_len, params.k
    words = [f"c{i}" for i in range(params.flank_words)]
    start = F.col("tile") * s
    left = F.lpad(F.substr("digits", F.lit(1), start), flank, P.PAD_DIGIT)
    right = F.reverse(F.rpad(F.substr("digits", start + s + 1), flank, P.PAD_DIGIT))
    planes = {f"{side}_q{i}": p for side, text in (("l", left), ("r", right)) for i, p in enumerate(digit_planes(text))}
    sided = tiles.select("read_id", "is_rc", "tile", "digits", "seed", *[p.alias(name) for name, p in planes.items()])
    places = packed_reference_seeds(sequences, params, full_flanks=True)
    joined = join_packed_seeds(places, sided, params, stats, refine=False)
    if params.key_len < s:
        around = joined.select("*", computed_once(P.unpack_frame([F.col(w) for w in words])).alias("around"))
        same = F.substring("around", flank + 1, s) == F.substr("digits", start + 1, F.lit(s))
        joined = around.where(same).drop("around")
    kept = ["read_id", "is_rc", "digits", "ref_id", "pos", "tile", *words, *planes]
    apart = in_own_method(joined.select(*kept))
    regions = {"l_t": (0, flank + k, False), "r_t": (flank + s - k, 2 * flank + s + k, True)}
    found = plane_columns(apart, words, regions)
    for side in ("l", "r"):
        names = [[f"{side}_{kind}{i}" for i in range(3)] for kind in ("q", "t")]
        found = extend_side(found, side, *names, flank, k)
    return found.where(F.col("l_differences") + F.col("r_differences") <= k)


def _text_extensions(
    sequences: DataFrame, tiles: DataFrame, params: AlignParams, stats: ReadStats
) -> DataFrame:
    """The columns of :func:`placed_extensions` for sides too long for one BIGINT."""
    extended = extend_both_sides(gapped_candidates(sequences, tiles, params, stats), params)
    return extended.select(
        "read_id",
        "is_rc",
        "ref_id",
        "pos",
        F.col("l.differences").alias("l_differences"),
        F.col("l.aligned_len").alias("l_aligned"),
        F.col("r.differences").alias("r_differences"),
        F.col("r.aligned_len").alias("r_aligned"),
        P.from_digits(
            F.concat(
                F.reverse(F.substr("ref_left", F.lit(1), F.col("l.aligned_len"))),
                "seed",
                F.substr("ref_right", F.lit(1), F.col("r.aligned_len")),
            )
        ).alias("ref_text"),
        P.from_digits(F.concat(F.reverse("read_left"), "seed", "read_right")).alias("read_text"),
    )


def placed_extensions(
    sequences: DataFrame, tiles: DataFrame, params: AlignParams, stats: ReadStats
) -> DataFrame:
    """Seed hits within k edits: read_id, is_rc, ref_id, pos, the edits and reach of both sides,
    ref_text and read_text."""
    if not fits_planes(params):
        return _text_extensions(sequences, tiles, params, stats)
    found = packed_extensions(sequences, tiles, params, stats)
    around = P.unpack_frame([F.col(f"c{i}") for i in range(params.flank_words)])
    begin = F.lit(params.flank_len + 1) - F.col("l_aligned")
    length = F.col("l_aligned") + F.lit(params.seed_len) + F.col("r_aligned")
    return found.select(
        "read_id", "is_rc", "ref_id", "pos", "l_differences", "l_aligned", "r_differences", "r_aligned",
        P.from_digits(F.substr(around, begin, length)).alias("ref_text"),
        P.from_digits(F.col("digits")).alias("read_text"),
    )


def gapped_substring_join(
    sequences: DataFrame,
    tiles: DataFrame,
    params: AlignParams,
    stats: ReadStats,
    edits: bool = False,
) -> DataFrame:
    """All places within k edits; one row per (read, strand, start, end), with least edits.

    The same place is reached through several tiles and several seed positions, so here the
    rows are combined by an aggregate instead of by a test on the tiles. With ``edits`` also both
    texts and the list of edits between them.
    """
    extended = placed_extensions(sequences, tiles, params, stats)
    texts = ["ref_text", "read_text"] if edits else []
    rows = extended.select(
        "read_id",
        "ref_id",
        (F.col("pos") - F.col("l_aligned")).alias("ref_start"),
        (F.col("pos") + params.seed_len + F.col("r_aligned")).alias("ref_end"),
        (F.col("l_differences") + F.col("r_differences")).alias("differences"),
        "is_rc",
        *texts,
    )
    keys = ["read_id", "ref_id", "ref_start", "ref_end", "is_rc"]
    # Both texts are functions of the key, so any of them will do.
    best = rows.groupBy(*keys).agg(F.min("differences").alias("differences"), *[F.min(c).alias(c) for c in texts])
    columns = ["read_id", "ref_id", "ref_start", "ref_end", "differences", "is_rc"]
    if not edits:
        return best.select(*columns)
    traced = trace_edits(F.col("ref_text"), F.col("read_text"), params.k)
    return best.select(*columns, *texts, computed_once(traced).alias("edits"))


def edit_tracer() -> Callable:
    """A function of reference and read texts that finds one least-cost set of edits for each.

    Of two texts it returns the list of (pos, op); of two lists two tables of (row, step): the read position and the index in OPERATIONS, -1
    where a step is no edit. All rows of a batch take each step of the table together. For texts in
    hand; searches trace with :func:`strandjoin.functions.edits.trace_edits`.
    """

    names = OPERATIONS

    def letters(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(v) for v in values])
        width = max(1, lengths.max(initial=0))
        return np.array(values, dtype=f"U{width}").view(np.uint32).reshape(len(values), width), lengths

    def trace(texts: str | list[str], patterns: str | list[str]) -> list | tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, str):
            places, operations = trace([texts], [patterns])
            return [(int(p), names[o]) for p, o in zip(places[0], operations[0]) if o >= 0]
        (text, n), (pattern, m) = letters(texts), letters(patterns)
        steps = np.arange(text.shape[1] + 1, dtype=np.int32)[:, None]
        cost = np.empty((pattern.shape[1] + 1, len(steps), len(texts)), dtype=np.int32)
        cost[0] = steps
        for i in range(1, len(cost)):
            above, row = cost[i - 1], cost[i]
            row[0] = i
            differ = text.T != pattern[:, i - 1]
            np.minimum(above[:-1] + differ, above[1:] + 1, out=row[1:])
            # A run of reference bases costs one each: the least start of such a run wins.
            row[:] = np.minimum.accumulate(row - steps, axis=0) + steps
        at, i, j = np.arange(len(texts)), m.copy(), n.copy()
        places, operations = [], []
        while ((i > 0) | (j > 0)).any():
            here, up, back = cost[i, j, at], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            differ = pattern[at, up] != text[at, back]
            both = (i > 0) & (j > 0) & (here == cost[up, back, at] + differ)
            from_text = ~both & (j > 0) & (here == cost[i, back, at] + 1)
            from_pattern = ~both & ~from_text & (i > 0)
            i, j = i - (both | from_pattern), j - (both | from_text)
            places.append(i)
            operations.append(np.select([both & differ, from_text, from_pattern], [0, 1, 2], -1))
        shape = (len(places), len(texts))
        return tuple(np.array(x, dtype=np.int32).reshape(shape).T[:, ::-1] for x in (places, operations))

    return trace
