"""Seeds: every position of the reference, and the tiles of each read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packing as P
from ..functions.bases import has_n, is_homopolymer
from ..params import BASES_PER_WORD, AlignParams, GridParams
from .sequences import computed_once, expand_strands, linear_split, owned_seeds, prepare_sequences


def frame_columns(prefix: str, params: AlignParams) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(params.frame_words)]


def packed_pieces(
    sequences: DataFrame,
    params: AlignParams,
    full_flanks: bool = False,
    grid: GridParams | None = None,
) -> DataFrame:
    """Sequences as pieces of 21-base words: (ref_id, offset, first, end, start, words).

    A piece starts at local position ``start``, left of which the words hold what a frame reaches;
    [first, end) are the local seed positions that the row answers for.
    """
    left, words_after = _frame_reach(params, full_flanks, grid)
    rows = prepare_sequences(sequences)
    first, end = owned_seeds(params, F.length("seq"), rows)
    # Padding on the left makes the frame of local position p start at padded index p.
    padded = F.concat(
        F.lit(P.PAD_DIGIT * left),
        P.to_digits(F.col("seq")),
        F.lit(P.PAD_DIGIT * BASES_PER_WORD * (words_after + 1)),
    )
    pieces = rows.where(F.length("seq") >= params.seed_len).select(
        F.col("seq_id").alias("ref_id"),
        "offset",
        first.cast("bigint").alias("first"),
        end.cast("bigint").alias("end"),
        F.posexplode(
            linear_split(
                padded, params.piece_len, params.piece_len + BASES_PER_WORD * words_after
            )
        ).alias("piece", "digits"),
    )
    return pieces.select(
        "ref_id",
        "offset",
        "first",
        "end",
        (F.col("piece").cast("bigint") * params.piece_len).alias("start"),
        P.pack_array(F.col("digits")).alias("words"),
    )


def _frame_reach(params: AlignParams, full_flanks: bool, grid: GridParams | None) -> tuple[int, int]:
    """Bases of a frame left of its seed, and its number of words."""
    if full_flanks:
        return params.flank_len, params.flank_words
    return (grid or params).left_reach, (grid or params).frame_words


def piece_seeds(
    packed: DataFrame,
    params: AlignParams,
    full_flanks: bool = False,
    grid: GridParams | None = None,
) -> DataFrame:
    """The seed positions of :func:`packed_pieces`, see :func:`packed_reference_seeds`."""
    left, words_after = _frame_reach(params, full_flanks, grid)
    key_len = (grid or params).key_len
    blocks_per_piece = params.piece_len // BASES_PER_WORD
    blocks = packed.select(
        "ref_id", "offset", "first", "end", "start", "words",
        # The outer form: the inner one would add a test that packs the words a second time.
        F.posexplode_outer("words").alias("block", "w0"),
    ).where(F.col("block") < blocks_per_piece)
    blocks = blocks.select(
        "ref_id", "offset", "first", "end",
        (F.col("start") + F.col("block") * BASES_PER_WORD).alias("start"),
        "w0",
        *[
            F.coalesce(F.get("words", F.col("block") + i), F.lit(P.PAD_WORD)).alias(f"w{i}")
            for i in range(1, words_after + 1)
        ],
    )
    shifts = F.sequence(F.lit(0), F.lit(BASES_PER_WORD - 1))
    if grid:
        first_shift = F.pmod(-(F.col("offset") + F.col("start")), F.lit(grid.seed_len)).cast("int")
        on_grid = F.sequence(first_shift, F.lit(BASES_PER_WORD - 1), F.lit(grid.seed_len))
        shifts = F.when(first_shift < BASES_PER_WORD, on_grid)
    places = blocks.select("*", F.explode(shifts).alias("shift"))
    frame = P.shift_words([F.col(f"w{i}") for i in range(words_after + 1)], F.col("shift"))
    local = F.col("start") + F.col("shift")
    seed = P.slice_value(frame, left, key_len)
    # N and padding are the digits with the high bit, so one test drops both.
    no_base = seed.bitwiseAND(F.lit(int(P.N_DIGIT * key_len, 8)))
    return places.where(
        (local >= F.col("first"))
        & (local < F.col("end"))
        & (F.bit_count(no_base) <= params.k if grid else no_base == 0)
    ).select(
        "ref_id",
        (F.col("offset") + local).alias("pos"),
        seed.alias("seed"),
        *[w.alias(f"c{i}") for i, w in enumerate(frame)],
    )


def packed_reference_seeds(
    sequences: DataFrame,
    params: AlignParams,
    full_flanks: bool = False,
    grid: GridParams | None = None,
) -> DataFrame:
    """One narrow row per seed position: (ref_id, pos, seed, c0, c1, ...).

    c0.. hold the frame of the position, that is all bases a read could cover whichever of
    its tiles sits on the seed, or with ``full_flanks`` the seed and ``flank_len`` bases on
    either side. seed is the first ``key_len`` bases of a tile at the position. Sequence -> pieces -> 21-base words -> positions: text is packed once per word,
    and a position costs a few shifts of neighbouring words.

    With ``grid`` only positions that are multiples of its ``seed_len``, with its seeds and frames;
    a seed may then hold as many N as a read.
    """
    pieces = packed_pieces(sequences, params, full_flanks, grid)
    return piece_seeds(pieces, params, full_flanks, grid)


def _stranded_digits(reads: DataFrame) -> DataFrame:
    """The read as octal digits once per strand: (the other columns, read_len, is_rc, digits)."""
    digits = F.col("digits")
    others = [c for c in reads.columns if c != "seq"]
    forward = P.to_digits(F.col("seq"))
    stranded = reads.select(*others, F.length("seq").alias("read_len"), forward.alias("digits"))
    return stranded.select(
        *others,
        "read_len",
        F.inline(
            F.array(
                F.struct(F.lit(False).alias("is_rc"), digits.alias("digits")),
                F.struct(
                    F.lit(True).alias("is_rc"),
                    P.complement_digits(F.reverse(digits)).alias("digits"),
                ),
            )
        ),
    )


def packed_read_tiles(reads: DataFrame, params: AlignParams) -> DataFrame:
    """Tiles of both strands, each with the read laid into the frame of that tile.

    ``reads`` is (read_id, seq) plus any other columns, prepared. Output: those other columns,
    read_id, is_rc, tile, read_len, digits, seed, need, f0, f1, ... Bit d - 1 of ``need`` says
    that the tile d places to the left could have been a seed itself (it holds no N). Columns that
    a plan does not use, such as ``digits`` of the whole read, are pruned from it.
    """
    s = params.seed_len
    digits = F.col("digits")
    others = [c for c in reads.columns if c != "seq"]
    stranded = _stranded_digits(reads)
    tiles = stranded.select(
        "*",
        F.explode(
            F.sequence(F.lit(0), F.floor(F.col("read_len") / s).cast("int") - 1)
        ).alias("tile"),
    )
    tile = F.col("tile")

    def tile_digits(index: Column | int) -> Column:
        return F.substr(digits, (F.lit(index) if isinstance(index, int) else index) * s + 1, F.lit(s))

    need = F.lit(0).cast("bigint")
    for earlier in range(params.n_tiles - 1):
        usable = (tile > earlier) & ~tile_digits(earlier).contains(P.N_DIGIT)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), tile - 1 - earlier)
        need = need + F.when(usable, bit).otherwise(0)
    frame = F.rpad(
        F.concat(F.repeat(F.lit(P.PAD_DIGIT), F.lit(params.left_reach) - tile * s), digits),
        params.frame_words * BASES_PER_WORD,
        P.PAD_DIGIT,
    )
    seed_digits = tile_digits(tile)
    return tiles.where(~seed_digits.contains(P.N_DIGIT)).select(
        *others,
        "is_rc",
        "tile",
        "read_len",
        "digits",
        F.conv(F.substring(seed_digits, 1, params.key_len), 8, 10).cast("bigint").alias("seed"),
        need.alias("need"),
        *[w.alias(f"f{i}") for i, w in enumerate(P.pack_frame(frame, params.frame_words))],
    )


def packed_read_windows(reads: DataFrame, params: AlignParams, grid: GridParams) -> DataFrame:
    """:func:`packed_read_tiles` for places on a grid: every window that may be one of the first
    k + 1 seeds of the grid that the read covers.

    Output as there, with ``start`` of the window instead of ``tile``, and ``free``: for a read with
    N, where its tiles without N start. Through one of those a place is to be reached
    (:func:`.verify.has_clean_tile`); of other reads some tile always is clean.
    """
    step, s, digits, start = grid.seed_len, params.seed_len, F.col("digits"), F.col("start")
    others = [c for c in reads.columns if c != "seq"]
    windows = _stranded_digits(reads).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(grid.left_reach))).alias("start")
    )
    frame = F.rpad(
        F.concat(F.repeat(F.lit(P.PAD_DIGIT), F.lit(grid.left_reach) - start), digits),
        grid.frame_words * BASES_PER_WORD,
        P.PAD_DIGIT,
    )
    seed = F.substr(digits, start + 1, F.lit(grid.key_len))
    earlier = F.floor(start / step).cast("int")
    need = F.call_function("shiftleft", F.lit(1).cast("bigint"), earlier) - 1
    tiles = F.sequence(F.lit(0), F.col("read_len") - s, F.lit(s))
    free = F.filter(tiles, lambda at: ~F.substr(digits, at + 1, F.lit(s)).contains(P.N_DIGIT))
    return windows.select(
        *others,
        "is_rc",
        "start",
        "read_len",
        F.when(digits.contains(P.N_DIGIT), free).alias("free"),
        F.conv(seed, 8, 10).cast("bigint").alias("seed"),
        need.alias("need"),
        *[w.alias(f"f{i}") for i, w in enumerate(P.pack_frame(frame, grid.frame_words))],
    )


def reference_seeds(sequences: DataFrame, params: AlignParams, flanks: bool = False) -> DataFrame:
    """Every N-free seed position as text: (ref_id, pos, seed[, left_flank, right_flank]).

    The left flank is stored reversed, so that both flanks read away from the seed.
    """
    s, flank, step = params.seed_len, params.flank_len, BASES_PER_WORD
    rows = prepare_sequences(sequences)
    first, end = owned_seeds(params, F.length("seq"), rows)
    # Spaces stand for "outside of the sequence"; they are trimmed off the flanks.
    padded = F.concat(F.lit(" " * flank), F.col("seq"), F.lit(" " * flank))
    pieces = rows.where(F.length("seq") >= s).select(
        F.col("seq_id").alias("ref_id"),
        "offset",
        first.cast("bigint").alias("first"),
        end.cast("bigint").alias("end"),
        F.posexplode(linear_split(padded, params.piece_len, params.piece_len + 2 * flank + s)).alias(
            "piece", "text"
        ),
    )
    # A second, finer cut keeps the per-position substrings short walks. What lies left of a seed is
    # cut from the block read backwards, which is turned once for all of its positions.
    blocks = pieces.select(
        "ref_id", "offset", "first", "end",
        (F.col("piece").cast("bigint") * params.piece_len).alias("start"),
        F.posexplode(linear_split(F.col("text"), step, step + 2 * flank + s)).alias("block", "text"),
    ).where(F.col("block") < params.piece_len // step)
    turned = [computed_once(F.reverse("text")).alias("turned")] if flanks else []
    blocks = blocks.select("*", F.length("text").alias("size"), *turned)
    places = blocks.select(
        "ref_id", "offset", "first", "end", "text", "size", *(["turned"] if flanks else []),
        (F.col("start") + F.col("block") * step).alias("start"),
        F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("shift"),
    )
    local = F.col("start") + F.col("shift")
    seed = F.substr("text", F.col("shift") + flank + 1, F.lit(s))
    owned = places.where((local >= F.col("first")) & (local < F.col("end")))
    found = owned.select("*", computed_once(seed).alias("seed")).where(~has_n(F.col("seed")))
    columns = ["ref_id", (F.col("offset") + local).alias("pos"), "seed"]
    if flanks:
        right = F.substr("text", F.col("shift") + flank + s + 1, F.lit(flank))
        left = F.substr("turned", F.col("size") - F.col("shift") - flank + 1, F.lit(flank))
        columns += [F.rtrim(left).alias("left_flank"), F.rtrim(right).alias("right_flank")]
    return found.select(*columns)


def read_seeds(reads: DataFrame, params: AlignParams, flanks: bool = False) -> DataFrame:
    """N-free tiles of both strands as text: (read_id, is_rc, pos, seed[, flanks])."""
    s = params.seed_len
    tiles = expand_strands(reads.select("read_id", "seq")).select(
        "*", F.explode(F.sequence(F.lit(0), F.length("seq") - s, F.lit(s))).alias("pos")
    )
    seed = F.substr("seq", F.col("pos") + 1, F.lit(s))
    columns = [F.col("read_id"), F.col("is_rc"), F.col("pos"), seed.alias("seed")]
    if flanks:
        columns += [
            F.reverse(F.substr("seq", F.lit(1), F.col("pos"))).alias("left_flank"),
            F.substr("seq", F.col("pos") + s + 1).alias("right_flank"),
        ]
    return tiles.where(~has_n(seed)).select(*columns)


def salt_reference(seeds: DataFrame, redundancy: int) -> DataFrame:
    """One-letter seeds once per salt, all others under salt 0."""
    if redundancy <= 1:
        return seeds.withColumn("salt", F.lit(0))
    salts = F.when(
        is_homopolymer(F.col("seed")), F.sequence(F.lit(0), F.lit(redundancy - 1))
    ).otherwise(F.array(F.lit(0)))
    return seeds.select("*", F.explode(salts).alias("salt"))


def salt_reads(seeds: DataFrame, redundancy: int) -> DataFrame:
    """One-letter seeds under the salt of their read id, all others under salt 0."""
    salt = F.when(
        is_homopolymer(F.col("seed")), F.pmod(F.col("read_id"), F.lit(redundancy))
    ).otherwise(0)
    return seeds.withColumn("salt", salt.cast("int"))
