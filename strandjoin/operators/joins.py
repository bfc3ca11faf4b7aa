"""The approximate substring join: seed equi-join plus verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.generated import in_own_method
from ..params import AlignParams
from ..sources.shared import written_once
from .seeds import (
    frame_columns,
    packed_reference_seeds,
    salt_reads,
    salt_reference,
)
from .verify import group_lookup, mark_mismatches, project_alignments, verify_candidates

# Upper bound of the list of seeds that get salts; it is collected, so it must stay small.
MAX_SALTED_SEEDS = 65_536
# Upper bound of the list of seeds with an extended key; it is broadcast.
MAX_REFINED_SEEDS = 500_000
# Most rows of the key filter, of 64 bits each; it is broadcast.
MAX_FILTER_WORDS = 1 << 20
# Bits of the filter for each key: one place in so many passes by chance.
FILTER_BITS_PER_KEY = 64
# A read side that holds at most one in so many possible seeds leaves few places; those are
# written once instead of being derived again for each use.
SELECTIVE = 16
# Frames of more words are compared behind the join: within it, the code that makes the places and
# the code that compares them would be one method, too large to be compiled.
MAX_JOINED_WORDS = 4


def seed_join(read_seeds: DataFrame, reference_seeds: DataFrame, *keys: str) -> DataFrame:
    """Inner many-to-many join of two seed tables on the seed (and salt, if named)."""
    return read_seeds.join(reference_seeds, list(keys) or ["seed"], "inner")


def salted_seed_join(
    read_seeds: DataFrame, reference_seeds: DataFrame, redundancy: int
) -> DataFrame:
    """Same rows as :func:`seed_join`, with one-letter seeds spread over several keys."""
    return seed_join(
        salt_reads(read_seeds, redundancy),
        salt_reference(reference_seeds, redundancy),
        "seed",
        "salt",
    ).drop("salt")


def has_repeated_ids(reads: DataFrame) -> bool:
    """Whether an id names more than one row; one small job over the ids."""
    repeated = reads.groupBy("read_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return not repeated.isEmpty()


def distinct_reads(reads: DataFrame) -> DataFrame:
    """One row per read text: (read_id of the first copy, seq, copies).

    Copies are combined before the shuffle, so a text that makes up a third of the table
    neither skews it nor multiplies the candidates.
    """
    return reads.groupBy("seq").agg(
        F.min("read_id").alias("read_id"), F.count(F.lit(1)).alias("copies")
    )


@dataclass(frozen=True)
class ReadStats:
    """Bounded summary of the read side that decides between physical plans."""

    tile_rows: int
    max_fanout: int
    max_copies: int
    seeds: int = 0  # different seeds

    def refine_threshold(self, params: AlignParams) -> int:
        """Fan-out above which a seed is refined; raised so that the list of such seeds is bounded."""
        return max(params.refine_fanout, self.tile_rows // MAX_REFINED_SEEDS)

    def refines(self, params: AlignParams) -> bool:
        return self.max_fanout > self.refine_threshold(params)

    def estimated_bytes(self, params: AlignParams) -> int:
        """Size of the read side as a hashed relation: eight bytes a column and the row overhead."""
        columns, rows = 6 + params.frame_words, self.tile_rows
        if self.refines(params):
            columns += 1 + params.frame_words
            rows *= params.k + 1
        return rows * (8 * columns + 32)


def read_stats(tiles: DataFrame) -> ReadStats:
    """One small job over the reads: a partial aggregate by seed, then a single row.

    ``tiles`` come from :func:`packed_read_tiles` of distinct reads.
    """
    per_seed = tiles.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies")
    )
    row = per_seed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("fanout"),
        F.coalesce(F.max("copies"), F.lit(0)).alias("copies"),
        F.count(F.lit(1)).alias("seeds"),
    ).first()
    return ReadStats(row["rows"], row["fanout"], row["copies"], row["seeds"])


def refine_hot_seeds(
    positions: DataFrame, tiles: DataFrame, params: AlignParams, threshold: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides keyed by (seed, sub, x0, ...) so that crowded seeds are split by content.

    ``sub`` is -1 on ordinary seeds and names a tile and a group on hot ones, where x0.. are the
    bases of that group. A place becomes a row for each tile and group, a read tile for each of
    its groups. The hot list is broadcast: more than ``threshold`` tiles share each of its
    seeds, hence it has fewer than tile_rows / threshold entries.
    """
    first_tiles, k1 = params.min_len // params.seed_len, params.k + 1
    hot = F.broadcast(
        tiles.groupBy("seed")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > threshold)
        .select("seed", F.lit(True).alias("hot"))
    )
    # Tiles past min_len (mixed lengths) keep the plain key on hot seeds too.
    lowest = -1 if params.n_tiles > first_tiles else 0
    of_place = F.sequence(F.lit(lowest), F.lit(first_tiles * k1 - 1))
    of_tile = F.sequence(F.col("tile") * k1, F.col("tile") * k1 + params.k)
    plain = F.array(F.lit(-1))
    extended = F.col("hot").isNotNull()
    lookup = group_lookup(params)

    def keyed(side: DataFrame, choice: Column, prefix: str) -> DataFrame:
        rows = side.join(hot, "seed", "left").select("*", F.explode(choice).alias("sub"))
        frame = frame_columns(prefix, params)
        keys = {
            f"x{i}": F.when(F.col("sub") < 0, F.lit(0).cast("bigint")).otherwise(
                word.bitwiseAND(F.get(masks, F.col("sub")))
            )
            for i, (word, masks) in enumerate(zip(frame, lookup))
        }
        return rows.drop("hot").withColumns(keys)

    return (
        keyed(positions, F.when(extended, of_place).otherwise(plain), "c"),
        keyed(
            tiles,
            F.when(extended & (F.col("tile") < first_tiles), of_tile).otherwise(plain),
            "f",
        ),
        ["seed", "sub", *[f"x{i}" for i in range(params.frame_words)]],
    )


def salt_heavy_seeds(
    positions: DataFrame, tiles: DataFrame, params: AlignParams
) -> tuple[DataFrame, DataFrame, bool]:
    """Spread seeds with very many places over salts and copy their read tiles to each salt.

    The list comes from a partially aggregated count of places by seed. Only its heaviest
    entries are collected; a seed that misses the cut is lighter than all of them, and which
    seeds get salts never changes the result.
    """
    heavy = (
        positions.groupBy("seed")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > params.salt_rows)
        .select("seed", F.ceil(F.col("n") / params.salt_rows).cast("int").alias("salts"))
        .orderBy(F.desc("salts"), "seed")
        .limit(MAX_SALTED_SEEDS)
        .collect()
    )
    if not heavy:
        return positions, tiles, False
    salts = F.broadcast(
        positions.sparkSession.createDataFrame(heavy, "seed bigint, salts int")
    )
    n = F.coalesce("salts", F.lit(1))
    spread = positions.join(salts, "seed", "left").withColumn(
        "salt", F.pmod(F.xxhash64("ref_id", "pos"), n).cast("int")
    )
    copied = tiles.join(salts, "seed", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), n - 1))
    )
    return spread.drop("salts"), copied.drop("salts"), True


def keep_read_keys(
    positions: DataFrame, tiles: DataFrame, keys: list[str], n_keys: int, key_len: int | None = None
) -> DataFrame:
    """Places whose key some read tile may have, found out in the scan of the reference.

    The keys of the read side are bits of BIGINT words, at most MAX_FILTER_WORDS rows, which are
    broadcast. Plain seeds of up to nine bases (``key_len``) number their bits themselves, so
    that exactly the places with a matching key stay; longer keys are hashed, and a place without
    one passes with a chance of keys / bits. A read side with more keys than half of the bits
    would let most places pass, and gets no filter.
    """
    one = F.lit(1).cast("bigint")
    if key_len is not None and 3 * key_len <= 27:
        number = F.col(keys[0])
    else:
        words = 1 << 10
        while words < MAX_FILTER_WORDS and words * 64 < n_keys * FILTER_BITS_PER_KEY:
            words *= 2
        if 2 * n_keys > words * 64:
            return positions
        number = F.pmod(F.xxhash64(*keys), F.lit(words * 64))
    word = F.call_function("shiftright", number, F.lit(6)).alias("filter_word")
    bit = F.call_function("shiftleft", one, number.bitwiseAND(F.lit(63)).cast("int"))
    wanted = tiles.select(word, bit.alias("bit")).groupBy("filter_word")
    wanted = F.broadcast(wanted.agg(F.bit_or("bit").alias("filter_bits")))
    met = positions.withColumn("filter_word", word).join(wanted, "filter_word")
    return met.where(F.col("filter_bits").bitwiseAND(bit) != 0).select(*positions.columns)


def seed_space(params: AlignParams) -> int:
    return 4**params.key_len


def join_packed_seeds(
    positions: DataFrame, tiles: DataFrame, params: AlignParams, stats: ReadStats, refine: bool
) -> DataFrame:
    """Seed equi-join of reference places with read tiles.

    A read side of checked size is broadcast and the reference is never shuffled. Beyond that
    both sides are shuffled by seed, with heavy seeds salted; as long as a partition of the read
    side fits into a hash table the reference need not be sorted. Places without a matching key
    are dropped before the exchange; where few are left, they are written once. With ``refine``
    seeds that have many read tiles get an extended key in either case.
    """
    keys = ["seed"]
    broadcast = uses_broadcast(params, stats)
    salted = False
    if not broadcast:
        positions = keep_read_keys(positions, tiles, keys, stats.seeds, params.key_len)
        if stats.seeds * SELECTIVE <= seed_space(params):
            positions = written_once(positions, "places")
        positions, tiles, salted = salt_heavy_seeds(positions, tiles, params)
    if refine:
        positions, tiles, keys = refine_hot_seeds(
            positions, tiles, params, stats.refine_threshold(params)
        )
        if not broadcast:
            most = stats.tile_rows * (params.k + 1)
            positions = keep_read_keys(positions, tiles, keys, most)
    if salted:
        keys = [*keys, "salt"]
    if broadcast:
        hint = "broadcast"
    else:
        partitions = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fits = stats.estimated_bytes(params) <= partitions * params.hash_bytes
        hint = "shuffle_hash" if fits else "merge"
    return positions.join(tiles.hint(hint), keys, "inner")


def find_candidates(
    sequences: DataFrame, tiles: DataFrame, params: AlignParams, stats: ReadStats
) -> DataFrame:
    """Places and read tiles with a seed in common, with their mismatches marked.

    On hot seeds only those that also agree on one more group of bases, as all hits do.
    """
    positions = packed_reference_seeds(sequences, params)
    tiles = tiles.drop("digits", "copies")
    joined = join_packed_seeds(positions, tiles, params, stats, stats.refines(params))
    if params.frame_words > MAX_JOINED_WORDS:
        joined = in_own_method(joined)
    return mark_mismatches(joined, params)


def uses_broadcast(params: AlignParams, stats: ReadStats) -> bool:
    """Only a read side of measured size is broadcast; no setting forces it."""
    return params.strategy == "auto" and stats.estimated_bytes(params) <= params.broadcast_bytes


def approx_substring_join(
    sequences: DataFrame,
    tiles: DataFrame,
    params: AlignParams,
    stats: ReadStats,
    edits: bool = False,
) -> DataFrame:
    """All places where a read lies within k substitutions of the reference, each once.

    ``tiles`` should come from distinct reads; copies are cheaper to bring back afterwards.
    """
    candidates = find_candidates(sequences, tiles, params, stats)
    return project_alignments(verify_candidates(candidates, params), params, edits)
