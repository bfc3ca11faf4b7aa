"""Reference seeds stored once, bucketed by seed, for any number of read sets.

``build_seed_index`` writes one row per seed position into buckets of (seed, salt). A row holds a
frame, so the rows are many times the text; where it can, the index holds the seeds of a grid alone
(``GridParams``), and reads look up more windows instead. Seeds with very
many places get salts, whose numbers are kept beside the places, so that no bucket holds more than
its share and a search needs no count of its own. A search moves only the read tiles: they are
dealt to the same buckets, and the places are joined where they lie, already sorted.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import fold_words, unfold_words
from ..operators.joins import distinct_reads, has_repeated_ids, read_stats, uses_broadcast
from ..operators.seeds import (
    frame_columns,
    packed_pieces,
    packed_read_tiles,
    packed_read_windows,
    piece_seeds,
)
from ..operators.sequences import prepare_reads
from ..operators.verify import (
    has_clean_tile,
    mark_mismatches,
    project_alignments,
    verify_candidates,
)
from ..params import AlignParams, grid_params
from ..sources.shared import shuffle_files_cleared
from .align import Search

#: Layout of the stored table; it changes when an older one can no longer be read.
VERSION = 2
#: What the stored rows depend on.
GEOMETRY = ("seed_len", "key_len", "left_reach", "frame_words")
#: Parts in which the places are shuffled and written, one after the other.
ROUNDS = 8


@dataclass(frozen=True)
class SeedIndex:
    """An opened index: its table (ref_id, pos, seed, salt, c0.. folded), salts and number of buckets."""

    path: str
    table: str
    buckets: int

    def places(self, spark: SparkSession) -> DataFrame:
        stored = spark.table(self.table)
        names = [f"c{i}" for i in range(len(stored.columns) - 4)]
        return stored.withColumns(dict(zip(names, unfold_words([F.col(c) for c in names]))))

    def salts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("seed bigint, salts int").parquet(f"{self.path}/salts")


def _geometry(params: AlignParams) -> dict[str, int]:
    grid = grid_params(params)
    return {"step": grid.seed_len if grid else 1} | {
        name: getattr(grid or params, name) for name in GEOMETRY
    }


def _table_name(path: str) -> str:
    return f"seed_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def build_seed_index(
    sequences: DataFrame,
    path: str,
    params: AlignParams = AlignParams(),
    buckets: int | None = None,
) -> SeedIndex:
    """Write the index of ``sequences`` below ``path``, which must not hold one yet.

    It serves all searches whose tiles have the same length and reach (``GEOMETRY``).
    """
    spark = sequences.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = grid_params(params)
    # Packed once, since the salts and every round derive the places again.
    pieces = packed_pieces(sequences, params, grid=grid)
    with shuffle_files_cleared(spark):
        pieces.write.option("compression", "zstd").parquet(f"{path}/pieces")
    pieces = spark.read.schema(pieces.schema).parquet(f"{path}/pieces")
    places = piece_seeds(pieces, params, grid=grid)
    frame = frame_columns("c", grid or params)
    places = places.withColumns({f"c{i}": w for i, w in enumerate(fold_words(frame))})
    heavy = places.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > params.salt_rows)
    heavy = heavy.select("seed", F.ceil(F.col("n") / params.salt_rows).cast("int").alias("salts"))
    with shuffle_files_cleared(spark):
        heavy.write.parquet(f"{path}/salts")
    salts = spark.read.schema("seed bigint, salts int").parquet(f"{path}/salts")
    salt = F.pmod(F.xxhash64("ref_id", "pos"), F.coalesce("salts", F.lit(1))).cast("int")
    salted = places.join(salts, "seed", "left").withColumn("salt", salt).drop("salts")
    # The shuffle files of a round go before the next begins. A bucket has its one file from one round.
    bucket = F.pmod(F.hash("seed", "salt"), F.lit(buckets))
    for i in range(min(ROUNDS, buckets)):
        dealt = salted.where(bucket % ROUNDS == i).repartition(buckets, "seed", "salt")
        writer = dealt.write.format("parquet").mode("append")
        writer = writer.bucketBy(buckets, "seed", "salt").sortBy("seed", "salt")
        writer = writer.option("compression", "zstd").option("path", f"{path}/places")
        with shuffle_files_cleared(spark):
            writer.saveAsTable(_table_name(path))
    about = {"version": VERSION, "buckets": buckets, **_geometry(params)}
    # Written last: an index without it is not complete and does not open.
    spark.createDataFrame([about]).coalesce(1).write.json(f"{path}/about")
    return SeedIndex(path, _table_name(path), buckets)


def open_seed_index(spark: SparkSession, path: str, params: AlignParams = AlignParams()) -> SeedIndex:
    """The index below ``path``, after a check of its version and of what its rows depend on."""
    about = spark.read.json(f"{path}/about").first().asDict()
    if about["version"] != VERSION:
        raise ValueError(f"index of version {about['version']}, expected {VERSION}")
    wanted = _geometry(params)
    found = {name: about[name] for name in wanted}
    if found != wanted:
        raise ValueError(f"index was built for {found}, the search needs {wanted}")
    frames = ", ".join(f"c{i} BIGINT" for i in range(wanted["frame_words"]))
    table, buckets = _table_name(path), about["buckets"]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (ref_id BIGINT, pos BIGINT, seed BIGINT, {frames}, salt INT) "
        f"USING parquet CLUSTERED BY (seed, salt) SORTED BY (seed, salt) INTO {buckets} BUCKETS "
        f"LOCATION '{path}/places'"
    )
    return SeedIndex(path, table, buckets)


def align_indexed(
    index: SeedIndex, reads: DataFrame, params: AlignParams = AlignParams(), edits: bool = False
) -> DataFrame:
    """:func:`align` against a stored index; the places are neither shuffled nor sorted again.

    Tiles of a read side of checked size are broadcast; others go to the buckets of the index.
    """
    if params.allow_differences:
        raise ValueError("an index holds the frames of a search without gaps")
    return _search_index(index, reads, params, edits).rows()


def _search_index(index: SeedIndex, reads: DataFrame, params: AlignParams, edits: bool) -> Search:
    spark = reads.sparkSession
    prepared = prepare_reads(reads, params)
    repeated = has_repeated_ids(prepared)
    distinct = prepared.withColumn("copies", F.lit(1)) if repeated else distinct_reads(prepared)
    grid = grid_params(params)
    tiles = packed_read_windows(distinct, params, grid) if grid else packed_read_tiles(distinct, params)
    stats = read_stats(tiles)
    tiles = tiles.drop("digits", "copies")
    held = grid or params
    places = index.places(spark)
    if uses_broadcast(held, stats):
        joined = places.drop("salt").join(tiles.hint("broadcast"), "seed")
    else:
        salts = index.salts(spark)
        every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        copied = tiles.join(salts, "seed", "left").withColumn("salt", F.explode(every)).drop("salts")
        dealt = copied.repartition(index.buckets, "seed", "salt")
        fits = stats.estimated_bytes(held) <= index.buckets * params.hash_bytes
        joined = places.join(dealt.hint("shuffle_hash" if fits else "merge"), ["seed", "salt"])
    verified = verify_candidates(mark_mismatches(joined, held), held)
    if grid:
        verified = verified.where(has_clean_tile(params, grid))
    hits = project_alignments(verified, held, edits, F.col("start") if grid else None)
    return Search(prepared, distinct, stats, held, hits)
