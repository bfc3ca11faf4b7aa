"""Registered queries: every operator of the package over the given tables."""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from strandjoin import AlignParams, align, align_best, align_unique, fixtures, run_alignment  # noqa: E402
from strandjoin.functions import bases as B  # noqa: E402
from strandjoin.functions import edits as E  # noqa: E402
from strandjoin.functions.packing import unpack_seed  # noqa: E402
from strandjoin.operators import gapped, joins, select, seeds, sequences, verify  # noqa: E402
from strandjoin.plans.index import align_indexed, build_seed_index, open_seed_index  # noqa: E402
from strandjoin.sources import alignments as A  # noqa: E402
from strandjoin.sources import sequence_files as Q  # noqa: E402
from strandjoin.sources import sequences as S  # noqa: E402
from strandjoin.sources.shared import scratch_path  # noqa: E402

PARAMS = AlignParams()


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.prepare_reads(fixtures.reads(spark, sf_dir), PARAMS)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.reference(spark, sf_dir), fixtures.reads(spark, sf_dir)


def _align_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(*_inputs(spark, sf_dir))


def normalize_bases(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return documents.select("doc_id", B.normalize_bases(letters).alias("seq"))


def reverse_complement(spark, sf_dir):
    reference = fixtures.reference(spark, sf_dir)
    return reference.select("seq_id", B.reverse_complement(F.col("seq")).alias("seq"))


def expand_strands(spark, sf_dir):
    return sequences.expand_strands(fixtures.reads(spark, sf_dir))


def assert_read_length(spark, sf_dir):
    items = fixtures.items(spark, sf_dir).withColumnRenamed("item_id", "read_id")
    lengths = AlignParams(k=11, min_len=150, max_len=200, on_bad_length="drop")
    return sequences.assert_read_length(items, lengths)


def _align_with(spark, sf_dir, params):
    reads = fixtures.reads(spark, sf_dir, params)
    return align(fixtures.reference(spark, sf_dir), reads, params)


def align_exact(spark, sf_dir):
    """No difference allowed: one tile of 36 bases."""
    return _align_with(spark, sf_dir, AlignParams(k=0))


def align_long_reads(spark, sf_dir):
    """Reads of 76 bases, whose tiles are longer than the key of the join."""
    return _align_with(spark, sf_dir, AlignParams(min_len=76, max_len=76))


def filter_ambiguous_reads(spark, sf_dir):
    return sequences.filter_ambiguous_reads(fixtures.reads(spark, sf_dir), PARAMS)


def chunk_sequences(spark, sf_dir):
    chunks = sequences.chunk_sequences(fixtures.reference(spark, sf_dir), PARAMS, 2048)
    return sequences.chunk_ownership(chunks, PARAMS)


def _seed_text():
    return unpack_seed(F.col("seed"), PARAMS.seed_len)


def reference_seeds(spark, sf_dir):
    """Counted as packed numbers; only the grouped rows become text."""
    found = seeds.packed_reference_seeds(fixtures.reference(spark, sf_dir), PARAMS)
    counted = found.groupBy("seed").agg(
        F.count(F.lit(1)).alias("places"),
        F.min("pos").alias("first_pos"),
        F.sum("pos").alias("pos_sum"),
    )
    return counted.withColumn("seed", _seed_text())


def reference_seed_flanks(spark, sf_dir):
    found = seeds.reference_seeds(fixtures.reference(spark, sf_dir), PARAMS, flanks=True)
    text = F.concat_ws("-", "left_flank", "seed", "right_flank")
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return found.groupBy("ref_id").agg(
        F.count(F.lit(1)).alias("places"),
        F.sum(F.length("left_flank")).alias("left_bases"),
        F.sum(F.length("right_flank")).alias("right_bases"),
        F.sum(digest).alias("digest"),
    )


def read_seeds(spark, sf_dir):
    return seeds.read_seeds(_reads(spark, sf_dir), PARAMS, flanks=True)


def pack_kmer(spark, sf_dir):
    found = seeds.packed_reference_seeds(fixtures.reference(spark, sf_dir), PARAMS)
    kmers = found.select("seed").distinct().select(_seed_text().alias("seed"))
    return kmers.select("seed", B.pack_kmer(F.col("seed")).alias("packed"))


def homopolymer_seeds(spark, sf_dir):
    found = seeds.reference_seeds(fixtures.reference(spark, sf_dir), PARAMS)
    repeats = found.where(B.is_homopolymer(F.col("seed")))
    return repeats.groupBy("ref_id", "seed").agg(F.count(F.lit(1)).alias("places"))


def salted_reference_seeds(spark, sf_dir):
    found = seeds.reference_seeds(fixtures.reference(spark, sf_dir), PARAMS)
    salted = seeds.salt_reference(found, PARAMS.redundancy)
    return salted.groupBy("seed", "salt").agg(
        F.count(F.lit(1)).alias("places"), F.sum("pos").alias("pos_sum")
    )


def salted_read_seeds(spark, sf_dir):
    return seeds.salt_reads(seeds.read_seeds(_reads(spark, sf_dir), PARAMS), PARAMS.redundancy)


def _tiles(spark, sf_dir):
    """Packed tiles of all reads, and their statistics."""
    reads = _reads(spark, sf_dir).withColumn("copies", F.lit(1))
    tiles = seeds.packed_read_tiles(reads, PARAMS)
    return tiles, joins.read_stats(tiles)


def seed_candidates_per_read(spark, sf_dir):
    tiles, stats = _tiles(spark, sf_dir)
    places = seeds.packed_reference_seeds(fixtures.reference(spark, sf_dir), PARAMS)
    joined = joins.join_packed_seeds(places, tiles, PARAMS, stats, refine=False)
    return joined.groupBy("read_id", "is_rc").agg(F.count(F.lit(1)).alias("candidates"))


def salted_seed_join(spark, sf_dir):
    reads = seeds.read_seeds(_reads(spark, sf_dir), PARAMS).withColumnRenamed("pos", "tile_start")
    reference = seeds.reference_seeds(fixtures.reference(spark, sf_dir), PARAMS)
    joined = joins.salted_seed_join(reads, reference, PARAMS.redundancy)
    return joined.groupBy("read_id", "is_rc", "tile_start").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("pos").alias("pos_sum")
    )


def k_mismatch_verify(spark, sf_dir):
    """Candidates within k, before repeated finds of a place are dropped."""
    tiles, stats = _tiles(spark, sf_dir)
    reference = fixtures.reference(spark, sf_dir)
    candidates = joins.find_candidates(reference, tiles, PARAMS, stats)
    close = verify.within_k(candidates, PARAMS)
    differences = verify.count_differences(PARAMS).cast("int").alias("differences")
    counted = close.groupBy("read_id", "is_rc", differences)
    return counted.agg(F.count(F.lit(1)).alias("clean_tiles"))


def align_all_shuffled(spark, sf_dir):
    return align(*_inputs(spark, sf_dir), AlignParams(strategy="shuffle", salt_rows=1024))


def align_stored_index(spark, sf_dir):
    """One stored index, opened by its path and searched with two read sets, neither broadcast."""
    params = AlignParams(strategy="shuffle", salt_rows=1 << 14)
    reference, every = _inputs(spark, sf_dir)
    path = scratch_path(spark, "index")
    build_seed_index(reference, path, params)
    index = open_seed_index(spark, path, params)
    odd = F.shiftright("read_id", fixtures.TILE_BITS) % 2 == 1
    found = [
        align_indexed(index, every.where(chosen), params).withColumn("read_set", F.lit(name))
        for name, chosen in (("odd", odd), ("even", ~odd))
    ]
    return found[0].unionByName(found[1])


def align_all_refined(spark, sf_dir):
    return align(*_inputs(spark, sf_dir), AlignParams(refine_fanout=1))


def align_all_chunked(spark, sf_dir):
    reference, reads = _inputs(spark, sf_dir)
    return align(sequences.chunk_sequences(reference, PARAMS, 2048), reads)


def align_mixed_chunks(spark, sf_dir):
    """Stored chunks of two lengths and overlaps, whose ranges follow from their neighbours."""
    reference, reads = _inputs(spark, sf_dir)
    wide = AlignParams(chunk_overlap=1500)
    by_id = F.col("seq_id") % 2 == 0
    chunks = sequences.chunk_sequences(reference.where(by_id), PARAMS, 2048).unionByName(
        sequences.chunk_sequences(reference.where(~by_id), wide, 3000)
    )
    return align(sequences.assign_chunk_ranges(chunks, PARAMS), reads)


def best_hit(spark, sf_dir):
    return align_best(*_inputs(spark, sf_dir))


def unique(spark, sf_dir):
    return align_unique(*_inputs(spark, sf_dir))


def ambiguous_reads(spark, sf_dir):
    return select.ambiguous_reads(_align_all(spark, sf_dir), PARAMS.k)


def alignment_count(spark, sf_dir):
    return select.count_alignments(unique(spark, sf_dir))


def alignment_summary(spark, sf_dir):
    return select.alignment_summary(_align_all(spark, sf_dir))


def mismatch_positions(spark, sf_dir):
    found = align(*_inputs(spark, sf_dir), edits=True)
    at = F.col("mismatch_positions")
    runs = E.edit_runs(at, (F.col("ref_end") - F.col("ref_start")).cast("int"))
    return found.select(
        "read_id",
        "ref_id",
        "ref_start",
        "is_rc",
        F.array_join(at, ",").alias("positions"),
        F.array_join(runs, ",").alias("runs"),
    )


def overlap_mismatch(spark, sf_dir):
    items = fixtures.items(spark, sf_dir)
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("next"))
    compared = items.join(following, "item_id").select(
        "item_id",
        E.k_mismatch(F.col("seq"), F.col("next"), 120, require_full=False).alias("m"),
    )
    return compared.where("m IS NOT NULL").select("item_id", "m.aligned_len", "m.differences")


def k_difference_extend(spark, sf_dir):
    """Right-hand extension of every candidate."""
    tiles, stats = _tiles(spark, sf_dir)
    candidates = gapped.gapped_candidates(
        fixtures.reference(spark, sf_dir), tiles, PARAMS, stats, prune=False
    )
    extended = candidates.select(
        "read_id",
        "is_rc",
        "ref_id",
        "pos",
        "tile_start",
        E.k_difference(F.col("ref_right"), F.col("read_right"), PARAMS.k).alias("r"),
    )
    return extended.where("r IS NOT NULL").select(
        "read_id", "is_rc", "ref_id", "pos", "tile_start", "r.differences", "r.aligned_len"
    )


def align_all_gapped(spark, sf_dir):
    return align(*_inputs(spark, sf_dir), AlignParams(allow_differences=True))


def gapped_edits(spark, sf_dir):
    """The read rebuilt from its place and its edits, their number and what they add in length."""
    found = align(*_inputs(spark, sf_dir), AlignParams(allow_differences=True), edits=True)
    of_kind = lambda op: F.size(F.filter("edits", lambda e: e["op"] == op))
    return found.select(
        "read_id",
        "ref_id",
        "ref_start",
        "ref_end",
        "is_rc",
        F.size("edits").alias("n_edits"),
        (of_kind("reference_base") - of_kind("read_base")).alias("longer_by"),
        E.replay_edits(F.col("ref_text"), F.col("read_text"), F.col("edits")).alias("seq"),
    )


def gapped_edit_arrays(spark, sf_dir):
    """Distances between edits and their codes, gaps included."""
    found = align(*_inputs(spark, sf_dir), AlignParams(allow_differences=True), edits=True)
    arrays = E.edit_arrays(F.col("edits"), F.length("read_text"))
    listed = found.select("read_id", "ref_id", "ref_start", "ref_end", "is_rc", arrays.alias("e"))
    return listed.select(
        "read_id",
        "ref_id",
        "ref_start",
        "ref_end",
        "is_rc",
        F.array_join("e.dist", ",").alias("dist"),
        F.array_join("e.what", ",").alias("what"),
    )


def alignments_text(spark, sf_dir):
    return A.alignments_to_text(_align_all(spark, sf_dir), with_read=True)


def alignments_text_roundtrip(spark, sf_dir):
    return A.alignments_from_text(A.alignments_to_text(_align_all(spark, sf_dir)))


def encode_packed(spark, sf_dir):
    packed = S.encode_packed(fixtures.reference(spark, sf_dir))
    return packed.select(F.col("id").cast("bigint").alias("seq_id"), F.hex("value").alias("value"))


def packed_roundtrip(spark, sf_dir):
    return S.decode_packed(S.encode_packed(fixtures.reference(spark, sf_dir)))


def packed_files_roundtrip(spark, sf_dir):
    """Written as old sequence files and imported again."""
    path = scratch_path(spark, "packed")
    S.write_packed_files(S.encode_packed(fixtures.reference(spark, sf_dir)), path)
    return S.decode_packed(S.read_packed_files(spark, path))


def alignments_packed(spark, sf_dir):
    packed = A.alignments_to_packed(_align_all(spark, sf_dir))
    return packed.select(F.col("id").cast("bigint").alias("read_id"), F.hex("value").alias("value"))


def alignments_packed_roundtrip(spark, sf_dir):
    return A.alignments_from_packed(A.alignments_to_packed(_align_all(spark, sf_dir)))


def sequence_files_roundtrip(spark, sf_dir):
    """Written as sequence files by the data source and read again in splits of a megabyte."""
    path = scratch_path(spark, "sequence-files")
    Q.save_sequence_files(S.encode_packed(fixtures.reference(spark, sf_dir)), path)
    return S.decode_packed(Q.scan_sequence_files(spark, path, 1 << 20))


def alignment_files_roundtrip(spark, sf_dir):
    """The 17-byte records of all alignments, written as sequence files and read again."""
    path = scratch_path(spark, "alignment-files")
    Q.save_sequence_files(A.alignments_to_packed(_align_all(spark, sf_dir)), path)
    return A.alignments_from_packed(Q.scan_sequence_files(spark, path))


def alignments_write_read(spark, sf_dir):
    path = scratch_path(spark, "alignments")
    A.write_alignments(_align_all(spark, sf_dir), path)
    return A.read_alignments(spark, path)


def complete_job(spark, sf_dir):
    """The rows of both tables as the job wrote them, with the number it reports for each."""
    path = scratch_path(spark, "job")
    summary = run_alignment(*_inputs(spark, sf_dir), path)
    tables = (
        ("alignments", f"{path}-alignments", summary.alignments),
        ("unambiguous", path, summary.unambiguous),
    )
    every, ranked = (
        A.read_alignments(spark, where).select(
            F.lit(name).alias("kind"), "*", F.lit(n).cast("bigint").alias("written")
        )
        for name, where, n in tables
    )
    return every.unionByName(ranked)


def _more(module: str, function: str) -> dict:
    """What the subpackage of training-data operators registers, if it can be imported."""
    try:
        found = dict(getattr(importlib.import_module(f"strandjoin.llm.{module}"), function)())
    except ImportError:
        return {}
    try:
        pipeline = importlib.import_module("corpus_pipeline")
    except ImportError:
        return found
    more = {"queries": pipeline.run, "oracle_sql": pipeline.ORACLE_SQL}[function]
    return found | ({"pipeline": more} if more else {})


def entry(spark: SparkSession) -> DataFrame:
    """All alignments of the reads derived from sf0.001."""
    return _align_all(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        normalize_bases,
        reverse_complement,
        expand_strands,
        assert_read_length,
        filter_ambiguous_reads,
        chunk_sequences,
        reference_seeds,
        reference_seed_flanks,
        read_seeds,
        pack_kmer,
        homopolymer_seeds,
        salted_reference_seeds,
        salted_read_seeds,
        seed_candidates_per_read,
        salted_seed_join,
        k_mismatch_verify,
        align_all_shuffled,
        align_all_refined,
        align_stored_index,
        align_all_chunked,
        align_mixed_chunks,
        best_hit,
        ambiguous_reads,
        alignment_count,
        alignment_summary,
        mismatch_positions,
        overlap_mismatch,
        k_difference_extend,
        align_all_gapped,
        gapped_edits,
        gapped_edit_arrays,
        alignments_text,
        alignments_text_roundtrip,
        encode_packed,
        packed_roundtrip,
        packed_files_roundtrip,
        alignments_packed,
        alignments_packed_roundtrip,
        sequence_files_roundtrip,
        alignment_files_roundtrip,
        alignments_write_read,
        complete_job,
        align_exact,
        align_long_reads,
    )
    named = {query.__name__: query for query in plain}
    return {"align_all": _align_all, "align_unique": unique, **named, **_more("queries", "queries")}


def oracle_sql() -> dict[str, str]:
    return {**oracle_queries.oracle_sql(), **_more("oracles", "oracle_sql")}
