"""The stored seed index: same rows, no exchange of the reference, checked when opened."""

import random

import pytest
from model import alignments, planted

from strandjoin import AlignParams
from strandjoin.functions.packing import PAD_WORD, fold_words, unfold_words
from strandjoin.operators.sequences import chunk_sequences
from strandjoin.params import grid_params
from strandjoin.plans.index import align_indexed, build_seed_index, open_seed_index

SEQUENCES = "seq_id bigint, seq string"
READS = "read_id bigint, seq string"
SHUFFLE = AlignParams(strategy="shuffle", salt_rows=3)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    sequences, reads = planted(31)
    path = f"file://{tmp_path_factory.mktemp('index')}/one"
    build_seed_index(spark.createDataFrame(sequences, SEQUENCES), path, SHUFFLE, buckets=8)
    return path, sequences, reads


@pytest.mark.parametrize(
    "params", [SHUFFLE, AlignParams(), AlignParams(strategy="shuffle", hash_bytes=1), AlignParams(strategy="shuffle", k=3, redundancy=2)]
)
def test_index_gives_the_rows_of_a_search(spark, stored, params):
    path, sequences, reads = stored
    index = open_seed_index(spark, path, params)
    for part in (reads, reads[::2]):
        found = [tuple(r) for r in align_indexed(index, spark.createDataFrame(part, READS), params).collect()]
        assert len(found) == len(set(found)) and set(found) == alignments(sequences, part, params)


def test_copies_and_salts(spark, stored):
    path, sequences, reads = stored
    assert spark.read.parquet(f"{path}/salts").count() > 0
    index = open_seed_index(spark, path, SHUFFLE)
    table = index.places(spark)
    assert table.where("salt > 0").count() > 0
    doubled = reads + [(i + 5000, r) for i, r in reads]
    found = {tuple(r) for r in align_indexed(index, spark.createDataFrame(doubled, READS), SHUFFLE).collect()}
    assert found == alignments(sequences, doubled, SHUFFLE)


def test_the_reference_has_no_exchange(spark, stored):
    path, _, reads = stored
    index = open_seed_index(spark, path, SHUFFLE)
    plan = align_indexed(index, spark.createDataFrame(reads, READS), SHUFFLE)._jdf.queryExecution().executedPlan().toString()
    # The lines of the join's reference side stand below the join and above the exchange of tiles.
    below = plan[plan.index("ShuffledHashJoin") :]
    assert "Bucketed: true" in below and below.index(f"{index.table}[") < below.index("Exchange hashpartitioning(seed")
    assert plan.count("Exchange hashpartitioning(seed") == 1


def test_open_checks_version_and_geometry(spark, stored, tmp_path):
    path = stored[0]
    with pytest.raises(ValueError, match="built for"):
        open_seed_index(spark, path, AlignParams(k=2))
    with pytest.raises(Exception, match="(?i)path"):
        open_seed_index(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="without gaps"):
        align_indexed(open_seed_index(spark, path), spark.createDataFrame([], READS), AlignParams(allow_differences=True))


def test_empty_reference(spark, tmp_path):
    build_seed_index(spark.createDataFrame([], SEQUENCES), f"file://{tmp_path}/empty", SHUFFLE)
    index = open_seed_index(spark, f"file://{tmp_path}/empty", SHUFFLE)
    assert align_indexed(index, spark.createDataFrame([(1, "ACGT" * 9)], READS), SHUFFLE).collect() == []


def test_index_holds_one_place_in_a_grid_step(spark, stored):
    path, sequences, _ = stored
    step = grid_params(SHUFFLE).seed_len
    places = spark.read.parquet(f"{path}/places").select("ref_id", "pos", "seed")
    assert step == 7 and places.where(f"pos % {step} != 0").isEmpty()
    assert 0 < places.count() <= sum(len(text) // step + 1 for _, text in sequences)


def test_rounds_give_a_bucket_one_file(spark, stored):
    files = [r[0] for r in spark.read.parquet(f"{stored[0]}/places").selectExpr("input_file_name()").distinct().collect()]
    buckets = {name.split("_")[-1] for name in files}
    assert len(files) > 1 and len(files) == len(buckets)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_reads_with_n_on_the_grid(spark, tmp_path, k):
    """N meets N, so a read may be spoiled by as many N as differences besides."""
    rng = random.Random(k)
    text = "".join(rng.choice("ACGTACGTACGTN") for _ in range(400)) + "N" * 9 + "ACGT" * 12
    sequences = [(1, text), (2, text[7:300]), (3, "ACGT" * 5), (4, "A" * 90)]
    params = AlignParams(k=k, strategy="shuffle", salt_rows=5)
    reads = [(5, "A" * 36), (6, "A" * 33 + "NNN")]
    for i in range(150):
        at = rng.randrange(len(text) - 36)
        read = list(text[at : at + 36])
        for j in rng.sample(range(36), rng.randrange(k + 2)):
            read[j] = rng.choice("ACGTN")
        reads.append((10 + i, "".join(read)))
    build_seed_index(spark.createDataFrame(sequences, SEQUENCES), f"file://{tmp_path}/n", params, buckets=4)
    index = open_seed_index(spark, f"file://{tmp_path}/n", params)
    found = [tuple(r) for r in align_indexed(index, spark.createDataFrame(reads, READS), params).collect()]
    wanted = alignments(sequences, reads, params)
    assert wanted and len(found) == len(set(found)) and set(found) == wanted


def test_chunks_and_mixed_lengths_on_the_grid(spark, tmp_path):
    """Chunks that overlap by no more than a plain search needs; read lengths of two tile numbers."""
    sequences, reads = planted(32)
    params = AlignParams(max_len=47, chunk_overlap=2 * (47 - 9 + 3) + 8, piece_len=21 * 5, strategy="shuffle")
    reads = reads + [(9000 + i, text[i : i + 47]) for i, (_, text) in enumerate(sequences) if len(text) >= i + 47]
    chunks = chunk_sequences(spark.createDataFrame(sequences, SEQUENCES), params, params.chunk_overlap + 13)
    build_seed_index(chunks, f"file://{tmp_path}/chunks", params, buckets=4)
    index = open_seed_index(spark, f"file://{tmp_path}/chunks", params)
    found = [tuple(r) for r in align_indexed(index, spark.createDataFrame(reads, READS), params).collect()]
    assert len(found) == len(set(found)) and set(found) == alignments(sequences, reads, params)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_folded_words_come_back(spark, n):
    rng = random.Random(n)
    word = lambda digits: int("".join(rng.choice(digits) for _ in range(21)), 8)
    rows = [[word("0123") for _ in range(n)] for _ in range(20)]
    rows += [[word("012347") for _ in range(n)] for _ in range(20)] + [[PAD_WORD] * n]
    names = [f"c{i}" for i in range(n)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names))
    folded = frame.select(*[w.alias(c) for c, w in zip(names, fold_words([frame[c] for c in names]))])
    back = folded.select(*unfold_words([folded[c] for c in names]))
    assert sorted(map(list, back.collect())) == sorted(rows)
    if n >= 3:
        assert [r[1] for r in folded.collect()][:20] == [0] * 20
