import pytest
from pyspark.sql import functions as F

from strandjoin.functions import bases as B
from strandjoin.functions.edits import edit_runs, k_difference, k_mismatch
from strandjoin.operators.gapped import edit_tracer
from strandjoin.operators.sequences import chunk_ownership, chunk_sequences, linear_split
from strandjoin.operators.seeds import read_seeds, salt_reads, salt_reference
from strandjoin.operators.joins import salted_seed_join, seed_join
from strandjoin import AlignParams, run_alignment
from strandjoin.sources import alignments as A
from strandjoin.sources import sequences as S

ALIGNMENTS = [(7, 3, 10, 46, 2, True), (8, -1, 0, 36, 0, False), (-9, 2**31 - 1, -(2**31), 5, 1, True)]
CHUNK = "seq_id bigint, offset bigint, is_last boolean, seq string"


def one(spark, column, *values):
    df = spark.createDataFrame([values], [f"v{i}" for i in range(len(values))])
    return df.select(column(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_packed_sequences_round_trip(spark):
    texts = ["", "A", "AC", "ACG", "ACGT", "ACGTA", "ACGTAN", "ACGTANN", "ACGTANNA", "ACGTACGTA"]
    offsets = [0, 123456, -5, 2**31 - 1]
    chunks = [(i, offsets[i % 4], i % 2 == 0, t) for i, t in enumerate(texts)]
    packed = S.encode_packed(spark.createDataFrame(chunks, CHUNK))
    assert sorted(tuple(r) for r in S.decode_packed(packed).collect()) == chunks


def test_packed_sequence_layout(spark):
    packed = S.encode_packed(spark.createDataFrame([(1, 123456, False, "ACGTN")], CHUNK))
    assert bytes(packed.first().value) == bytes.fromhex("000001E24001248F")
    odd = spark.createDataFrame([(1, bytearray.fromhex("0100000000F35F"))], "id int, value binary")
    assert S.decode_packed(odd).first().seq == "NNN"


def test_packed_files(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, True, "ACGTN"), (2, 5, False, "")], CHUNK)
    S.write_packed_files(S.encode_packed(chunks), str(tmp_path / "old"))
    back = S.decode_packed(S.read_packed_files(spark, str(tmp_path / "old")))
    assert sorted(back.collect()) == sorted(chunks.collect())


def test_alignment_formats(spark):
    table = spark.createDataFrame(ALIGNMENTS, A.ALIGNMENT_SCHEMA)
    packed = A.alignments_to_packed(table)
    assert bytes(packed.first().value) == bytes.fromhex("01000000030000000A0000002E00000002")
    assert sorted(A.alignments_from_packed(packed).select(table.columns).collect()) == sorted(table.collect())
    assert A.alignments_to_text(table).first().value == "3\t1\t10\t46\t2"
    assert A.alignments_to_text(table, with_read=True).first().value == "3\t10\t46\t7\t2\t-"
    parsed = A.alignments_from_text(A.alignments_to_text(table))
    assert sorted(parsed.collect()) == sorted(table.drop("read_id").collect())


def test_values_beyond_32_bits_are_refused(spark):
    table = spark.createDataFrame([(1, 2**31, 0, 36, 0, False)], A.ALIGNMENT_SCHEMA)
    with pytest.raises(Exception, match="32 bits"):
        A.alignments_to_packed(table).collect()


def test_write_refuses_an_existing_table(spark, tmp_path):
    table = spark.createDataFrame(ALIGNMENTS, A.ALIGNMENT_SCHEMA)
    path = str(tmp_path / "hits")
    A.write_alignments(table, path)
    assert sorted(A.read_alignments(spark, path).collect()) == sorted(table.collect())
    with pytest.raises(Exception, match="(?i)exists"):
        A.write_alignments(table, path)


def test_base_functions(spark):
    assert one(spark, B.normalize_bases, "acgtnRx-A") == "ACGTNNNNA"
    assert one(spark, B.reverse_complement, "AaCcGgTtNx") == "NNaAcCgGtT"
    assert one(spark, B.pack_kmer, "ACCATCA") == int("0110310", 4)
    assert one(spark, B.pack_kmer, "accatca") == int("0110310", 4)
    assert one(spark, B.pack_kmer, "ACN") is None
    assert one(spark, B.pack_kmer, "T" * 31) == 4**31 - 1
    assert one(spark, B.is_homopolymer, "TTTT") and not one(spark, B.is_homopolymer, "TTTA")
    assert one(spark, B.count_n, "NANN") == 3


def test_linear_split(spark):
    text = "abcdefghij"
    assert one(spark, lambda c: linear_split(c, 4, 6), text) == ["abcdef", "efghij", "ij"]


def test_k_mismatch(spark):
    def run(text, pattern, k, full=True):
        found = one(spark, lambda a, b: k_mismatch(a, b, k, full), text, pattern)
        return found and tuple(found)

    long = "ACGTN" * 30
    assert run(long, long[:100], 0) == (100, 0)
    assert run(long, "C" + long[1:99] + "A", 2) == (100, 2)
    assert run(long, "C" + long[1:99] + "A", 1) is None
    assert run("ACG", "ACGT", 3) is None
    assert run("ACG", "ATGT", 3, full=False) == (3, 1)
    assert run("", "ACG", 0, full=False) == (0, 0)


def test_k_difference(spark):
    def run(text, pattern, k):
        found = one(spark, lambda a, b: k_difference(a, b, k), text, pattern)
        return found and tuple(found)

    assert run("ACGTACGTTT", "ACGTACG", 3) == (0, 7)
    assert run("ACGGTACGTT", "ACGTACG", 3) == (1, 8)
    assert run("ACTACGTTTT", "ACGTACG", 3) == (1, 6)
    assert run("TTTTTTTTTT", "ACGACGA", 3) is None
    assert run("A", "ACGTACG", 3) is None
    assert run("ACG", "", 3) == (0, 0)


def test_edit_runs(spark):
    run = lambda at: list(one(spark, lambda c: edit_runs(c, F.lit(36)), at))
    assert run([3, 4, 20]) == [3, 1, 16, 16]
    df = spark.createDataFrame([([],)], "v array<int>")
    assert df.select(edit_runs(F.col("v"), F.lit(36))).first()[0] == [36]


def test_edit_tracer():
    trace = edit_tracer()
    assert trace("ACGT", "ACGT") == []
    assert trace("ACGT", "AGGT") == [(1, "mismatch")]
    assert trace("ACGGT", "ACGT") in ([(2, "reference_base")], [(3, "reference_base")])
    assert trace("AGT", "ACGT") == [(1, "read_base")]
    assert len(trace("TTTT", "")) == 4


def test_chunk_ownership_leaves_no_gap(spark):
    params = AlignParams()
    lengths = [1, 9, 1024, 1025, 2047, 2048, 2049, 3072, 3073, 9999]
    table = spark.createDataFrame([(n, "A" * n) for n in lengths], "seq_id bigint, seq string")
    for chunk_len in (1025 + 86, 2048):
        owned = chunk_ownership(chunk_sequences(table, params, chunk_len), params).collect()
        for n in lengths:
            mine = sorted((r.own_start, r.own_end) for r in owned if r.seq_id == n)
            positions = [p for a, b in mine for p in range(a, b)]
            assert positions == list(range(n - params.seed_len + 1))


@pytest.mark.parametrize("redundancy", [1, 16])
def test_salts_do_not_change_the_join(spark, redundancy):
    params = AlignParams()
    reads = spark.createDataFrame([(-3, "A" * 36), (5, "ACGT" * 9)], "read_id bigint, seq string")
    tiles = read_seeds(reads, params).withColumnRenamed("pos", "tile_start")
    places = spark.createDataFrame([(0, 4, "A" * 9), (0, 5, "ACGTACGTA"), (1, 4, "T" * 9)], "ref_id bigint, pos bigint, seed string")
    plain = seed_join(tiles, places)
    salted = salted_seed_join(tiles, places, redundancy)
    assert sorted(salted.select(plain.columns).collect()) == sorted(plain.collect())
    assert salt_reference(places, redundancy).count() == 2 * redundancy + 1
    assert salt_reads(tiles, redundancy).where("salt < 0").count() == 0


def test_job_writes_both_tables(spark, tmp_path):
    read = "ACGTTGCAAGGCTTACCGATAGCATTCGGACTGATC"
    other = "TTGACCATGGCAATCGTCAGGTACCTTAGACCGTAA"
    refs = spark.createDataFrame([(0, read + other), (1, other)], "seq_id bigint, seq string")
    reads = spark.createDataFrame([(1, read), (2, other)], "read_id bigint, seq string")
    summary = run_alignment(refs, reads, str(tmp_path / "out"))
    assert (summary.alignments, summary.unambiguous) == (3, 1)
    assert A.read_alignments(spark, str(tmp_path / "out-alignments")).count() == 3
    assert [tuple(r) for r in A.read_alignments(spark, str(tmp_path / "out")).collect()] == [
        (1, 0, 0, 36, 0, False)
    ]
    with pytest.raises(Exception, match="(?i)exists"):
        run_alignment(refs, reads, str(tmp_path / "out"))


def test_k_mismatch_of_any_letters(spark):
    from pyspark.sql import functions as F

    from strandjoin.functions import edits

    rows = [("acgt", "tttt", 3), ("hello", "world", 4), ("ACGTN", "ACGAN", 1), ("ACNT", "ACGT", 1), ("", "", 0)]
    frame = spark.createDataFrame(rows, "a string, b string, want int")
    found = frame.select("want", edits.k_mismatch(F.col("a"), F.col("b"), 10)["differences"].alias("got"))
    assert all(r.want == r.got for r in found.collect())
