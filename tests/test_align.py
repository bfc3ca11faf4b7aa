import random

import pytest
from model import alignments, gapped, planted, rc, unique

from strandjoin import AlignParams, align, align_best, align_unique, run_alignment
from strandjoin.operators.joins import distinct_reads, keep_read_keys, read_stats, salt_heavy_seeds
from strandjoin.operators.seeds import packed_read_tiles, packed_reference_seeds
from strandjoin.operators.sequences import chunk_sequences, prepare_reads
from strandjoin.sources.alignments import read_alignments

SEQUENCES = "seq_id bigint, seq string"
READS = "read_id bigint, seq string"
FIELDS = ("read_id", "ref_id", "ref_start", "ref_end", "differences", "is_rc")
READ = "ACGTTGCAAGGCTTACCGATAGCATTCGGACTGATC"
OTHER = "TTGACCATGGCAATCGTCAGGTACCTTAGACCGTAA"


def tables(spark, sequences, reads):
    return spark.createDataFrame(sequences, SEQUENCES), spark.createDataFrame(reads, READS)


def rows(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def run(spark, sequences, reads, params=AlignParams(), call=align):
    return rows(call(*tables(spark, sequences, reads), params))


def change(seq, *positions):
    other = {"A": "C", "C": "G", "G": "T", "T": "A", "N": "A"}
    return "".join(other[b] if i in positions else b for i, b in enumerate(seq))


VARIANTS = {
    "default": AlignParams(),
    "shuffle": AlignParams(strategy="shuffle"),
    "sort_merge": AlignParams(strategy="shuffle", hash_bytes=1),
    "shuffle_salted": AlignParams(strategy="shuffle", salt_rows=3),
    "refined": AlignParams(refine_fanout=1),
    "refined_shuffle_salted": AlignParams(strategy="shuffle", refine_fanout=2, salt_rows=3),
    "small_pieces": AlignParams(piece_len=84),
    "longer_tiles": AlignParams(k=2),
    "short_tiles": AlignParams(k=5),
    "exact": AlignParams(k=0, min_len=18, max_len=18),
    "mixed_lengths": AlignParams(min_len=30, max_len=50),
    "mixed_lengths_refined": AlignParams(min_len=30, max_len=50, refine_fanout=1),
    "exact_36": AlignParams(k=0),
    "tiles_of_19": AlignParams(k=1, min_len=38, max_len=40),
    "tiles_of_19_refined": AlignParams(k=1, min_len=38, max_len=38, refine_fanout=1),
    "tiles_of_37_shuffled": AlignParams(k=3, min_len=150, max_len=150, strategy="shuffle"),
    "long_reads": AlignParams(k=6, min_len=100, max_len=110),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_matches_brute_force(spark, name):
    params = VARIANTS[name]
    sequences, reads = planted(7, (params.min_len, params.max_len), ref_lengths=(400, 130, 110, 35, 9, 1))
    expected = alignments(sequences, reads, params)
    assert len(expected) > 30
    assert run(spark, sequences, reads, params) == expected


def test_best_and_unique_match_brute_force(spark):
    sequences, reads = planted(11, n_reads=120)
    hits = alignments(sequences, reads, AlignParams())
    expected = unique(hits)
    assert 0 < len(expected) < len({h[0] for h in hits})
    assert run(spark, sequences, reads, call=align_unique) == expected
    best = {r[0]: r for r in run(spark, sequences, reads, call=align_best)}
    assert best.keys() == {h[0] for h in hits}
    for read_id, row in best.items():
        mine = [h for h in hits if h[0] == read_id and h[4] == row[1]]
        assert row[1] == min(h[4] for h in hits if h[0] == read_id)
        assert row[2] == len(mine)
        first = min((h[1], h[2], h[3], h[5]) for h in mine)
        assert row[3:] == first


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
def test_copies_of_a_read_get_the_same_rows(spark, strategy):
    sequences, reads = planted(3, n_reads=20)
    copied = reads + [(5000 + i, reads[8][1]) for i in range(40)]
    params = AlignParams(strategy=strategy)
    assert run(spark, sequences, copied, params) == alignments(sequences, copied, params)
    expected = unique(alignments(sequences, copied, params))
    assert run(spark, sequences, copied, params, align_unique) == expected


@pytest.mark.parametrize("chunk_len", [1200, 1701, 2048])
def test_stored_chunks_give_each_place_once(spark, chunk_len):
    sequences, reads = planted(5, ref_lengths=(4200, 1200, 1199, 300))
    refs, read_table = tables(spark, sequences, reads)
    chunks = chunk_sequences(refs, AlignParams(), chunk_len)
    assert chunks.count() > len(sequences)
    assert rows(align(chunks, read_table)) == rows(align(refs, read_table))


def test_a_hit_across_every_piece_border(spark):
    params = AlignParams(piece_len=84)
    filler = "CAGT" * 60
    sequences = [(p, filler[:p] + READ + filler[:50]) for p in range(0, 190)]
    expected = {(1, p, p, p + 36, 0, False) for p in range(0, 190)}
    assert run(spark, sequences, [(1, READ)], params) == expected


def test_strands(spark):
    assert run(spark, [(0, "G" + READ)], [(1, READ)]) == {(1, 0, 1, 37, 0, False)}
    assert run(spark, [(0, "G" + rc(READ))], [(1, READ)]) == {(1, 0, 1, 37, 0, True)}


@pytest.mark.parametrize(
    "positions", [(0,), (1, 10), (1, 10, 19), (1, 10, 28), (1, 19, 28), (10, 19, 28), (9, 10, 11)]
)
def test_substitutions_in_each_tile(spark, positions):
    found = run(spark, [(0, change(READ, *positions))], [(1, READ)])
    assert found == {(1, 0, 0, 36, len(positions), False)}


def test_four_substitutions_are_too_many(spark):
    assert run(spark, [(0, change(READ, 0, 1, 2, 3))], [(1, READ)]) == set()


def test_n_equals_n_only(spark):
    with_n = "N" + READ[1:]
    assert run(spark, [(0, with_n)], [(1, with_n)]) == {(1, 0, 0, 36, 0, False)}
    assert run(spark, [(0, READ)], [(1, with_n)]) == {(1, 0, 0, 36, 1, False)}
    assert run(spark, [(0, with_n)], [(1, READ)]) == {(1, 0, 0, 36, 1, False)}


def test_number_of_n_in_a_read(spark):
    for n, expected in ((3, 1), (4, 0)):
        assert len(run(spark, [(0, READ)], [(1, "N" * n + READ[n:])])) == (expected)


def test_letter_case_and_other_letters(spark):
    assert run(spark, [(0, READ.lower())], [(1, READ)]) == {(1, 0, 0, 36, 0, False)}
    assert run(spark, [(0, "R" + READ[1:])], [(1, READ)]) == {(1, 0, 0, 36, 1, False)}


@pytest.mark.parametrize("seq", [READ[:35], READ + "A", None])
def test_bad_length(spark, seq):
    with pytest.raises(Exception, match="outside"):
        run(spark, [(0, READ)], [(1, seq), (2, READ)])
    params = AlignParams(on_bad_length="drop")
    assert run(spark, [(0, READ)], [(1, seq), (2, READ)], params) == {(2, 0, 0, 36, 0, False)}


def test_ties_and_single_best(spark):
    near = change(READ, 5)
    assert run(spark, [(0, READ), (1, READ)], [(1, READ)], call=align_unique) == set()
    assert run(spark, [(0, READ), (1, near)], [(1, READ)], call=align_unique) == {
        (1, 0, 0, 36, 0, False)
    }
    palindrome = OTHER[:18] + rc(OTHER[:18])
    assert len(run(spark, [(0, palindrome)], [(1, palindrome)])) == 2
    assert run(spark, [(0, palindrome)], [(1, palindrome)], call=align_unique) == set()


def test_ends_of_the_reference(spark):
    text = OTHER + READ
    assert run(spark, [(0, READ + OTHER)], [(1, READ)]) == {(1, 0, 0, 36, 0, False)}
    assert run(spark, [(0, text)], [(1, READ)]) == {(1, 0, 36, 72, 0, False)}
    assert run(spark, [(0, text[:-1])], [(1, READ)]) == set()
    assert run(spark, [(0, READ[1:] + OTHER)], [(1, READ)]) == set()


@pytest.mark.parametrize("sequences,reads", [([], [(1, READ)]), ([(0, READ)], []), ([(0, "ACG")], [(1, READ)])])
def test_empty_inputs_keep_the_schema(spark, sequences, reads):
    for call in (align, align_unique):
        result = call(*tables(spark, sequences, reads))
        assert result.columns == ["read_id", "ref_id", "ref_start", "ref_end", "differences", "is_rc"]
        assert result.collect() == []


def test_turned_reads_flip_the_strand(spark):
    sequences, reads = planted(13)
    plain = run(spark, sequences, reads)
    turned = run(spark, sequences, [(i, rc(r)) for i, r in reads])
    assert turned == {(*hit[:5], not hit[5]) for hit in plain}


def test_mismatch_positions(spark):
    sequences, reads = planted(17)
    found = align(*tables(spark, sequences, reads), edits=True).collect()
    texts, by_id = dict(sequences), dict(reads)
    assert len(found) > 30
    for hit in found:
        read = rc(by_id[hit.read_id]) if hit.is_rc else by_id[hit.read_id]
        window = texts[hit.ref_id][hit.ref_start : hit.ref_end]
        assert hit.mismatch_positions == [i for i, (a, b) in enumerate(zip(read, window)) if a != b]
        assert len(hit.mismatch_positions) == hit.differences


@pytest.mark.parametrize(
    "params",
    [
        AlignParams(allow_differences=True),
        AlignParams(allow_differences=True, strategy="shuffle", salt_rows=3),
        AlignParams(k=1, min_len=40, max_len=40, allow_differences=True),
        AlignParams(allow_differences=True, k=1, min_len=30, max_len=40),
    ],
)
def test_gapped_matches_brute_force(spark, params):
    sequences, reads = planted(19, (params.min_len, params.max_len), 30, (300, 120, 60))
    base = sequences[0][1]
    m = params.min_len
    reads += [
        (2000, base[40:50] + base[51 : 41 + m]),  # the reference has one base more
        (2001, base[90:110] + "T" + base[110 : 89 + m]),  # the read has one base more
        (2002, rc(change(base[140:150] + base[151 : 141 + m], 25))),
    ]
    expected = gapped(sequences, reads, params)
    assert {2000, 2001} <= {hit[0] for hit in expected}
    assert run(spark, sequences, reads, params) == expected


def test_gapped_edits_explain_the_distance(spark):
    params = AlignParams(allow_differences=True)
    longer = READ[:20] + "G" + READ[20:]
    refs, reads = tables(spark, [(0, longer), (1, READ[:20] + READ[21:]), (2, change(READ, 7))], [(1, READ)])
    found = align(refs, reads, params, edits=True).collect()
    best = {}
    for hit in found:
        assert len(hit.edits) == hit.differences
        if hit.differences == 1 and not hit.is_rc:
            best.setdefault(hit.ref_id, set()).update(e.op for e in hit.edits)
    assert "reference_base" in best[0] and "read_base" in best[1] and "mismatch" in best[2]


def test_edit_traces_of_random_texts():
    from strandjoin.operators.gapped import OPERATIONS, edit_tracer

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(12)))
    pairs = [(word(), word()) for _ in range(300)] + [("", ""), ("A", ""), ("", "C")]
    places, operations = edit_tracer()(*map(list, zip(*pairs)))
    for (text, read), at, ops in zip(pairs, places, operations):
        edits = [(int(p), OPERATIONS[o]) for p, o in zip(at, ops) if o >= 0]
        assert edits == sorted(edits, key=lambda e: e[0])
        i, rebuilt = 0, ""
        for p in range(len(read) + 1):
            i += edits.count((p, "reference_base"))
            if p == len(read):
                break
            if (p, "read_base") in edits:
                rebuilt += read[p]
                continue
            rebuilt += read[p] if (p, "mismatch") in edits else text[i]
            i += 1
        assert rebuilt == read and i == len(text) and len(edits) == levenshtein(text, read)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row = row, [row[0] + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_stats_and_salts(spark):
    params = AlignParams(salt_rows=2)
    refs, reads = tables(spark, [(0, "A" * 50)], [(1, "A" * 36), (2, "A" * 36), (3, READ)])
    tiles = packed_read_tiles(distinct_reads(prepare_reads(reads, params)), params)
    stats = read_stats(tiles)
    assert stats.max_copies == 2 and stats.max_fanout == 4 and stats.tile_rows == 16
    places = packed_reference_seeds(refs, params)
    spread, copied, salted = salt_heavy_seeds(places, tiles, params)
    assert salted
    assert spread.select("salt").distinct().count() > 1
    assert copied.count() == 4 * 21 + 12
    assert not salt_heavy_seeds(places, tiles, AlignParams())[2]


def test_broadcast_only_within_the_size_limit(spark):
    refs, reads = tables(spark, [(0, READ)], [(1, READ)])

    def plan(params):
        df = align(refs, reads, params)
        return df._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(AlignParams())
    over = plan(AlignParams(broadcast_bytes=10))
    assert "ShuffledHashJoin" in over and "BroadcastHashJoin" not in over
    far_over = plan(AlignParams(broadcast_bytes=10, hash_bytes=10))
    assert "SortMergeJoin" in far_over and "ShuffledHashJoin" not in far_over


@pytest.mark.parametrize(
    "bad", [{"k": -1}, {"min_len": 40}, {"k": 40}, {"chunk_overlap": 10}, {"strategy": "x"}, {"piece_len": 100}]
)
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        AlignParams(**bad)


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
def test_repeated_ids_are_ranked_together(spark, tmp_path, strategy):
    """A place that two rows of an id find is a tie, in the query as in the job."""
    params = AlignParams(strategy=strategy)
    refs = [(0, READ + OTHER)]
    reads = [(7, READ), (7, READ), (8, OTHER), (9, READ), (9, OTHER), (10, READ)]
    found = run(spark, refs, reads, params, align_unique)
    assert {(hit[0], hit[2]) for hit in found} == {(8, 36), (10, 0)}
    run_alignment(*tables(spark, refs, reads), str(tmp_path / "job"), params)
    assert found == {tuple(r) for r in read_alignments(spark, str(tmp_path / "job")).select(*FIELDS).collect()}


@pytest.mark.parametrize("refine", [512, 1])
def test_places_without_a_matching_key_do_not_reach_the_exchange(spark, refine):
    params = AlignParams(strategy="shuffle", refine_fanout=refine)
    sequences, reads = planted(23, n_reads=40)
    refs, table = tables(spark, sequences, reads)
    tiles = packed_read_tiles(distinct_reads(prepare_reads(table, params)), params)
    stats = read_stats(tiles)
    places = packed_reference_seeds(refs, params)
    kept = keep_read_keys(places, tiles, ["seed"], stats.seeds, params.key_len)
    assert 0 < kept.count() == places.join(tiles.select("seed").distinct(), "seed").count() < places.count()
    hashed = keep_read_keys(places, tiles, ["seed"], stats.seeds)
    assert kept.count() <= hashed.count() < places.count() and kept.exceptAll(hashed).isEmpty()
    tree = str(hashed._jdf.queryExecution().executedPlan())
    assert tree.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in tree
    assert run(spark, sequences, reads, params) == run(spark, sequences, reads)


def test_a_filter_of_too_many_keys_is_left_out(spark):
    refs, reads = tables(spark, [(0, READ)], [(1, READ)])
    params = AlignParams()
    tiles = packed_read_tiles(distinct_reads(prepare_reads(reads, params)), params)
    places = packed_reference_seeds(refs, params)
    assert keep_read_keys(places, tiles, ["seed"], 1 << 40) is places
