"""Flanks of seeds, and extensions of one side."""

from pyspark.sql import functions as F

from strandjoin.functions.edits import k_difference
from strandjoin.operators.seeds import reference_seeds
from strandjoin.params import AlignParams


def test_left_flanks_are_cut_from_a_turned_block(spark):
    params = AlignParams()
    sequence = "ACGGTCATTGCAACGT" * 5 + "GGT"
    frame = spark.createDataFrame([(1, sequence)], "seq_id long, seq string")
    found = reference_seeds(frame, params, flanks=True)
    s, flank = params.seed_len, params.flank_len
    expected = {
        p: (sequence[max(0, p - flank) : p][::-1], sequence[p : p + s], sequence[p + s : p + s + flank])
        for p in range(len(sequence) - s + 1)
    }
    assert {r["pos"]: (r["left_flank"], r["seed"], r["right_flank"]) for r in found.collect()} == expected
    assert "reverse(ltrim(" not in found._jdf.queryExecution().analyzed().toString()


def test_far_texts_take_one_distance(spark):
    frame = spark.createDataFrame([("ACGT" * 5, "TTTT" * 5), ("ACGT", "ACT"), ("", "")], "t string, p string")
    found = frame.select(k_difference(F.col("t"), F.col("p"), 1).alias("r"))
    assert [r["r"] and tuple(r["r"]) for r in found.collect()] == [None, (1, 2), (0, 0)]
    assert "Some(2)) >= 0)" in found._jdf.queryExecution().analyzed().toString()
