"""Furthest-reaching diagonals and the native trace against plain versions."""

import random
import re

import pytest
from model import extension
from pyspark.sql import functions as F

import __spark_entry__ as registry
from strandjoin import AlignParams, align
from strandjoin.functions.diagonals import digit_planes, extend_side, plane_columns
from strandjoin.functions.edits import edit_arrays, replay_edits, trace_edits
from strandjoin.functions.packing import pack_frame, to_digits
from strandjoin.operators.gapped import fits_planes


def changed(draw, text, edits):
    for _ in range(edits):
        at = draw.randrange(len(text) + 1)
        kind = draw.randrange(3)
        text = text[:at] + ("" if kind == 0 else draw.choice("ACGTN")) + text[at + (kind != 1) :]
    return text


def pairs(width, k, n=250):
    draw = random.Random(width * 10 + k)
    found = [("", ""), ("", "A"), ("A", ""), ("ACGT", "ACGT"), ("A" * width, "A" * (width - k))]
    for _ in range(n):
        pattern = "".join(draw.choice(draw.choice(["ACGT", "AC", "ACGTN"])) for _ in range(draw.randrange(width - k + 1)))
        text = changed(draw, pattern, draw.randrange(k + 2)) + "".join(draw.choice("ACGT") for _ in range(draw.randrange(k + 3)))
        found.append((text[:width], pattern))
    return found


@pytest.mark.parametrize(("width", "k"), [(30, 3), (12, 0), (21, 1), (40, 5), (46, 8)])
def test_extension_equals_edit_distance_of_prefixes(spark, width, k):
    """The text stands in packed words behind k bases, forwards and backwards."""
    listed = [(i, *p) for i, p in enumerate(pairs(width, k))]
    frame = spark.createDataFrame(listed, "id long, text string, pattern string").repartition(2)
    pattern = F.reverse(F.rpad(to_digits(F.col("pattern")), width, "7"))
    ahead = F.concat(F.repeat(F.lit("1"), F.lit(k)), to_digits(F.col("text")))
    n_words = -(-(width + 2 * k) // 21)
    for backward in (True, False):
        padded = F.rpad(ahead, n_words * 21, "7") if backward else F.lpad(F.reverse(ahead), n_words * 21, "7")
        words = {f"c{i}": w for i, w in enumerate(pack_frame(padded, n_words))}
        planes = {f"q{i}": p for i, p in enumerate(digit_planes(pattern))}
        begin = 0 if backward else n_words * 21 - width - 2 * k
        region = {"t": (begin, begin + width + 2 * k, backward)}
        ready = plane_columns(frame.withColumns({**words, **planes}), list(words), region)
        rows = extend_side(ready, "x", ["q0", "q1", "q2"], ["t0", "t1", "t2"], width, k).collect()
        found = {r["id"]: (r["x_differences"], r["x_aligned"]) for r in rows}
        expected = {i: extension(text, pattern, k) for i, text, pattern in listed}
        assert found == {i: e for i, e in expected.items() if e is not None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row = row, [row[0] + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_trace_explains_every_pair(spark):
    draw = random.Random(9)
    listed = [("", ""), ("A", ""), ("", "C"), ("AAAA", "TTTT")]
    for _ in range(300):
        text = "".join(draw.choice("ACGT") for _ in range(draw.randrange(30)))
        listed.append((text, changed(draw, text, draw.randrange(5))))
    frame = spark.createDataFrame(listed, "ref string, read string")
    edits = trace_edits(F.col("ref"), F.col("read"), 3)
    traced = frame.select("*", edits.alias("edits")).select(
        "*", replay_edits(F.col("ref"), F.col("read"), F.col("edits")).alias("again"), edit_arrays(F.col("edits"), F.length("read")).alias("e")
    )
    for row in traced.collect():
        d = distance(row["ref"], row["read"])
        if d > 3:
            assert row["edits"] is None
            continue
        assert len(row["edits"]) == d and (row["again"] == row["read"] or not row["read"])
        dist, what = row["e"]
        assert what[-1] == 2 and len(what) == len(dist) == d + 1 and min(dist) >= 0
        assert sum(dist) + sum(w in (0, 1) for w in what[:-1]) == len(row["read"])
        assert len(row["ref"]) - len(row["read"]) == what.count(-1) - what.count(1)


def test_long_sides_use_texts():
    assert fits_planes(AlignParams(allow_differences=True))
    assert not fits_planes(AlignParams(allow_differences=True, k=1, min_len=150, max_len=150))


def test_gapped_search_has_no_python(spark):
    for name in ("gapped_edits", "gapped_edit_arrays", "align_all_gapped"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


HUGE = 8_000


def code_sizes(frame):
    """Bytes of the largest method that Spark generates for each part of a plan."""
    spark = frame.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        planned = frame.select("*")._jdf.queryExecution()
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(planned, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


@pytest.mark.parametrize("params", [AlignParams(allow_differences=True), AlignParams(min_len=76, max_len=76)])
def test_generated_methods_are_small_enough_to_be_compiled(spark, params):
    sequences = spark.createDataFrame([(1, "ACGT" * 60)], "seq_id long, seq string")
    reads = spark.createDataFrame([(1, ("ACGT" * 60)[: params.max_len])], "read_id long, seq string")
    sizes = code_sizes(align(sequences, reads, params))
    assert sizes and max(sizes) < HUGE
