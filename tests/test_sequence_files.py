"""Sequence files by the data source, held to the files that Hadoop's own classes write and read."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from strandjoin.sources import alignments as A
from strandjoin.sources import sequence_files as Q
from strandjoin.sources import sequences as S

PACKED = "id int, value binary"


def pairs(frame):
    return sorted((r.id, bytes(r.value)) for r in frame.collect())


def values(n, seed=5):
    chance = random.Random(seed)
    sizes = [0, 1, 17, 300, 70_000]
    return [(chance.randrange(-(2**31), 2**31), bytearray(chance.randbytes(chance.choice(sizes)))) for _ in range(n)]


@pytest.mark.parametrize("split_bytes", [1 << 12, 50_000, 1 << 27])
def test_every_record_is_read_once_whatever_the_splits(spark, tmp_path, split_bytes):
    rows = values(120)
    Q.save_sequence_files(spark.createDataFrame(rows, PACKED).repartition(3), str(tmp_path / "new"))
    found = Q.scan_sequence_files(spark, str(tmp_path / "new"), split_bytes)
    assert pairs(found) == sorted((i, bytes(v)) for i, v in rows)
    if split_bytes < 1 << 20:
        assert found.select(F.spark_partition_id()).distinct().count() > 3


def test_files_of_the_other_writer_are_read(spark, tmp_path):
    rows = values(90, seed=6)
    S.write_packed_files(spark.createDataFrame(rows, PACKED), str(tmp_path / "old"))
    for split_bytes in (3_000, 1 << 27):
        assert pairs(Q.scan_sequence_files(spark, str(tmp_path / "old"), split_bytes)) == sorted(
            (i, bytes(v)) for i, v in rows
        )


def test_the_other_reader_reads_these_files(spark, tmp_path):
    rows = values(90, seed=7)
    Q.save_sequence_files(spark.createDataFrame(rows, PACKED), str(tmp_path / "new"))
    assert pairs(S.read_packed_files(spark, str(tmp_path / "new"), 8)) == sorted((i, bytes(v)) for i, v in rows)


def test_alignment_records(spark, tmp_path):
    hits = [(7, 3, 10, 46, 2, True), (8, 1, 0, 36, 0, False)]
    table = spark.createDataFrame(hits, A.ALIGNMENT_SCHEMA)
    Q.save_sequence_files(A.alignments_to_packed(table), f"file://{tmp_path}/hits")
    back = A.alignments_from_packed(Q.scan_sequence_files(spark, f"file://{tmp_path}/hits"))
    assert sorted(map(tuple, back.select(table.columns).collect())) == hits


def test_empty_tables_and_existing_folders(spark, tmp_path):
    path = str(tmp_path / "none")
    Q.save_sequence_files(spark.createDataFrame([], PACKED), path)
    assert os.listdir(path) == ["_SUCCESS"]
    assert Q.scan_sequence_files(spark, path).count() == 0
    with pytest.raises(Exception, match="exists"):
        Q.save_sequence_files(spark.createDataFrame([], PACKED), path)


def test_nulls_are_refused_and_leave_no_rows(spark, tmp_path):
    for row in [(None, bytearray(b"x")), (1, None)]:
        path = str(tmp_path / f"null{row[0]}")
        with pytest.raises(Exception, match="null"):
            Q.save_sequence_files(spark.createDataFrame([row], PACKED), path)
        assert not os.path.isdir(path) or not [f for f in os.listdir(path) if f.startswith("part")]


def test_damaged_files_fail_with_their_name(spark, tmp_path):
    path = tmp_path / "cut"
    path.mkdir()
    record = b"\0\0\0\x0a" + b"\0\0\0\x04" + b"\0\0\0\x07" + b"\0\0\0\x02ab"
    (path / "part-0").write_bytes(Q.header(b"m" * 16) + record + record[:-1])
    with pytest.raises(Exception, match="part-0"):
        Q.scan_sequence_files(spark, str(path)).collect()
    (path / "part-0").write_bytes(b"no such file")
    with pytest.raises(Exception, match="part-0"):
        Q.scan_sequence_files(spark, str(path)).collect()


def test_ranges_meet_at_every_byte():
    mark = b"0123456789abcdef"
    record = lambda i, v: b"".join(
        n.to_bytes(4, "big") for n in (8 + len(v), 4, i, len(v))
    ) + v
    body = b"".join(record(i, b"v" * i) + (Q.ESCAPE + mark if i % 3 == 2 else b"") for i in range(10))
    whole = Q.header(mark) + body
    for cut in range(1, len(whole)):
        found = [
            number
            for begin, end in ((0, cut), (cut, len(whole)))
            for number, _ in Q.read_records(io.BytesIO(whole), begin, end)
        ]
        assert found == list(range(10)), cut
