"""The corpus pipeline against plain Python, and row numbers that outlive a change of cores."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_hits, lower

from strandjoin.llm import common, exact_dedup, jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string"
LEAVES = "spark.sql.leafNodeDefaultParallelism"


def sentence(draw, n):
    return " ".join(draw.choice(["river", "stone", "garden", "winter"]) + str(draw.randrange(4000)) for _ in range(n))


def corpus():
    """Clean texts, exact and near copies, benchmark passages, nulls, repeated ids and odd texts."""
    draw = random.Random(8)
    rows = [(i, sentence(draw, 60)) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  \n")) for i in range(10)]
    for i in range(10, 20):
        words = rows[i][1].split(" ")
        rows.append((200 + i, " ".join([*words[:-1], "changed"])))
    items = [(f"b{i}", sentence(draw, 20)) for i in range(6)]
    rows += [(300 + i, sentence(draw, 10) + " " + items[i][1]) for i in range(3)]
    rows += [(None, sentence(draw, 50)), (None, rows[0][1]), (5, sentence(draw, 50)), (5, sentence(draw, 50))]
    rows += [(400, None), (401, ""), (402, "12 34 !"), (403, sentence(draw, 9000)), (404, sentence(draw, 3)), (404, "one two")]
    return rows, items


def key(row):
    return (row[0] is None, row[0] or 0)


def plain(rows, items):
    """What the first four stages keep, as (doc_id, text)."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[ \t-\r]+", " ", r[1])].append(r)
    rows = [min(g, key=key) for g in groups.values()]
    sets = []
    for r in rows:
        words = re.findall("[^ \t-\r]+", lower(r[1]))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    kept = []
    for r in (min(g, key=key) for g in groups.values()):
        n_words, n_hit, _ = brute_hits(r[1], items)
        if not (n_hit and 20 * n_hit >= n_words):
            kept.append(r)
    return kept


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows, items = corpus()
    labels = ["en", "de", None]
    table = [(i, t, labels[n % 3], "s", 1, "x") for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(table, DOCS).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_equals_plain_python(spark, sf_dir):
    rows, items = corpus()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), "test")
        assert docs.columns == columns
    expected = plain(rows, items)
    order = lambda found: sorted(found, key=repr)
    assert 60 < len(expected) < len(rows) - 20
    assert order((r["doc_id"], r["text"]) for r in docs.collect()) == order(expected)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert order({r["doc_id"] for r in pieces}) == order({r[0] for r in expected})
    filled = defaultdict(list)
    for r in pieces:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("later", [2, 24])
def test_rows_stay_when_the_number_of_cores_changes(spark, sf_dir, later):
    rows, _ = corpus()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {re.sub("[ \t-\r]+", " ", t or "") for _, t in rows}
    try:
        for drop in (exact_dedup.drop_exact_duplicates, lambda d: jaccard.keep_one_of_each(d, shingle=5, threshold=(80, 100))):
            spark.conf.set(LEAVES, 4)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            before = drop(docs)
            expected = sorted(map(repr, before.collect()))
            after = drop(docs)
            spark.conf.set(LEAVES, later)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
            assert sorted(map(repr, after.collect())) == expected == sorted(map(repr, before.collect()))
            if drop is exact_dedup.drop_exact_duplicates:
                kept = after.select(F.coalesce("text", F.lit("")).alias("text")).collect()
                assert sorted(re.sub("[ \t-\r]+", " ", r["text"]) for r in kept) == sorted(texts)
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    finally:
        for name in (LEAVES, "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(name)


def test_staged_tables_are_deleted_by_their_owner(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    (tmp_path / "staged-other").mkdir()
    assert common.stage(spark.range(3), "x").count() == 3
    assert len(list(tmp_path.iterdir())) == 2
    common.drop_stages(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["staged-other"]
