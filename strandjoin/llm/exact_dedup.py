"""Exact deduplication: tree-merge of sorted digest runs.

Every partition of the input is a run of (digest, smallest row, count). Rounds merge the runs
of 2 ** bits neighbours: a run's number loses its lowest bits, as in a binomial tree, and runs
with the same number meet, sorted by digest, in tasks that each hold a slice of the digests.
After any round a digest has at most one row for each run, so that even a text that makes up
a third of the table is a few rows in any task. The merged minima then go back to the runs of
the first level, and from there to the rows, by (run, digest).

Defined results: null text counts as the empty text; a null doc_id counts as the largest id;
of rows that repeat both id and text the first read stays, and each is counted; an empty table
gives no rows. Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.common import numbered_rows, stage


def normalize_space(text: Column) -> Column:
    """Every run of white space as one space; runs that are one space already stay untouched."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def digest_rows(docs: DataFrame, doc_id: str, text: str, row: str | None = None) -> DataFrame:
    """One narrow row for each row: its id, run, place and the digest of its normalized text.

    row: a column that numbers the rows; without one the places of this read do.
    """
    normal = normalize_space(F.col(text))
    place = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.spark_partition_id().alias("run"),
        place.alias("row"),
        F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
        F.octet_length(normal).cast("long").alias("n_bytes"),
    )


def merge_round(runs: DataFrame, bits: int) -> DataFrame:
    """Merge the runs of 2 ** bits neighbours, keeping each digest's smallest row and count.

    Texts count as equal only if digest and length agree. A task gets one slice of digests of
    one new run, sorted, and aggregates the sorted rows.
    """
    parent = runs.withColumn("run", F.shiftright("run", bits))
    parent = parent.withColumn("slice", F.substring("digest", 1, 2))
    met = parent.repartition("run", "slice").sortWithinPartitions("run", "slice", "digest")
    merged = met.groupBy("run", "slice", "digest", "n_bytes").agg(
        F.min("first").alias("first"), F.sum("n").alias("n")
    )
    return merged.drop("slice")


def duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, row: str | None = None
) -> DataFrame:
    """One row for each row of docs: doc_id, row, keep_id, group_size, kept, text_sha256."""
    rows = stage(digest_rows(docs, doc_id, text, row), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first_level = rows.groupBy("run", "digest", "n_bytes").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n")
    )
    last = rows.agg(F.max("run")).first()[0] or 0
    merged = first_level
    while last > 0:
        merged, last = merge_round(merged, bits), last >> bits
    groups = merged.select("digest", "n_bytes", F.col("first").alias("keep"), F.col("n").alias("size"))
    down = first_level.select("run", "digest", "n_bytes").join(groups, ["digest", "n_bytes"])
    found = rows.join(down, ["run", "digest", "n_bytes"])
    return found.select(
        "doc_id",
        "row",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows are numbered in a table of their own, written once, so that a cluster that grows or
    shrinks in between does not number them anew.
    """
    numbered, row = numbered_rows(docs, "numbered")
    kept = duplicate_groups(numbered, doc_id, text, row=row).where("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
