"""WARC records and their fixity audit by Merkle trees.

Records stand in a fixed order; a record's offset is the sum of the lengths before it. A leaf of
the tree is the hash of a record, its id and its length, with its offset range beside it; a node is
the hash of its up to 16 children and the length of their range, so that a record that grows does
not change the hashes of those after it. Two replicas are compared root first, and only below nodes
that differ does the audit go down a level. There records with equal id and hash are partners,
wherever an inserted or lost record has shifted them to; what has no partner is damaged, and a
record of the same id on the other side is reported with it.

DataFrame functions only. Places come from range partitions: each counts and sums its own rows,
and the sums of the partitions before it are added, so that no task orders all records.

Defined results: null html is an empty body, a null url an empty target; a null id stands first;
rows that repeat an id keep a record each, ordered by url and content; replicas of different
length differ where one has no record. An empty body is a record of its header; a body of any
length is hashed whole. Of equal records with one id the last ones count as lost or added. An empty
table has no tree and no differences. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandjoin.llm.common import stage

FAN_BITS = 4
#: Fixed value: the date of the records, as the tables have none.
DATE = "2020-01-01T00:00:00Z"


def record(url: Column, body: Column) -> Column:
    """The bytes of one WARC response record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def body(record: Column) -> Column:
    """The content of a record: what follows the header, without the closing line ends."""
    text = record.cast("string")
    at = F.instr(text, "\r\n\r\n")
    return F.substring(text, at + 4, F.length(text) - at - 7)


def place_records(records: DataFrame, order: list[str]) -> DataFrame:
    """(id, place, begin, end, hash) of records (id, record and the columns of order)."""
    narrow = records.select(
        *dict.fromkeys(["id", *order]),
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("own"),
    )
    ranged = narrow.repartitionByRange(*order, "own").sortWithinPartitions(*order, "own")
    ranged = stage(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "records")
    sums = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.min("row").alias("row0"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "part",
        "row0",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
    )
    # A range is as large as a task's share, so its running sum is one task's work.
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("sum", F.sum("length").over(inside)).join(F.broadcast(starts), "part")
    end = F.col("bytes0") + F.col("sum")
    begin = end - F.col("length")
    return placed.select(
        "id",
        (F.col("n0") + F.col("row") - F.col("row0")).alias("place"),
        begin.alias("begin"),
        end.alias("end"),
        F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "own", "length"), 256).alias("hash"),
    )


def node_level(children: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """The nodes above: (place, begin, end, hash) of each group of 2 ** bits neighbours."""
    up = children.withColumn("up", F.shiftright("place", bits))
    joined = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"]
    )
    return up.groupBy(F.col("up").alias("place")).agg(
        F.min("begin").alias("begin"),
        F.max("end").alias("end"),
        F.sha2(F.concat_ws("|", F.array_join(joined, "|"), F.max("end") - F.min("begin")), 256).alias("hash"),
    )


def merkle_tree(leaves: DataFrame, bits: int = FAN_BITS) -> list[DataFrame]:
    """The levels of the tree, leaves first, root last; each is a written table."""
    levels = [stage(leaves, "level-0")]
    last = levels[0].agg(F.max("place")).first()[0] or 0
    while last > 0:
        levels.append(stage(node_level(levels[-1], bits), f"level-{len(levels)}"))
        last >>= bits
    return levels


def match_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves without a partner of their id and hash, with the one of that id on the other side.

    place is the left one, or the right one's where the left has none.
    """
    sides = []
    for name, leaves in (("left", left), ("right", right)):
        same = Window.partitionBy("id", "hash").orderBy("place")
        sides.append(leaves.select("id", "place", "begin", "end", "hash", F.row_number().over(same).alias("nth"), F.lit(name).alias("side")))
    both = sides[0].unionByName(sides[1])
    # A partner has the same id, hash and number: the two rows cancel out.
    met = both.groupBy("id", "hash", "nth").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("side", "place", "begin", "end")).alias("only"))
    alone = met.where("n = 1").select("id", "hash", "only.*")
    nth = F.row_number().over(Window.partitionBy("id", "side").orderBy("place"))
    alone = alone.withColumn("nth", nth)
    at = lambda side: F.max(F.when(F.col("side") == side, F.struct("id", "begin", "end", "hash", "place")))
    paired = alone.groupBy("id", "nth").agg(at("left").alias("l"), at("right").alias("r"))
    columns = [F.col(f"{side[0]}.{c}").alias(f"{side}_{c}") for side in ("left", "right") for c in ("id", "begin", "end", "hash")]
    return paired.select(F.coalesce("l.place", "r.place").alias("place"), *columns)


def audit(left: list[DataFrame], right: list[DataFrame], bits: int = FAN_BITS) -> DataFrame:
    """Leaves that differ: place, and id, begin, end, hash on the left and on the right."""
    height = max(len(left), len(right))
    wrong = None
    for level in range(height - 1, -1, -1):
        # The shorter tree has its root again on the levels it lacks.
        a, b = left[min(level, len(left) - 1)], right[min(level, len(right) - 1)]
        if wrong is not None:
            ups = wrong.select(F.col("place").alias("up"))
            a = a.join(ups, F.shiftright(a["place"], bits) == F.col("up"), "left_semi")
            b = b.join(ups, F.shiftright(b["place"], bits) == F.col("up"), "left_semi")
        if level == 0:
            return match_leaves(a, b)
        a = a.select("place", F.col("hash").alias("left_hash"))
        b = b.select("place", F.col("hash").alias("right_hash"))
        both = a.join(b, "place", "full_outer")
        wrong = both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        wrong = stage(wrong.select("place"), f"wrong-{level}")
    return wrong
