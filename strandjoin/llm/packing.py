"""Best-fit packing of tokenized documents by bin completion.

Only the number of pieces of each length matters to the packing, and there are at most
`capacity` lengths. Spark tokenizes once, stages one narrow row for each piece and counts the
lengths; the driver solves the packing over that bounded histogram; pieces are then ranked
within their length, in buckets, and each rank is looked up in the bounded table of slots. The
counted pieces also say how many partitions the result needs: a small one is not left in as many
tiny files as there are shuffle partitions.

The solver takes the longest length left and enumerates the undominated fillings of the room
beside it (no other filling replaces its parts by as many or fewer longer ones that also fit),
least waste first, and applies a filling as often as its lengths last. A subset search by waste
bounds prunes it: a branch whose least waste cannot beat the incumbent is left out. Best-fit
solutions of the whole and of every rest are the incumbents. `search_nodes` bounds the effort
of the branch and bound, as it is exponential; the best packing found by then is used.

Defined results: null text is the empty text, whose only id is the end id. Repeated rows and ids
are packed each. Any number of sequences; an empty table gives none.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandjoin.llm.common import stage

CAPACITY = 2048
END_ID = 0
BUCKETS = 256
SEARCH_NODES = 2000
FILLINGS = 64
#: Partitions of the result are merged up to so many pieces, or so many kept ids, each.
PARTITION_PIECES = 1 << 15
PARTITION_IDS = 1 << 23
END_OF_TEXT = "<|endoftext|>"


@functools.cache
def encoders(vocabulary: str, ranks: str):
    """The tokenizer itself, and two encoders with its ranks that are several times as fast.

    The second encoder's pattern leaves out the look-ahead, which only runs of white space need.
    """
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = public_tokenizers.PATTERN
    full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    plain = pattern.replace(r"\s+(?!\S)|", "")
    fast = tiktoken.Encoding("fast", pat_str=plain, mergeable_ranks=table, special_tokens={})
    return Tokenizer.from_file(vocabulary), full, fast


def token_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str | None, vocabulary: str, ranks: str) -> np.ndarray:
    """The ids of a whole text and the end id, as unsigned 32-bit numbers."""
    whole, full, fast = encoders(vocabulary, ranks)
    if not text:
        ids = []
    elif END_OF_TEXT in text:
        ids = whole.encode(text, add_special_tokens=False).ids
    else:
        ids = (full if _has_wide_space(text) else fast).encode_ordinary(text)
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    out[-1] = END_ID
    return out


@functools.cache
def _wide_space():
    import regex

    return regex.compile(r"\s\s")


def _has_wide_space(text: str) -> bool:
    return _wide_space().search(text) is not None


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, but for a shorter first."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if first and s == 0 else capacity) for s in starts]


def tokenize(docs: DataFrame, doc_id: str, text: str, capacity: int, paths: tuple[str, str], keep_ids: bool) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if wanted, ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(value.as_py(), *paths)
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length].tobytes()
                    rows.append((key, k, start, length, zlib.crc32(own)) + ((own,) if keep_ids else ()))
            columns = list(zip(*rows)) or [()] * (5 + keep_ids)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(pieces, schema + ", ids binary" * keep_ids)


# The packing over a histogram of lengths.


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths: (lengths of a bin, number of such bins)."""
    left = {length: n for length, n in counts.items() if n}
    order = sorted(left, reverse=True)
    bins = []
    for longest in order:
        while left.get(longest):
            room, used = capacity, {}
            for length in order:
                if length <= room and left.get(length):
                    take = min(left[length], room // length)
                    used[length] = take
                    room -= take * length
            times = min(left[length] // take for length, take in used.items())
            for length, take in used.items():
                left[length] -= take * times
            bins.append((tuple(x for length in used for x in [length] * used[length]), times))
    return bins


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: by volume, with the waste that long items cannot avoid."""
    total = sum(length * n for length, n in counts.items())
    best = -(-total // capacity)
    for limit in sorted({x for x in counts if x <= capacity // 2} | {0}):
        big = sum(n for x, n in counts.items() if x > capacity - limit)
        middle = {x: n for x, n in counts.items() if capacity / 2 < x <= capacity - limit}
        n_middle = sum(middle.values())
        free = n_middle * capacity - sum(x * n for x, n in middle.items())
        small = sum(x * n for x, n in counts.items() if limit <= x <= capacity / 2)
        best = max(best, big + n_middle + max(0, -(-(small - free) // capacity)))
    return best


def fillings(order: np.ndarray, left: dict[int, int], room: int, most_waste: int) -> list[tuple[int, ...]]:
    """Undominated fillings of the room with at most so much waste, least waste first.

    Depth first from the longest length down, so that of fillings with equal sums the one with
    fewer, longer parts comes first; it dominates the others, which are left out.
    """
    if room <= 0:
        return [()]
    found: dict[int, tuple[int, ...]] = {}
    lengths = [int(x) for x in order if x <= room and left.get(int(x))]
    if not lengths:
        return [()]
    shortest = lengths[-1]
    stack = [(0, room, ())]
    steps = 0
    while stack and len(found) < FILLINGS and steps < 4096:
        at, free, parts = stack.pop()
        steps += 1
        if free < shortest or at == len(lengths):
            if free <= most_waste and free not in found:
                found[free] = parts
                if free == 0:
                    break
            continue
        k = int(np.searchsorted(-np.asarray(lengths[at:]), -free)) + at
        if k == len(lengths):
            if free <= most_waste and free not in found:
                found[free] = parts
            continue
        length = lengths[k]
        stack.append((k + 1, free, parts))
        if parts.count(length) < left[length]:
            stack.append((k, free - length, (*parts, length)))
    return [found[w] for w in sorted(found)] or [()]


def complete_bins(counts: dict[int, int], capacity: int, search_nodes: int = SEARCH_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion branch and bound; returns (lengths of a bin, number of such bins)."""
    counts = {length: n for length, n in counts.items() if n}
    if not counts:
        return []
    least = lower_bound(counts, capacity)
    total = sum(length * n for length, n in counts.items())
    size = lambda bins: sum(n for _, n in bins)
    incumbent = best_fit(counts, capacity)
    order = np.array(sorted(counts, reverse=True))
    # Waste that a packing with one bin fewer than the incumbent may have.
    spare = lambda: (size(incumbent) - 1) * capacity - total
    stack = [(dict(counts), (), 0, 0, 0)]
    nodes = 0
    while stack and size(incumbent) > least and nodes < search_nodes:
        left, done, n_bins, waste, rank = stack.pop()
        nodes += 1
        if waste > spare():
            continue
        longest = max((x for x, n in left.items() if n), default=0)
        if not longest:
            if n_bins < size(incumbent):
                incumbent = list(_unlink(done))
            continue
        rest = {x: n for x, n in left.items() if n}
        if nodes % 50 == 1:
            tried = best_fit(rest, capacity)
            if n_bins + size(tried) < size(incumbent):
                incumbent = [*_unlink(done), *tried]
        left[longest] -= 1
        options = fillings(order, left, capacity - longest, spare() - waste)
        left[longest] += 1
        # The fillings are branches; the best one is taken next, the next ones if it fails.
        for parts in reversed(options[:3]):
            used: dict[int, int] = {longest: 1}
            for x in parts:
                used[x] = used.get(x, 0) + 1
            times = min(left[x] // k for x, k in used.items())
            wasted = capacity - longest - sum(parts)
            if wasted:
                times = min(times, max(1, (spare() - waste) // wasted))
            after = dict(rest)
            for x, k in used.items():
                after[x] -= k * times
            linked = (done, ((longest, *parts), times))
            stack.append((after, linked, n_bins + times, waste + wasted * times, rank))
    return incumbent


def _unlink(done: tuple) -> Iterator[tuple[tuple[int, ...], int]]:
    while done:
        done, one = done
        yield one


def slot_table(bins: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Ranks of each length dealt to bins: (length, first rank, end, first bin, each, offset)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in bins:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            start = used.get(length, 0)
            used[length] = start + each * times
            rows.append((length, start, start + each * times, first, each, offset))
            offset += each * length
        first += times
    names = ["length", "rank", "end", "first_bin", "each", "offset"]
    return pd.DataFrame(rows, columns=names, dtype="int64").sort_values(["length", "rank"])


def result_partitions(counts: dict[int, int], keep_ids: bool, cores: int) -> int:
    """How many partitions hold the pieces: as many as there are cores, more as the pieces grow."""
    needed = -(-sum(counts.values()) // PARTITION_PIECES)
    if keep_ids:
        needed = max(needed, -(-sum(length * n for length, n in counts.items()) // PARTITION_IDS))
    return max(1, cores, needed)


def place(ranked: DataFrame, slots: pd.DataFrame) -> DataFrame:
    """Sequence and offset of every ranked piece; slots is bounded by the capacity."""
    keys = slots["length"].to_numpy() * (1 << 48) + slots["rank"].to_numpy()
    rank, first_bin, each, offset = (slots[c].to_numpy() for c in ("rank", "first_bin", "each", "offset"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(name).to_numpy() for name in ("length", "rank")}
            slot = np.searchsorted(keys, at["length"] * (1 << 48) + at["rank"], side="right") - 1
            nth = at["rank"] - rank[slot]
            sequence = first_bin[slot] + nth // each[slot]
            begin = offset[slot] + nth % each[slot] * at["length"]
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(begin)], names=[*names, "sequence_id", "offset"])

    names = [name for name in ranked.columns if name != "rank"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(look_up, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    paths: tuple[str, str] | None = None,
    keep_ids: bool = False,
    search_nodes: int = SEARCH_NODES,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    paths: of the vocabulary and of its ranks, readable on every executor.
    """
    pieces = stage(tokenize(docs, doc_id, text, capacity, paths or token_paths(), keep_ids), "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS))
    pieces = pieces.withColumn("bucket", bucket)
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = {r["length"]: r["n"] for r in histogram}
    slots = slot_table(complete_bins(counts, capacity, search_nodes))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1).drop("bucket", "nth", "before")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + ["rank"]
    n = result_partitions(counts, keep_ids, docs.sparkSession.sparkContext.defaultParallelism)
    return place(ranked.select(*columns).coalesce(n), slots)
