"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of hashes of its word 4-grams; rows with equal sets are one class. A
class's shingles are counted in groups by hash; the counts are its point. Two classes can share
at most the sum over the groups of the smaller count, and a node of the tree (its largest count
in every group, its smallest and largest set) bounds all points below it in the same way: a
search descends only where the bound reaches what the threshold needs. Pairs that survive are
verified on the sets.

Which points are put into one tree: two sets as similar as the threshold share one of their
first `n - ceil(t * n) + 1` shingles in any common order. Classes that share such a shingle meet
under the smallest class that holds it. The order puts shingles of crowded buckets last, by
counts over all documents in BUCKETS buckets, so that passages many documents share seldom bring
them together. A tree of more than LEAF_ROWS classes, or LEAF_ITEMS items, is dealt out as pairs of its parts.

Trees are searched twice: over points alone, to find the classes that may have a partner, and
with the sets of those classes, which are read from the texts again, to verify. Links inside a
tree are told as a spanning forest: linking every member of a group of copies to
all others would be the square of its size. Classes already joined by verified links are not
compared again. Equal sets are one class however many rows have them.

Hashes have 64 bits; classes are told apart by 128 bits.

Defined results: a text without words, or null, has an empty set and links with nothing; a text
of fewer than four words is one shingle; a null doc_id counts as the largest in its component;
repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.common import numbered_rows, stage
from strandjoin.llm.components import components
from strandjoin.llm.text_bytes import BASE, mix, slices, split_words

SHINGLE = 4
#: The threshold as a fraction: numerator and denominator.
THRESHOLD = (85, 100)
BUCKETS = 1 << 18
#: Buckets with over so many times the mean count are crowded; each doubling ranks a step later.
CROWDED = 1.25
#: Most bits of the bitmap of wanted classes.
MOST_BITS = 1 << 26
#: Coordinates of a point in a tree; a large set also has a finer point, of one coordinate for
#: every ITEMS_EACH items at least.
GROUPS = 128
MOST_GROUPS = 8192
ITEMS_EACH = 16
#: Children of a node; classes and items that one part of a tree holds at most, about.
FAN_OUT = 16
LEAF_ROWS = 4096
LEAF_ITEMS = 1 << 21


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and where each text's begin."""
    found = split_words(texts)
    words, counts = found.hashes(), np.diff(found.first)
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        rolled[: n - i] = rolled[: n - i] * BASE + words[i:]
    hashes = mix(rolled)
    # The last words of a text start no shingle, but a short text is one.
    left = np.repeat(found.first[1:], counts) - np.arange(n)
    whole = left >= k
    for doc in np.flatnonzero((counts > 0) & (counts < k)):
        begin, end = found.first[doc], found.first[doc + 1]
        with np.errstate(over="ignore"):
            value = np.uint64(end - begin)
            for word in words[begin:end]:
                value = value * BASE + word
        hashes[begin] = mix(np.array([value ^ BASE]))[0]
        whole[begin] = True
    docs, hashes = found.doc[whole], hashes[whole]
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    docs, hashes = docs[new], hashes[new]
    return hashes, np.searchsorted(docs, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes that name a set, as signed numbers."""
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes + np.uint64(int(BASE) * salt % (1 << 64))), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def prefix_length(n: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    over, under = threshold
    return n - -(-n * over // under) + 1


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (doc_id, n, s1, s2, point) and of counts (bucket, n), told apart by bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                hashes, first = shingles(part.column(1), k)
                counts += np.bincount((hashes >> np.uint64(64 - 18)).astype(np.int64), minlength=BUCKETS)
                s1, s2 = signatures(hashes, first)
                n = np.diff(first)
                none = pa.nulls(len(n), pa.int32())
                points = pa.array([count_vector(hashes[a:b]).tobytes() for a, b in zip(first, first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), none, pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), points], names=names
                )
        at = np.flatnonzero(counts)
        empty = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), kind), pa.array(at, pa.int32()), pa.array(counts[at]), empty, empty, pa.nulls(len(at), pa.binary())],
            names=names,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "bucket", "n", "s1", "s2", "point"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bucket int, n long, s1 long, s2 long, point binary"
    return docs.mapInArrow(scan, schema)


def crowding(counts: DataFrame) -> np.ndarray:
    """Rank of every bucket: 0 for ordinary ones. BUCKETS rows reach the driver at most."""
    summed = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.uint8)
    if len(summed):
        mean = max(1.0, summed["n"].sum() / BUCKETS)
        rank = np.log2(np.maximum(1.0, summed["n"].to_numpy() / (CROWDED * mean)))
        out[summed["bucket"].to_numpy()] = np.ceil(rank).astype(np.uint8)
    return out


def prefixes(docs: DataFrame, rank: np.ndarray, k: int, threshold: tuple[int, int]) -> DataFrame:
    """(shingle, s1): the first shingles of every class, once for each task that meets it.

    Classes that agree in s1 alone are met together, which only adds candidates.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, 1):
                hashes, first = shingles(part.column(1), k)
                s1, s2 = signatures(hashes, first)
                n = np.diff(first)
                own = np.zeros(len(n), dtype=bool)
                for i in np.flatnonzero(n):
                    name = (int(s1[i]), int(s2[i]))
                    if name not in seen:
                        seen.add(name)
                        own[i] = True
                doc = np.repeat(np.arange(len(n)), n)
                keep = own[doc]
                doc, kept = doc[keep], hashes[keep]
                late = crowded[(kept >> np.uint64(64 - 18)).astype(np.int64)]
                order = np.lexsort((kept, late, doc))
                doc, kept = doc[order], kept[order]
                begin = np.searchsorted(doc, np.arange(len(n)))
                nth = np.arange(len(doc)) - begin[doc]
                head = nth < prefix_length(n, threshold)[doc]
                doc, kept = doc[head], kept[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept.view(np.int64)), pa.array(s1[doc])], names=["shingle", "s1"]
                )

    return docs.mapInArrow(scan, "shingle long, s1 long")


def meetings(firsts: DataFrame) -> DataFrame:
    """(leader, s1): who meets under whom. Only shingles of two classes or more count."""
    by_shingle = firsts.groupBy("shingle").agg(F.min("s1").alias("leader"), F.max("s1").alias("last"))
    shared = by_shingle.where(F.col("leader") != F.col("last")).select("shingle", "leader")
    return firsts.join(shared, "shingle").select("leader", "s1").distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(s1, s2, items): the sets of the wanted classes (s1, s2).

    A bitmap of bounded size, made from all wanted classes, spares most others the way through
    the shuffle; the join that follows is exact.
    """
    bits = int(min(MOST_BITS, max(1 << 16, 1 << (int(wanted.count()) * 16).bit_length())))
    place = lambda s: F.pmod(s, F.lit(bits))
    words = wanted.select(place(F.col("s1")).alias("at")).select(
        F.shiftright("at", 5).alias("word"), F.expr("shiftleft(1L, cast(at % 32 AS int))").alias("bit")
    )
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    bitmap = np.zeros(bits >> 5, dtype=np.uint32)
    bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bit"].to_numpy(dtype=np.uint64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, 1):
                hashes, first = shingles(part.column(1), k)
                s1, s2 = signatures(hashes, first)
                at = (s1 % bits).astype(np.uint64)
                held = (shared.value[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
                own = []
                for i in np.flatnonzero(held):
                    name = (int(s1[i]), int(s2[i]))
                    if name not in seen:
                        seen.add(name)
                        own.append(i)
                items = [hashes[first[i] : first[i + 1]].tobytes() for i in own]
                own = np.array(own, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s1[own]), pa.array(s2[own]), pa.array(items, pa.binary())], names=["s1", "s2", "items"]
                )

    return docs.mapInArrow(scan, "s1 long, s2 long, items binary")


class Forest:
    """Union-find over places in an array; the smallest place is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Tree:
    """R-tree over count vectors, packed by set size and then by the largest differences."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.levels = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while len(top) > 1:
            cuts = np.arange(0, len(top), FAN_OUT)
            top = np.maximum.reduceat(top, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))
        self.points, self.sizes = points[self.order], sizes[self.order]

    def search(self, point: np.ndarray, size: int, threshold: tuple[int, int]) -> np.ndarray:
        """Places of the points that may be as similar to this one as the threshold asks."""
        nodes = np.zeros(1, dtype=np.int64)
        for top, low, high in reversed(self.levels):
            nodes = nodes[nodes < len(top)]
            nodes = nodes[self._may(top[nodes], low[nodes], high[nodes], point, size, threshold)]
            nodes = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
        nodes = nodes[nodes < len(self.points)]
        sizes = self.sizes[nodes]
        return self.order[nodes[self._may(self.points[nodes], sizes, sizes, point, size, threshold)]]

    @staticmethod
    def _may(top, low, high, point, size, threshold) -> np.ndarray:
        """Overlap is at most the sum of smaller counts; the union at least what is left."""
        most = np.minimum(np.minimum(top, point).sum(axis=1, dtype=np.int64), np.minimum(high, size))
        return may_link(most, size, np.maximum(low, most), threshold)


def count_vector(items: np.ndarray) -> np.ndarray:
    """Items by group; folding a finer vector gives the coarser one."""
    n = GROUPS
    while n < MOST_GROUPS and n * ITEMS_EACH < len(items):
        n *= 2
    return np.bincount((items & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.int32)


def fold(vector: np.ndarray, n: int = GROUPS) -> np.ndarray:
    return vector.reshape(-1, n).sum(axis=0)


def may_link(overlap, a, b, threshold: tuple[int, int]):
    """Whether sets of these sizes that share at most so many items can be similar enough."""
    over, under = threshold
    return overlap * (over + under) >= over * (a + b)


def links(sets: list[np.ndarray], part: np.ndarray, pair: tuple[int, int], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between (or, if equal, inside) two parts of the sets."""
    over, under = threshold
    forest, linked = Forest(len(sets)), []
    for i, found in candidates([count_vector(s) for s in sets], part, pair, threshold):
        for j in found:
            if forest.root(i) == forest.root(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common * under >= over * (len(sets[i]) + len(sets[j]) - common):
                forest.join(i, j)
                linked.append((i, j))
    return linked


def deal(met: DataFrame, classes: DataFrame, leaf_rows: int, leaf_items: int) -> DataFrame:
    """(leader, low, high, part, s1, s2, point): the members of every pair of parts of a tree."""
    sized = met.join(classes.groupBy("s1").agg(F.sum("n").alias("n")), "s1")
    members = sized.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("items"))
    parts = F.greatest(F.ceil(F.col("members") / leaf_rows), F.ceil(F.col("items") / leaf_items)).cast("int")
    dealt = met.join(members.select("leader", parts.alias("parts")), "leader")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("s1"), F.col("parts")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("part", other).alias("low"), F.greatest("part", other).alias("high")),
    )
    dealt = dealt.select("leader", "s1", "part", F.explode_outer(pairs).alias("pair"))
    return dealt.join(classes.select("s1", "s2", "point"), "s1").select("leader", "pair.*", "part", "s1", "s2", "point")


KEYS = ("leader", "low", "high")


def together(rows: DataFrame) -> DataFrame:
    """The members of each pair of parts next to each other in one task."""
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "s1", "s2")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows of equal KEYS) and the borders of the groups in them."""
    held: list[pa.RecordBatch] = []
    for batch in _and_none(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(3)]
            if [batch.column(k)[0].as_py() for k in range(3)] == last and len(held) > 1:
                continue
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(k).to_numpy() for k in range(3)])
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        borders = np.concatenate([[0], new, [table.num_rows]])
        if batch is not None:
            cut = borders[-2]
            held = table.slice(cut).to_batches()
            table, borders = table.slice(0, cut), borders[:-1]
        if len(borders) > 1:
            yield table, borders


def _and_none(batches):
    yield from batches
    yield None


def candidates(points: list[np.ndarray], part: np.ndarray, pair: tuple[int, int], threshold: tuple[int, int]):
    """(place, places of possible partners in the other part); inside a part, later places only."""
    coarse = np.stack([fold(p) for p in points])
    sizes = coarse.sum(axis=1, dtype=np.int64)
    other = np.flatnonzero(part == pair[1])
    own = np.flatnonzero(part == pair[0])
    if not len(other) or not len(own):
        return
    tree = Tree(coarse[other], sizes[other])
    for i in own:
        found = other[tree.search(coarse[i], int(sizes[i]), threshold)]
        found = found[found > i] if pair[0] == pair[1] else found
        found = [j for j in found if _fine(points[i], points[j], sizes[i], sizes[j], threshold)]
        if found:
            yield i, found


def _fine(a: np.ndarray, b: np.ndarray, n: int, m: int, threshold: tuple[int, int]) -> bool:
    """The bound by the finest points that both have."""
    groups = min(len(a), len(b))
    if groups == GROUPS:
        return True
    return bool(may_link(np.minimum(fold(a, groups), fold(b, groups)).sum(dtype=np.int64), n, m, threshold))


def with_partners(dealt: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The members that the tree finds a possible partner for: (leader, low, high, part, s1, s2).

    Groups of two, which most are, are compared all at once.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches):
            points = [np.frombuffer(x, dtype=np.int32) for x in table.column("point").to_pylist()]
            part = table.column("part").to_numpy()
            met = np.zeros(len(points), dtype=bool)
            twos = borders[:-1][np.diff(borders) == 2]
            if len(twos):
                coarse = np.stack([fold(points[i]) for at in twos for i in (at, at + 1)])
                a, b = coarse[::2], coarse[1::2]
                shared = np.minimum(a, b).sum(axis=1, dtype=np.int64)
                n, m = a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64)
                for k in np.flatnonzero(may_link(shared, n, m, threshold)):
                    i = twos[k]
                    if _fine(points[i], points[i + 1], n[k], m[k], threshold):
                        met[i : i + 2] = True
            for begin, end in zip(borders, borders[1:]):
                if end - begin > 2:
                    pair = (table.column("low")[begin].as_py(), table.column("high")[begin].as_py())
                    for i, found in candidates(points[begin:end], part[begin:end], pair, threshold):
                        met[begin + i] = True
                        met[begin + np.array(found)] = True
            kept = table.drop_columns(["point"]).filter(pa.array(met))
            yield from kept.to_batches()

    return together(dealt).mapInArrow(search, "leader long, low int, high int, part int, s1 long, s2 long")


def link_classes(partners: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) links between classes, enough to connect what is connected."""
    rows = partners.join(sets.dropDuplicates(["s1", "s2"]), ["s1", "s2"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches):
            names = np.stack([table.column("s1").to_numpy(), table.column("s2").to_numpy()])
            part = table.column("part").to_numpy()
            found = []
            for begin, end in zip(borders, borders[1:]):
                own = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("items").slice(begin, end - begin)]
                pair = (table.column("low")[begin].as_py(), table.column("high")[begin].as_py())
                found += [(begin + i, begin + j) for i, j in links(own, part[begin:end], pair, threshold)]
            a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
            columns = [pa.array(names[k][at]) for at in (a, b) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a1", "a2", "b1", "b2"])

    ordered = together(rows.select(*KEYS, "part", "s1", "s2", "items"))
    found = ordered.mapInArrow(search, "a1 long, a2 long, b1 long, b2 long")
    name = lambda x: F.struct(F.col(f"{x}1").alias("s1"), F.col(f"{x}2").alias("s2")).alias(x)
    return found.select(name("a"), name("b"))


def similar_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    leaf_rows: int = LEAF_ROWS,
    leaf_items: int = LEAF_ITEMS,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scanned = stage(describe(read, shingle), "sets")
    rows = scanned.where(F.col("bucket").isNull()).select("doc_id", "n", "s1", "s2", "point")
    rank = crowding(scanned.where(F.col("bucket").isNotNull()).select("bucket", "n"))
    filled = rows.where(F.col("n") > 0)
    classes = filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"))
    met = stage(meetings(prefixes(read, rank, shingle, threshold)), "meetings")
    partners = stage(with_partners(deal(met, classes, leaf_rows, leaf_items), threshold), "partners")
    sets = class_sets(read, partners.select("s1", "s2").distinct(), shingle)
    edges = stage(link_classes(partners, sets, threshold), "links")
    linked = components(edges).select("node.s1", "node.s2", "root")
    own = F.struct("s1", "s2")
    rooted = classes.join(linked, ["s1", "s2"], "left").select("s1", "s2", "doc_id", F.coalesce("root", own).alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("s1", "s2", "component_id")
    found = filled.join(named, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first row of each component by id, then place, with all its columns; null ids are last.

    Rows are told apart by number, so neither null nor repeated ids take other rows with them.
    The numbers are stored with the rows, so that a cluster that grows or shrinks in between does
    not number them anew.
    """
    numbered, row = numbered_rows(docs, "numbered")
    key = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(row).alias("row"))
    judged = similar_documents(numbered.select(key.alias("key"), F.col(text).alias("text")), "key", "text", **options)
    gone = judged.where(F.col("doc_id.row") != F.col("component_id.row"))
    gone = stage(gone.select(F.col("doc_id.row").alias(row)), "similar")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
