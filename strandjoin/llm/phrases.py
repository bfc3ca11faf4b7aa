"""Phrase collocation mining: candidates by a safe filter, exact counts by double-array tries.

Texts in lower case (A-Z) are cut into pieces at punctuation and line ends, pieces into words. A
candidate is a phrase of 2 to 5 words that occurs MIN_COUNT times in its language.

1. Words are counted for each language, exactly, by word.
2. Level by level, phrases whose first and last k - 1 words may be frequent are counted by two 64-bit
   hashes, of their first k - 1 words and of their last. A hash counts at least as much as each of
   its phrases, so no frequent phrase is lost (the Apriori rule and the hashes only let more
   through). The frequent hashes of a level become a bitmap of fixed size, by which the next
   level is filtered in the scan; joined to the level below and to the words they become texts.
3. These candidates are dealt to tries of about TRIE_PHRASES. A trie is a double array over words, first the language, then the
   words. It is broadcast; NumPy advances the states of all positions of a slice of texts
   together, a word at a time, and counts the accepting states. Each task's counts are summed.

More candidates than a trie holds make more tries, one after the other, each over all texts: what a
task holds does not grow with the data, the number of passes does, with the frequent phrases.

Defined results: a null text is empty, a null lang is `und`; rows count as often as they repeat,
whatever their ids; ties of the ranking end at the phrase, which is unique in a language; an
empty table gives no rows; other columns are not read. A very long text is one slice.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandjoin.llm.common import LOWER, UPPER, stage
from strandjoin.llm.text_bytes import Words, mix, slices

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Candidates of one trie, on average; their shares follow a hash.
TRIE_PHRASES = 250_000
#: Counts of a trie that travel and are summed together, and groups of tasks that are summed first.
BLOCK, LANES = 4096, 64
#: Bits of the bitmap of frequent hashes, as a power of two: 4 MB.
FILTER_BITS = 25
#: Words or places that a task holds before it hands them on.
HELD = 2_000_000
#: The characters that end a piece, and those between words.
ENDS, BETWEEN = ".,;:!?\n\x0b\x0c\r", " \t"
PLAIN = bytes.maketrans((UPPER + ENDS).encode(), (LOWER + "\n" * len(ENDS)).encode())


@dataclass
class Slice:
    """Words of some texts: words, piece and language number of each; langs: the languages."""

    joined: bytes
    split: Words
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Slice:
        """batch: lang, text."""
        parts = [(t or "").encode("utf-8", "surrogatepass").translate(PLAIN) for t in batch.column(1).to_pylist()]
        coded = batch.column(0).dictionary_encode()
        joined = b"\n".join(parts) + b"\n"
        data = np.frombuffer(joined, dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = (data != 32) & (data != 9) & (data != 10)
        border = np.diff(inside)
        start, end = np.flatnonzero(border == 1), np.flatnonzero(border == -1)
        ends = np.cumsum([len(p) + 1 for p in parts])
        doc = np.searchsorted(ends, start, side="right")
        piece = np.cumsum(data == 10)[start]
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        return cls(joined, Words(data, start, end, doc, start[:0]), piece, numbers[doc], coded.dictionary.to_pylist())

    def words(self) -> list[bytes]:
        return self.joined.split()

    def same_piece(self, k: int) -> np.ndarray:
        """For each place whether k words from it on stand in one piece; k - 1 places fewer."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def hashes(self, longest: int) -> list[np.ndarray]:
        """Hashes of the phrases of 1 .. longest words at each place, of their language too."""
        seeds = np.array([int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") + len(lang) for lang in self.langs], dtype=np.uint64)
        single = mix(self.split.hashes() ^ mix(seeds)[self.lang]) if len(self.piece) else np.zeros(0, dtype=np.uint64)
        found = [single]
        for k in range(2, longest + 1):
            n = max(0, len(single) - k + 1)
            found.append(next_key(found[-1][:n], single[k - 1 : k - 1 + n]))
        return found


def in_bitmap(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - width)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for part in slices(batch, 1):
            yield Slice.of(part)


def count_words(read: DataFrame) -> DataFrame:
    """lang, word, key (its hash), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        keys: dict = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, keys[lang, w], n) for lang, counted in held.items() for w, n in counted.items()]
            held.clear()
            keys.clear()
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["lang", "word", "key", "n"]
            )

        for part in _slices(batches):
            words, hashes = part.words(), part.hashes(1)[0].view(np.int64).tolist()
            # Texts of one language stand together as a run of words.
            cuts = np.flatnonzero(np.diff(part.lang)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
                if a < b:
                    lang = part.langs[part.lang[a]]
                    counted = held.setdefault(lang, Counter())
                    counted.update(words[a:b])
                    keys.update(zip([(lang, w) for w in words[a:b]], hashes[a:b]))
            if len(keys) > HELD:
                yield out()
        yield out()

    partial = read.mapInArrow(run, "lang string, word binary, key bigint, n bigint")
    return partial.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def bitmap_of(keys: DataFrame, width: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of the leading bits of all keys, of 2 ** width bits."""
    bit = F.shiftrightunsigned("key", 64 - width) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    found = np.zeros(max(1, (1 << width) // 8), dtype=np.uint8)
    for row in parts.toLocalIterator():
        begin = (row["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)[: len(found) - begin]
        found[begin : begin + len(part)] = part
    return found


def next_key(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its words but the last and that of the last word."""
    return mix(prefix * np.uint64(0xD1342543DE82EF95) + last)


def possible_phrases(read: DataFrame, k: int, shorter: np.ndarray, min_count: int, width: int = FILTER_BITS) -> DataFrame:
    """key, prefix, last: hashes that phrases of k words have min_count times or more.

    prefix is the hash of the first k - 1 words, last that of the last word. Only phrases both of
    whose parts of k - 1 words may be frequent are counted.
    """
    known = read.sparkSession.sparkContext.broadcast(shorter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            prefix, last = (np.concatenate([h[i] for h in held]) for i in range(2))
            _, first, place, n = np.unique(next_key(prefix, last), return_index=True, return_inverse=True, return_counts=True)
            # Different pairs of one hash would be counted as one: then each stays by itself.
            if not ((prefix == prefix[first][place]) & (last == last[first][place])).all():
                first, n = np.arange(len(prefix)), np.ones(len(prefix), dtype=np.int64)
            columns = [pa.array(prefix[first].view(np.int64)), pa.array(last[first].view(np.int64)), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["prefix", "last", "n"])

        for part in _slices(batches):
            hashes = part.hashes(k - 1)
            likely = in_bitmap(known.value, hashes[k - 2], width) & part.same_piece(k - 1)
            whole = part.same_piece(k)
            chosen = np.flatnonzero(whole & likely[: len(whole)] & likely[1 : 1 + len(whole)])
            held.append((hashes[k - 2][chosen], hashes[0][chosen + k - 1]))
            size += len(chosen)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    counted = read.mapInArrow(run, "prefix bigint, last bigint, n bigint").groupBy("prefix", "last")
    frequent = counted.agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("prefix", "last")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, last = (c.to_numpy().view(np.uint64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(next_key(prefix, last).view(np.int64)), *batch.columns], names=["key", "prefix", "last"])

    return frequent.mapInArrow(name, "key bigint, prefix bigint, last bigint")


def phrase_texts(level: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """key, lang, phrase of a level. shorter, words: key, lang, phrase of the level below and of words.

    Where different texts share a hash, all their combinations come out; the exact counts decide.
    """
    first = shorter.select(F.col("key").alias("prefix"), "lang", F.col("phrase").alias("first"))
    rest = words.select(F.col("key").alias("last"), "lang", F.col("phrase").alias("rest"))
    met = level.join(first, "prefix").join(rest, ["last", "lang"])
    return met.select("key", "lang", F.concat_ws(" ", "first", "rest").alias("phrase"))


class Trie:
    """A double array over symbols: the child of state s by symbol c is t = base[s] + c if check[t] is s.

    Symbols of languages and words count from 1. accepts[t] is the number of the phrase that ends in
    a state, or -1.
    """

    def __init__(self, phrases: list[tuple[str, bytes]]) -> None:
        self.words = {w: i for i, w in enumerate(sorted({w for _, p in phrases for w in p.split(b" ")}), 1)}
        self.langs = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in phrases}), len(self.words) + 1)}
        children: dict = {}
        ends: dict = {}
        nodes = 1
        for number, (lang, phrase) in enumerate(phrases):
            node = 0
            for symbol in (self.langs[lang], *[self.words[w] for w in phrase.split(b" ")]):
                row = children.setdefault(node, {})
                if symbol not in row:
                    row[symbol] = nodes
                    nodes += 1
                node = row[symbol]
            ends[node] = number
        symbols = len(self.words) + len(self.langs) + 1
        size = 2 * (nodes + symbols) + 1
        state = np.zeros(nodes, dtype=np.int64)
        free, draw = 1, np.random.default_rng(0)
        parents = np.zeros(nodes, dtype=np.int64)
        for node, row in children.items():
            parents[list(row.values())] = node
        bases = np.zeros(nodes, dtype=np.int64)
        taken = np.zeros(size, dtype=bool)
        taken[0] = True
        # The widest nodes choose first, while there is room.
        for node in sorted(children, key=lambda x: -len(children[x])):
            row = np.fromiter(children[node], dtype=np.int64, count=len(children[node]))
            row.sort()
            own = row - row[0]
            while True:
                while taken[free]:
                    free += 1
                tries = np.concatenate([[free], draw.integers(free, size - symbols, 15)])
                fits = ~taken[tries[:, None] + own].any(axis=1)
                if fits.any():
                    begin = tries[np.argmax(fits)]
                    break
                size *= 2
                taken = np.concatenate([taken, np.zeros(size - len(taken), dtype=bool)])
            taken[begin + own] = True
            bases[node] = begin - row[0]
            for symbol in row.tolist():
                state[children[node][symbol]] = begin + symbol - row[0]
        base, check = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        base[state] = bases
        check[state[1:]] = state[parents[1:]]
        self.base, self.check, self.accepts = base, check, np.full(size, -1, dtype=np.int32)
        for node, number in ends.items():
            self.accepts[state[node]] = number
        self.size, self.count = size, len(phrases)

    def __getstate__(self) -> tuple:
        """Most cells are empty, so the arrays travel packed: some MB pass through the driver."""
        arrays = [zlib.compress(a.tobytes(), 1) for a in (self.base, self.check, self.accepts)]
        return b" ".join(self.words), list(self.langs), self.count, arrays

    def __setstate__(self, state: tuple) -> None:
        words, langs, self.count, arrays = state
        self.words = {w: i for i, w in enumerate(words.split(b" ") if words else [], 1)}
        self.langs = {lang: i for i, lang in enumerate(langs, len(self.words) + 1)}
        self.base, self.check, self.accepts = (np.frombuffer(zlib.decompress(a), dtype=np.int32) for a in arrays)
        self.size = len(self.base)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        at = self.base[states].astype(np.int64) + symbols
        inside = (states >= 0) & (symbols > 0) & (at >= 0) & (at < self.size)
        at[~inside] = 0
        return np.where(inside & (at > 0) & (self.check[at] == states), at, -1)

    def counts(self, part: Slice, longest: int) -> np.ndarray:
        """Occurrences of each phrase in a slice."""
        symbols = np.fromiter(map(self.words.get, part.words(), _zeros()), dtype=np.int64, count=len(part.piece))
        langs = np.array([self.langs.get(lang, 0) for lang in part.langs], dtype=np.int64)
        places = np.arange(len(symbols))
        states = self.step(np.zeros(len(symbols), dtype=np.int64), langs[part.lang] if len(langs) else symbols)
        found = np.zeros(self.count, dtype=np.int64)
        for k in range(1, longest + 1):
            # Only positions that still have a state go on, while the piece lasts.
            alive = (states >= 0) & (places + k - 1 < len(symbols))
            places, states = places[alive], states[alive]
            alive = part.piece[places] == part.piece[places + k - 1]
            places, states = places[alive], states[alive]
            states = self.step(states, symbols[places + k - 1])
            accepted = self.accepts[states[states >= 0]]
            found += np.bincount(accepted[accepted >= 0], minlength=self.count)
        return found


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def count_phrases(read: DataFrame, phrases: DataFrame, longest: int, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """lang, phrase, n of the phrases (lang, phrase, each once): exact counts by tries."""
    spark = read.sparkSession
    shards = -(-phrases.count() // trie_phrases)
    shard = F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(1, shards))).alias("shard")

    def build(table: pa.Table) -> pa.Table:
        listed = sorted((lang, p.encode()) for lang, p in zip(table.column("lang").to_pylist(), table.column("phrase").to_pylist()))
        return pa.table({"shard": table.column("shard")[:1], "listed": [pickle.dumps(listed)], "trie": [pickle.dumps(Trie(listed))]})

    tries = phrases.select(shard, "lang", "phrase").groupBy("shard").applyInArrow(build, "shard bigint, listed binary, trie binary")
    tries = stage(tries, "tries")
    counted = None
    for number in range(shards):
        row = tries.where(F.col("shard") == number).select("trie").first()
        if row is None:  # by chance no phrase has this share
            continue
        own = _count_by_trie(spark, read, bytes(row["trie"]), longest).withColumn("shard", F.lit(number))
        own = stage(own, f"counts-{number}")
        counted = own if counted is None else counted.unionByName(own)
    if counted is None and shards:
        raise RuntimeError("the tries of the candidates are missing")
    if counted is None:
        return phrases.select("lang", "phrase", F.lit(0).cast("bigint").alias("n")).limit(0)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, packed in zip(batch.column("shard").to_pylist(), batch.column("listed").to_pylist()):
                rows = pickle.loads(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64()),
                     pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].decode() for r in rows], pa.string())],
                    names=["shard", "number", "lang", "phrase"],
                )

    names = tries.select("shard", "listed").mapInArrow(listing, "shard int, number bigint, lang string, phrase string")
    return names.join(counted, ["shard", "number"]).select("lang", "phrase", "n")


def _count_by_trie(spark: SparkSession, read: DataFrame, packed: bytes, longest: int) -> DataFrame:
    """number, n: every task's counts in blocks of BLOCK, summed by groups of tasks, then in all."""
    held = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = pickle.loads(held.value)
        total = np.zeros(-(-trie.count // BLOCK) * BLOCK, dtype=np.int64)
        for part in _slices(batches):
            total[: trie.count] += trie.counts(part, longest)
        blocks = total.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * BLOCK)
        counts = pa.ListArray.from_arrays(ends, pa.array(blocks[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), counts], names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, BLOCK)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([rows.sum(axis=0)], pa.list_(pa.int64()))})

    fields = "block int, counts array<bigint>"
    parts = read.mapInArrow(run, fields).withColumn("lane", F.spark_partition_id() % LANES)
    lanes = parts.groupBy("block", "lane").applyInArrow(add, fields)
    whole = lanes.groupBy("block").applyInArrow(add, fields)
    each = whole.select("block", F.posexplode("counts").alias("at", "n")).where("n > 0")
    return each.select((F.col("block").cast("bigint") * BLOCK + F.col("at")).alias("number"), "n")


def word_slice(words: Column, begin: Column | int, n: Column | int) -> Column:
    number = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.array_join(F.slice(words, number(begin), number(n)), " ")


def score_phrases(counts: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score: each phrase at its lowest-scoring cut.

    counts: lang, phrase, n of all candidates; words: lang, word, n of frequent words; totals: lang,
    n. Scores are exact: decimals of 38 digits hold the products.
    """
    phrases = counts.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    parts = counts.select("lang", "phrase", "n").unionByName(words.select("lang", F.col("word").alias("phrase"), "n"))
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumn("first", word_slice(F.col("words"), 1, F.col("k")))
    cut = cut.withColumn("rest", word_slice(F.col("words"), F.col("k") + 1, F.size("words")))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    whole = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(totals), "lang")
    exact = "cast(1000 * cast(a as decimal(15, 0)) * cast(n as decimal(17, 0)) as decimal(38, 0)) div cast(cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)) as decimal(38, 0))"
    scored = whole.withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def inside_longer(counts: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase of candidates inside a longer one with 100 * its count >= percent * their own."""
    words = F.split("phrase", " ")
    longer = counts.select("lang", F.col("n").alias("n_longer"), words.alias("words")).where(F.size("words") > 2)
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: word_slice(F.col("words"), i, k)),
        )
    )
    inner = longer.select("lang", "n_longer", F.explode(F.array_distinct(spans)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("n_longer").alias("n_longer"))
    joined = counts.join(most, ["lang", "phrase"])
    return joined.where(100 * F.col("n_longer") >= percent * F.col("n")).select("lang", "phrase")


def mine_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int | None = TOP,
    trie_phrases: int = TRIE_PHRASES,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; top None keeps all phrases."""
    read = _read(docs, text, lang)
    counted = stage(count_words(read), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counted.where(F.col("n") >= min_count).select("key", "lang", F.col("word").cast("string").alias("phrase"), "n")
    words = shorter = frequent.drop("n")
    bitmap, levels = bitmap_of(frequent.select("key"), filter_bits), []
    for k in range(2, longest + 1):
        found = stage(possible_phrases(read, k, bitmap, min_count, filter_bits), f"hashes-{k}")
        shorter = stage(phrase_texts(found, shorter, words), f"texts-{k}")
        levels.append(shorter.select("lang", "phrase"))
        bitmap = bitmap_of(found.select("key"), filter_bits)
        if not bitmap.any():
            break
    candidates = levels[0]
    for more in levels[1:]:
        candidates = candidates.unionByName(more)
    candidates = stage(candidates.distinct(), "candidates")
    exact = count_phrases(read, candidates, longest, trie_phrases).where(F.col("n") >= min_count)
    counts = stage(exact, "counts")
    scored = score_phrases(counts, frequent.select("lang", F.col("phrase").alias("word"), "n"), totals)
    kept = scored.join(inside_longer(counts), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
