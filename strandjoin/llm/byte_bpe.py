"""Byte-level BPE encoding and decoding.

A text is cut into the matches of the vocabulary's pattern; each is encoded by itself. A match
that is a token as a whole is that token. Any other starts as single bytes, and a segment tree
over its byte positions holds, for each position, the rank of the pair that starts there: the root
is the smallest rank and, of equal ones, the leftmost. A merge takes the root's pair, links its
position to the following live one and updates three leaves, of the merged position, of the one
that went and of the live neighbour before, each in the logarithm of the length.

Many words take their steps together: the trees of all words of a size are rows of one NumPy
array, and a step merges the best pair of every word that still has one. Longer words go one by
one. Tasks keep what they encoded, up to CACHE_WORDS words. Very long texts are cut into stretches
where a match surely starts, so that a task holds the words of one stretch.

Defined results: a null text is the empty text, which has no ids; every row gives a row, also where
ids repeat or are null; an empty table gives none; other columns are not read. Decoding a null
list gives no bytes, an id that the vocabulary lacks fails with its number.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.text_bytes import slices

#: Words that a task remembers; beyond that it starts anew.
CACHE_WORDS = 400_000
#: Bytes up to which words take their steps together.
TOGETHER = 64
#: Characters of a text that are cut into words at once.
STRETCH = 1 << 20
#: Leaves of the trees that are built at once.
LEAVES = 1 << 20
NONE = np.int64(1 << 62)
#: Bits of a key below the rank; they hold the position.
PLACE_BITS = 40
#: A match of the usual patterns surely starts at such a blank.
CUT = regex.compile(r"(?<=\S) (?=\p{L})")
#: The characters of Unicode's White_Space, which \\s stands for in the pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def public_vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern that go with them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def word_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out, as libraries differ in what \\s holds."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelled)


class Vocabulary:
    """Ranks of byte strings, and the rank of each pair of tokens that makes up a third."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(self.ranks.values()) + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        tokens = {rank: token for token, rank in self.ranks.items()}
        listed = [tokens.get(i) for i in range(self.size)]
        self.lengths = np.array([-1 if t is None else len(t) for t in listed], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.lengths, 0))])[:-1]
        self.blob = np.frombuffer(b"".join(t or b"" for t in listed), dtype=np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the two make no token."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], NONE)

    def merge_together(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        """Ids of words of 2 to ``leaves`` bytes (a power of two), all trees at once."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        rows, columns = np.arange(n), np.arange(leaves)
        padded = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), dtype=np.uint8).reshape(n, leaves)
        # One more place on either side stands for "no neighbour"; arrays are flat, a row after
        # the other, with `wide` places or 2 * `leaves` nodes each.
        wide = leaves + 2
        ids = np.full((n, wide), -1, dtype=np.int64)
        ids[:, 1:-1] = np.where(columns < lengths[:, None], self.bytes[padded], -1)
        left, right = ids[:, 1:-1], ids[:, 2:]
        both = (left >= 0) & (right >= 0)
        ranks = np.full((n, leaves), NONE, dtype=np.int64)
        ranks[both] = self.pair_ranks(left[both], right[both])
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        tree[:, leaves:] = np.where(ranks < NONE, (ranks << PLACE_BITS) + columns, NONE)
        width = leaves
        while width > 1:
            level = tree[:, width : 2 * width]
            tree[:, width // 2 : width] = np.minimum(level[:, 0::2], level[:, 1::2])
            width //= 2
        ids, tree = ids.ravel(), tree.ravel()
        after, before = np.arange(1, n * wide + 1), np.arange(-1, n * wide - 1)

        def set_leaves(node: np.ndarray, key: np.ndarray) -> None:
            """Set the leaf of each row and the nodes above it."""
            tree[node] = key
            root = node - (node & (2 * leaves - 1))
            node = node - root
            for _ in range(leaves.bit_length() - 1):
                key = np.minimum(key, tree[root + (node ^ 1)])
                node >>= 1
                tree[root + node] = key

        def pair_keys(place: np.ndarray, column: np.ndarray) -> np.ndarray:
            """Keys of the pairs that start at these places."""
            a, b = ids[place], ids[after[place]]
            rank = self.pair_ranks(a, b)
            return np.where((a >= 0) & (b >= 0) & (rank < NONE), (rank << PLACE_BITS) + column, NONE)

        live, low = rows, (1 << PLACE_BITS) - 1
        while True:
            root = tree[live * (2 * leaves) + 1]
            going = root < NONE
            live, root = live[going], root[going]
            if not len(live):
                break
            column, begin, nodes = root & low, live * wide + 1, live * (2 * leaves) + leaves
            place = begin + column
            gone = after[place]
            following = after[gone]
            ids[place], ids[gone] = root >> PLACE_BITS, -1
            after[place], before[following] = following, place
            set_leaves(nodes + (gone - begin), np.full(len(live), NONE))
            set_leaves(nodes + column, pair_keys(place, column))
            earlier = before[place]
            inside = earlier >= begin
            earlier, column = earlier[inside], (earlier - begin)[inside]
            set_leaves(nodes[inside] + column, pair_keys(earlier, column))
        kept = ids.reshape(n, wide)[:, 1:-1]
        flat, counts = kept[kept >= 0].astype(np.int32), (kept >= 0).sum(axis=1)
        return np.split(flat, np.cumsum(counts)[:-1])

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same tree, step by step."""
        n, pairs, size = len(word), self.pairs, self.size
        leaves = 1 << max(1, (n - 1).bit_length())
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        tree = np.full(2 * leaves, NONE, dtype=np.int64)
        tree[leaves : leaves + n - 1] = np.where(ranks < NONE, (ranks << PLACE_BITS) + np.arange(n - 1), NONE)
        width = leaves
        while width > 1:
            tree[width // 2 : width] = tree[width : 2 * width].reshape(-1, 2).min(axis=1)
            width //= 2
        none, low, tree, ids = int(NONE), (1 << PLACE_BITS) - 1, memoryview(tree), memoryview(ids)
        after, before = memoryview(np.arange(1, n + 1)), memoryview(np.arange(-1, n - 1))

        def put(place: int, key: int) -> None:
            node = place + leaves
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                key, node = key if key < other else other, node >> 1
                if tree[node] == key:
                    return
                tree[node] = key

        def refresh(place: int) -> None:
            nearest = after[place]
            rank = pairs.get(ids[place] * size + ids[nearest]) if nearest < n else None
            put(place, none if rank is None else (rank << PLACE_BITS) + place)

        while tree[1] < none:
            place, rank = tree[1] & low, tree[1] >> PLACE_BITS
            gone = after[place]
            following = after[gone]
            ids[place], ids[gone], after[place] = rank, -1, following
            if following < n:
                before[following] = place
            put(gone, none)
            refresh(place)
            if before[place] >= 0:
                refresh(before[place])
        found = np.asarray(ids)
        return found[found >= 0].astype(np.int32)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word as 32-bit numbers."""
        found, sizes = {}, {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                found[word] = np.int32(whole).tobytes()
            elif len(raw) > TOGETHER:
                found[word] = self.merge_one(raw).tobytes()
            else:
                sizes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for leaves, listed in sizes.items():
            step = max(1, LEAVES // leaves)
            for first in range(0, len(listed), step):
                part = listed[first : first + step]
                merged = self.merge_together([raw for _, raw in part], leaves)
                found.update((word, ids.tobytes()) for (word, _), ids in zip(part, merged))
        return found

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        lengths = np.where((ids >= 0) & (ids < self.size), self.lengths[np.clip(ids, 0, self.size - 1)], -1)
        if (lengths < 0).any():
            raise ValueError(f"no token has the id {ids[lengths < 0][0]}")
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[shift + np.arange(len(shift))]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters; a match never spans two of them."""
    begin = 0
    while len(text) - begin > STRETCH:
        cut = CUT.search(text, begin + STRETCH)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


class Encoder:
    """Encodes texts and remembers words."""

    def __init__(self, path: str, pattern: str) -> None:
        self.words, self.vocabulary, self.known = word_pattern(pattern), vocabulary(path), {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [[self.words.findall(s) for s in stretches(t)] if len(t) <= STRETCH else None for t in texts]
        self._learn([words for listed in parts if listed for words in listed])
        return [self._long(t) if listed is None else self._ids(listed) for t, listed in zip(texts, parts)]

    def _learn(self, lists: list[list[str]]) -> None:
        wanted = set().union(*lists)
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, wanted
        self.known.update(self.vocabulary.encode_words(new))

    def _ids(self, lists: list[list[str]]) -> np.ndarray:
        return np.frombuffer(b"".join(b"".join(map(self.known.__getitem__, words)) for words in lists), dtype=np.int32)

    def _long(self, text: str) -> np.ndarray:
        parts = []
        for stretch in stretches(text):
            words = self.words.findall(stretch)
            missing = set(words) - self.known.keys()
            own = self.known | self.vocabulary.encode_words(missing) if missing else self.known
            parts.append(np.frombuffer(b"".join(map(own.__getitem__, words)), dtype=np.int32))
        return np.concatenate(parts)


def encode(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """doc_id, ids (array<int>). path: of the ranks, readable on every executor."""
    public = public_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or public[0], pattern or public[1]
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = encoder.encode(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), listed], names=["doc_id", "ids"])

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The frame with a column ``decoded``, the bytes of its ids."""
    path = path or public_vocabulary()[0]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path)
        for batch in batches:
            column = batch.column(ids)
            found = []
            for i in range(len(column)):
                own = column[i].values if column[i].is_valid else None
                found.append(b"" if own is None else tokens.decode(own.to_numpy(zero_copy_only=False)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded binary")
