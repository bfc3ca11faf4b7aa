"""Language of each word by a linear-chain conditional random field, and so of each text.

A word's features are its byte n-grams (with its borders, so that they take in affixes), its
first and last three bytes, and the word itself as a lexicon entry, hashed into one table of
weights for each language. Transition weights are learned with them, by gradient ascent on the
likelihood of label sequences. Training sequences are stretches of labelled texts, put together
from several texts, so that switches of language occur. Prediction runs forward-backward over
the whole chain of every text; the language with the most probability, summed over the words,
is the text's, and its share of the words is the score.

The model is fitted on a bounded sample of labelled rows (MAX_TRAIN_DOCS for each language, by
hash of id and text; of a text longer than MAX_TRAIN_CHARS a stretch of that length, at a place
by its hash); prediction reads whole texts.

Defined results: `und` with score 0 if the text is null or has no letter; a null id is never
held out nor learned from; with no labelled rows every text is `und`. Repeated rows get a row
each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandjoin.llm.text_bytes import BASE, is_space, mix, slices, split_words

MAX_TRAIN_DOCS = 300
MAX_TRAIN_CHARS = 8000
TABLE_BITS = 16
STRETCH = 24
UNKNOWN = "und"
SEGMENT = 64
RESCALE = 8
HELD_OUT = 1
FOLDS = 3


@dataclass
class Model:
    labels: list[str]
    emit: np.ndarray  # table entry x label
    move: np.ndarray  # label x label


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of the two-byte Latin letters; A-Z are lower case already."""
    out = data.copy()
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E)] += 0x20
    return out


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray):
    """Table entries of the words' features, which depend on nothing but the word itself.

    Returned: gram entries per byte (two kinds), borders of the words, and entries of affixes
    and lexicon per word. Around a word there are blanks, whatever stands there in the text.
    """
    data = np.where(is_space(data), np.uint8(32), fold_case(data)).astype(np.uint64)
    padded = np.concatenate([data, np.full(2, 32, dtype=np.uint64)])
    two = padded[:-2] * np.uint64(257) + padded[1:-1]
    three = two * np.uint64(257) + np.where(padded[1:-1] == 32, np.uint64(32), padded[2:])
    shift = np.uint64(64 - TABLE_BITS)
    # Grams that start inside a word; they may reach the blanks after it.
    grams = np.stack([mix(two + np.uint64(1 << 32)) >> shift, mix(three + np.uint64(2 << 32)) >> shift])
    head = np.zeros(len(word), dtype=np.uint64)
    tail = np.zeros(len(word), dtype=np.uint64)
    for k in range(3):
        head = head * np.uint64(257) + padded[np.minimum(start + k, end)]
        last = np.where(end - 1 - k >= start, padded[np.maximum(end - 1 - k, 0)], np.uint64(32))
        tail = tail * np.uint64(257) + last
    own = np.stack(
        [mix(head + np.uint64(3 << 32)) >> shift, mix(tail + np.uint64(4 << 32)) >> shift, mix(word * BASE) >> shift]
    )
    return grams.astype(np.int32), np.stack([start, end]), own.astype(np.int32)


def chains(scores: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of each label at each word, by forward-backward over each text's chain.

    The chains are cut into segments of SEGMENT words. The product of the transfer matrices of
    a segment carries messages across it, so that all segments run side by side; messages into
    the segments follow text by text. Exact: every chain is whole. Before a text's first word
    every label is equally likely, and a transition leads from there to the word.
    """
    n_words, n_labels = scores.shape
    if not n_words or not n_labels:
        return scores
    counts = np.diff(first)
    pieces = -(-counts // SEGMENT)
    total = int(pieces.sum())
    owner = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, first[owner + 1] - begin)
    # Longest segments first, so that those still running are always the leading ones.
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    running = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    m = np.exp(move - move.max())
    # Transfer matrices: row is the label before the segment, column the label at its end.
    carry = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for k, on in enumerate(running):
        step = (carry[:on].reshape(-1, n_labels) @ m).reshape(on, n_labels, n_labels)
        np.multiply(step, e[begin[:on] + k][:, None, :], out=carry[:on])
        if k % RESCALE == RESCALE - 1:
            carry[:on] /= carry[:on].sum(axis=(1, 2), keepdims=True)
    carry /= carry.sum(axis=(1, 2), keepdims=True)
    carry = carry[np.argsort(order)]
    into = np.full((total, n_labels), 1.0 / n_labels)
    back = np.full((total, n_labels), 1.0 / n_labels)
    last = np.zeros(total, dtype=bool)
    last[np.cumsum(pieces)[pieces > 0] - 1] = True
    by_place = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by_place], np.arange(int(pieces.max()) + 1))
    at_place = [by_place[a:b] for a, b in zip(cuts, cuts[1:])]
    for at in at_place[1:]:
        message = (into[at - 1][:, None, :] @ carry[at - 1])[:, 0, :]
        into[at] = message / message.sum(axis=1, keepdims=True)
    for at in at_place[-2::-1]:
        at = at[~last[at]]
        message = (carry[at + 1] @ back[at + 1][:, :, None])[:, :, 0]
        back[at] = message / message.sum(axis=1, keepdims=True)
    forward = np.empty_like(e)
    state = into[order]
    for k, on in enumerate(running):
        step = (state[:on] @ m) * e[begin[:on] + k]
        step /= step.sum(axis=1, keepdims=True)
        state[:on] = step
        forward[begin[:on] + k] = step
    out = np.empty_like(e)
    state = back[order]
    for k in range(len(running) - 1, -1, -1):
        on = running[k]
        out[begin[:on] + k] = forward[begin[:on] + k] * state[:on]
        step = (state[:on] * e[begin[:on] + k]) @ m.T
        state[:on] = step / step.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 2, rate: float = 0.3) -> Model:
    """Weights by adaptive gradient ascent on the chain likelihood of mixed stretches."""
    labels = sorted(set(langs))
    n_labels = len(labels)
    emit = np.zeros((1 << TABLE_BITS, n_labels), dtype=np.float32)
    move = np.zeros((n_labels, n_labels))
    if n_labels < 2:
        return Model(labels, emit, move)
    found = split_words(pa.array(texts, pa.string()))
    first = found.first
    grams, borders, own = word_features(found.bytes, found.start, found.end, found.hashes())
    label = np.searchsorted(labels, langs)
    word_label = np.repeat(label, np.diff(first))
    starts = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(first, first[1:])] or [[]]).astype(int)
    ends = np.minimum(starts + STRETCH, first[np.searchsorted(first, starts, side="right")])
    random = np.random.default_rng(seed)
    emit_norm, move_norm = np.full_like(emit, 1e-3), np.full_like(move, 1e-3)
    for _ in range(epochs):
        order = random.permutation(len(starts))
        for at in range(0, len(order), 256):
            chosen = order[at : at + 256]
            rows = np.concatenate([np.arange(starts[i], ends[i]) for i in chosen])
            # Chains of four stretches each.
            lengths = np.array([ends[i] - starts[i] for i in chosen])
            chain = np.concatenate([[0], np.cumsum(np.add.reduceat(lengths, np.arange(0, len(lengths), 4)))])
            entry, owner = _entries(grams, borders, own, rows)
            scores = np.zeros((len(rows), n_labels))
            weight = 1.0 / np.bincount(owner, minlength=len(rows))[owner] * 4
            np.add.at(scores, owner, emit[entry] * weight[:, None])
            share = chains(scores, move, chain)
            truth = np.eye(n_labels)[word_label[rows]]
            miss = truth - share
            step = np.zeros_like(emit)
            np.add.at(step, entry, miss[owner] * weight[:, None])
            inner = np.setdiff1d(np.arange(1, len(rows)), chain)
            gradient = truth[inner - 1].T @ truth[inner] - share[inner - 1].T @ share[inner]
            emit_norm += step**2
            emit += rate * step / np.sqrt(emit_norm) * (step != 0)
            gradient /= len(inner) or 1
            move_norm += gradient**2
            move += 0.1 * gradient / np.sqrt(move_norm)
    return Model(labels, emit, move)


def _entries(grams, borders, own, rows) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of the features of the words in rows, and the place of each one's word."""
    start, end = borders[0][rows], borders[1][rows]
    length = end - start
    owner = np.repeat(np.arange(len(rows)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
    entry = np.concatenate([grams[0][at], grams[1][at], own[0][rows], own[1][rows], own[2][rows]])
    return entry, np.concatenate([owner, owner, *[np.arange(len(rows))] * 3])


def word_emissions(model: Model, grams, borders, own) -> np.ndarray:
    """As in training: the mean weight over all features of a word, times four."""
    start, end = borders
    n = (2 * (end - start) + 3)[:, None]
    weights = model.emit
    sums = np.zeros((grams.shape[1] + 1, weights.shape[1]))
    np.cumsum(weights[grams[0]] + weights[grams[1]], axis=0, out=sums[1:], dtype=np.float64)
    inside = sums[end] - sums[start]
    return (inside + weights[own[0]] + weights[own[1]] + weights[own[2]]) * 4 / n


def label_words(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each language for each word, and the words before each text.

    A word's features are its own, so they are weighed once for all its occurrences.
    """
    found = split_words(texts)
    word, at, back = np.unique(found.hashes(), return_index=True, return_inverse=True)
    start, end = found.start[at], found.end[at]
    size = end - start + 1  # with the blank after it
    stop = np.cumsum(size)
    data = found.bytes[np.arange(size.sum()) + np.repeat(start - stop + size, size)]
    once = word_emissions(model, *word_features(data, stop - size, stop - 1, word))
    return chains(once[back], model.move, found.first), found.first


def label_texts(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language of each text and its share of the words' probability."""
    share, first = label_words(model, texts)
    sums = np.zeros((share.shape[0] + 1, share.shape[1]))
    np.cumsum(share, axis=0, out=sums[1:])
    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))[:, None]
    langs, scores = [], []
    for i, value in enumerate(texts):
        known = len(model.labels) > 0 and has_letter(value.as_py()) and first[i + 1] > first[i]
        best = int(mean[i].argmax()) if known else -1
        langs.append(model.labels[best] if known else UNKNOWN)
        scores.append(float(min(1.0, mean[i][best])) if known else 0.0)
    return langs, scores


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                langs, scores = label_texts(model, part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return read.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def stretch(text: F.Column, place: F.Column) -> F.Column:
    """A text up to MAX_TRAIN_CHARS; of a longer one whole words of a stretch, at a place by hash."""
    begin = (F.pmod(place, F.length(text) - MAX_TRAIN_CHARS + 1) + 1).cast("int")
    piece = F.substring(text, begin, F.lit(MAX_TRAIN_CHARS))
    words = F.regexp_replace(piece, r"^\S*\s+|\s+\S*$", "")
    return F.when(F.length(text) <= MAX_TRAIN_CHARS, text).when(F.length(words) > 0, words).otherwise(piece)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_TRAIN_DOCS) -> Model:
    """Fit on at most so many different rows of each language outside the held-out fold."""
    usable = docs.where((fold(doc_id) != HELD_OUT) & F.col(lang).isNotNull() & (F.length(text) > 0))
    # Rows pass by hash, about twice as many as wanted; the first by hash are taken, copies once.
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30))
    counts = {r[0]: r[1] for r in usable.groupBy(F.col(lang)).agg(F.approx_count_distinct(place)).collect()}
    limit = F.lit(0)
    for name, n in counts.items():
        limit = F.when(F.col(lang) == name, F.lit(int(min(1.0, (2 * most + 20) / max(1, n)) * (1 << 30)))).otherwise(limit)
    passed = usable.where(place < limit).select(stretch(F.col(text), place).alias("text"), F.col(lang).alias("lang"), place.alias("place"))
    passed = passed.dropDuplicates(["lang", "place"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    rows = passed.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("lang", "nth").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    found = predict(docs, train(docs, doc_id, text, lang), doc_id, text)
    held_out = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose language is found, with all their columns.

    A text is rejected if its language is `und`: it is null or has no letter. Where no label is
    learned the texts with a letter stay.
    """
    model = train(docs, doc_id, text, lang)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names.index(text)):
                texts = part.column(names.index(text))
                if model.labels:
                    kept = [found != UNKNOWN for found in label_texts(model, texts)[0]]
                else:
                    kept = [has_letter(value.as_py()) for value in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
