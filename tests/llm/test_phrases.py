"""Phrase mining against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandjoin.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, key string"


def brute(rows, least, longest=5, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and " " in p}
        inner = set()
        for p, a in found.items():
            w = p.split(" ")
            parts = {" ".join(w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1)}
            inner |= {q for q in parts if 100 * a >= 100 * f[q]}
        ranked = []
        for p, a in found.items():
            if p not in inner:
                w = p.split(" ")
                cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
                score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
                ranked.append((-score, -a, p.encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "A", "über", "x\x00y", "\x1f", "ß"]
    lines = [" ".join(draw.choices(words, k=6)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [draw.choice(lines) if draw.random() < 0.4 else " ".join(draw.choices(words, k=draw.randint(0, 9))) for _ in range(8)]
        texts.append(draw.choice([". ", "\n", " ", "\t", "\r\n", ",  "]).join(parts))
    rows = [(t, draw.choice(["en", "de", None, "und", ""])) for t in texts]
    return rows + [(None, "en"), ("", None), (" .,\n", "fr"), ("a a a a a a a " * 3000, "en"), ("w1 w2 " * 50 + "w1", "de")] * 2


def table(spark, rows):
    return spark.createDataFrame([(1, t, lang, 1, "p", "k") for t, lang in rows], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"trie_phrases": 40}, {"filter_bits": 6}, {"top": 5}, {"longest": 3}])
def test_phrases_equal_plain_counts(spark, options):
    rows = corpus(11, 150)
    found = phrases.mine_phrases(table(spark, rows).repartition(3), min_count=8, **options).collect()
    expected = brute(rows, 8, options.get("longest", 5), options.get("top", 2000))
    assert len(expected) >= 15 and sorted(map(tuple, found)) == expected


def test_trie_counts_every_phrase(spark):
    draw = random.Random(2)
    words = [f"v{i}" for i in range(400)]
    listed = sorted({("en", " ".join(draw.choices(words, k=draw.randint(2, 5))).encode()) for _ in range(3000)})
    trie = phrases.Trie(listed)
    text = " ".join(p.decode() for _, p in listed) + " . " + " ".join(draw.choices(words, k=5000))
    part = phrases.Slice.of(pa.record_batch({"lang": ["en", "fr"], "text": [text, text]}))
    tokens = re.findall("[^ \t]+|\n", text.replace(".", "\n"))
    seen = Counter(" ".join(tokens[i : i + k]) for k in range(2, 6) for i in range(len(tokens) - k + 1))
    assert np.array_equal(trie.counts(part, 5), [seen[p.decode()] for _, p in listed])


def test_products_beyond_64_bits(spark):
    big = 3 * 10**10
    counts = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, n long")
    words = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 7)], "lang string, word string, n long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    (row,) = phrases.score_phrases(counts, words, totals).collect()
    assert row["score"] == 1000 * big * 10**13 // ((big + 1) * (big + 7))


def test_empty_corpus(spark):
    assert phrases.mine_phrases(table(spark, [])).collect() == []
    assert phrases.mine_phrases(table(spark, [(None, None), ("one two", "en")])).collect() == []
