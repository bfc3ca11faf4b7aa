"""Byte-level BPE against the library whose ranks it uses."""

from __future__ import annotations

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandjoin.llm import byte_bpe

TEXTS = ["", " ", "a", "It's  fine, isn't it?", "x" * 300, "=" * 777 + "\n\n ", "éè über ß 北京市 🙂🙂 é", " \t \x1c\x85 a", "12345 67,8", "a\x00b"]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def generated(n):
    draw = random.Random(5)
    kinds = ["abcdefgh", "ab", "éüñ ", " \n\t", "0123.,'", "北京🙂", "the and of "]
    return ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(1, 400))) for _ in range(n)]


def test_ids_equal_the_library(spark, library, monkeypatch):
    texts = TEXTS + generated(150)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, None, 1, "x"), (0, "", 1, "x")], "doc_id long, text string, ids long, decoded string")
    found = byte_bpe.decode(byte_bpe.encode(frame)).collect()
    assert len(found) == len(texts) + 2
    for row in found:
        text = texts[row["doc_id"]] if row["doc_id"] is not None else ""
        assert row["ids"] == library.encode_ordinary(text) and bytes(row["decoded"]) == text.encode()


def test_trees_of_any_size_and_a_small_cache_agree(library, monkeypatch):
    path, pattern = byte_bpe.public_vocabulary()
    texts = TEXTS + generated(40)
    expected = [library.encode_ordinary(t) for t in texts]
    for together, cache, stretch in ((2, 10, 1 << 20), (1024, 400_000, 1 << 20), (16, 10, 50)):
        monkeypatch.setattr(byte_bpe, "TOGETHER", together)
        monkeypatch.setattr(byte_bpe, "CACHE_WORDS", cache)
        monkeypatch.setattr(byte_bpe, "STRETCH", stretch)
        encoder = byte_bpe.Encoder(path, pattern)
        assert [encoder.encode([t])[0].tolist() for t in texts] == expected


def test_one_long_word(library):
    path, pattern = byte_bpe.public_vocabulary()
    draw = random.Random(1)
    word = "".join(draw.choice("abcde") for _ in range(60_000))
    assert byte_bpe.Encoder(path, pattern).encode([word])[0].tolist() == library.encode_ordinary(word)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(empty)).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(nulls).collect()] == [b"", b""]
    with pytest.raises(Exception, match="no token has the id"):
        byte_bpe.decode(spark.range(1).select(F.array(F.lit(60_000)).alias("ids"))).collect()
