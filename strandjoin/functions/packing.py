"""Bases in integer columns: three bits a base, 21 bases a BIGINT.

A base is one octal digit, so packing is ``conv(digits, 8, 10)`` and comparing two packed
words costs a handful of integer instructions inside generated code. N has a code of its own
(it equals another N and differs from every base) and so has padding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import BASES_PER_WORD

# Letter -> octal digit. N and padding are the digits with the high bit set.
BASE_LETTERS = "ACGTN"
BASE_DIGITS = "01234"
COMPLEMENT_DIGITS = "32104"
N_DIGIT = "4"
PAD_DIGIT = "7"

WORD_MASK = (1 << 3 * BASES_PER_WORD) - 1
PAD_WORD = int(PAD_DIGIT * BASES_PER_WORD, 8)
LOW_BITS = int("1" * BASES_PER_WORD, 8)
MIDDLE_BITS = LOW_BITS << 1
HIGH_BITS = LOW_BITS << 2


def to_digits(seq: Column) -> Column:
    """Upper-case A/C/G/T/N letters as octal digits."""
    return F.translate(seq, BASE_LETTERS, BASE_DIGITS)


def from_digits(digits: Column) -> Column:
    return F.translate(digits, BASE_DIGITS, BASE_LETTERS)


def complement_digits(digits: Column) -> Column:
    return F.translate(digits, BASE_DIGITS, COMPLEMENT_DIGITS)


def pack_digits(digits: Column) -> Column:
    """At most 21 octal digits as one BIGINT, left-aligned, padded on the right."""
    full = F.rpad(digits, BASES_PER_WORD, PAD_DIGIT)
    return F.conv(full, 8, 10).cast("bigint")


def pack_frame(digits: Column, n_words: int) -> list[Column]:
    """A digit string as a fixed number of words."""
    return [
        pack_digits(F.substring(digits, 1 + BASES_PER_WORD * i, BASES_PER_WORD))
        for i in range(n_words)
    ]


def pack_array(digits: Column) -> Column:
    """A digit string of any length as an array of words (empty for an empty string)."""
    # One linear pass; a substring per word would walk the string from its start each time.
    cut = F.regexp_extract_all(digits, F.lit(f".{{1,{BASES_PER_WORD}}}"), F.lit(0))
    return F.transform(cut, pack_digits)


def unpack_seed(seed: Column, length: int) -> Column:
    """The letters of a packed seed."""
    return from_digits(F.lpad(F.conv(seed, 10, 8), length, "0"))


def unpack_frame(words: Sequence[Column]) -> Column:
    """The digits of all words as one string, padding included."""
    return F.concat(*[F.lpad(F.conv(w, 10, 8), BASES_PER_WORD, "0") for w in words])


def _shift_left(word: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", word, bits if isinstance(bits, Column) else F.lit(bits))


def _shift_right(word: Column, bits: Column | int) -> Column:
    return F.call_function(
        "shiftrightunsigned", word, bits if isinstance(bits, Column) else F.lit(bits)
    )


def shift_words(words: Sequence[Column], bases: Column) -> list[Column]:
    """Words moved left by 0..20 bases; needs one word more than it returns."""
    bits = bases * 3
    return [
        _shift_left(words[i], bits).bitwiseAND(F.lit(WORD_MASK)).bitwiseOR(
            _shift_right(words[i + 1], F.lit(3 * BASES_PER_WORD) - bits)
        )
        for i in range(len(words) - 1)
    ]


def slice_value(words: Sequence[Column], start: int, length: int) -> Column:
    """Bases [start, start + length) as one right-aligned number; at most two words are touched."""
    first, offset = divmod(start, BASES_PER_WORD)
    tail = BASES_PER_WORD - offset - length
    if tail >= 0:
        moved = _shift_right(words[first], 3 * tail)
    else:
        moved = _shift_left(words[first], -3 * tail).bitwiseOR(
            _shift_right(words[first + 1], 3 * (BASES_PER_WORD + tail))
        )
    return moved.bitwiseAND(F.lit((1 << 3 * length) - 1))


def fold_words(words: Sequence[Column]) -> list[Column]:
    """As many words in fewer bits, for storing: of each three the middle one becomes zero where
    no digit is N or padding, the only ones with a high bit.

    Its low and middle bits move to the high bits of its neighbours, and the high bits of all three
    take its place. Words that are left over at the end stay as they are.
    """
    folded = []
    for i in range(0, len(words) - 2, 3):
        a, b, c = words[i : i + 3]
        plain_a, plain_c = (w.bitwiseAND(F.lit(WORD_MASK ^ HIGH_BITS)) for w in (a, c))
        highs = _shift_right(a.bitwiseAND(F.lit(HIGH_BITS)), 2).bitwiseOR(
            _shift_right(b.bitwiseAND(F.lit(HIGH_BITS)), 1)
        )
        folded += [
            plain_a.bitwiseOR(_shift_left(b.bitwiseAND(F.lit(LOW_BITS)), 2)),
            highs.bitwiseOR(c.bitwiseAND(F.lit(HIGH_BITS))),
            plain_c.bitwiseOR(_shift_left(b.bitwiseAND(F.lit(MIDDLE_BITS)), 1)),
        ]
    return folded + list(words[len(folded) :])


def unfold_words(folded: Sequence[Column]) -> list[Column]:
    """The words that :func:`fold_words` was given."""
    words = []
    for i in range(0, len(folded) - 2, 3):
        a, highs, c = folded[i : i + 3]
        plain_a, plain_c = (w.bitwiseAND(F.lit(WORD_MASK ^ HIGH_BITS)) for w in (a, c))
        plain_b = _shift_right(a.bitwiseAND(F.lit(HIGH_BITS)), 2).bitwiseOR(
            _shift_right(c.bitwiseAND(F.lit(HIGH_BITS)), 1)
        )
        words += [
            plain_a.bitwiseOR(_shift_left(highs.bitwiseAND(F.lit(LOW_BITS)), 2)),
            plain_b.bitwiseOR(_shift_left(highs.bitwiseAND(F.lit(MIDDLE_BITS)), 1)),
            plain_c.bitwiseOR(highs.bitwiseAND(F.lit(HIGH_BITS))),
        ]
    return words + list(folded[len(words) :])


def base_masks(positions: Sequence[int], n_words: int, digit: int = 7) -> list[int]:
    """One constant per word with ``digit`` at each of the given base positions."""
    masks = [0] * n_words
    for p in positions:
        word, offset = divmod(p, BASES_PER_WORD)
        masks[word] |= digit << 3 * (BASES_PER_WORD - 1 - offset)
    return masks


def mismatch_bits(a: Column, b: Column) -> Column:
    """One low bit for each base position where two words differ."""
    x = a.bitwiseXOR(b)
    return x.bitwiseOR(_shift_right(x, 1)).bitwiseOR(_shift_right(x, 2)).bitwiseAND(F.lit(LOW_BITS))


def pad_bits(word: Column) -> Column:
    """One low bit for each padded base position."""
    return (
        word.bitwiseAND(_shift_right(word, 1))
        .bitwiseAND(_shift_right(word, 2))
        .bitwiseAND(F.lit(LOW_BITS))
    )


def test_bit_at(words: Sequence[Column], position: Column) -> Column:
    """Whether the low bit of the base at a computed position is set."""
    word = F.get(F.array(*words), F.floor(position / BASES_PER_WORD).cast("int"))
    shift = (F.lit(BASES_PER_WORD - 1) - F.pmod(position, F.lit(BASES_PER_WORD))) * 3
    return _shift_right(word, shift).bitwiseAND(F.lit(1)) == 1
