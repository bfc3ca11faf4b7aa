"""Places of regular-expression matches, with DataFrame functions only.

Splitting a text at the matches gives what lies between them; lengths of pieces and matches
summed up are the places, in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose lengths are summed directly; longer lists go by blocks of this many.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it, by blocks: not the square of their count."""

    def by_block(blocks: Column) -> Column:
        return let(
            F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b))),
            lambda begin: F.transform(
                numbers,
                lambda _, i: F.get(begin, F.floor(i / BLOCK).cast("int"))
                + total(F.slice(numbers, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK)),
            ),
        )

    n_blocks = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks),
        lambda b: total(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))),
    )
    return let(blocks, by_block)


def find(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value, before).

    before: the text between the match and the one before it. gate: a cheaper test that any
    text with a match passes. The pattern must not match the empty text.
    """

    def places(found: Column, pieces: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("long"))

        def rows(steps: Column, before: Column) -> Column:
            return F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(before, i) + F.get(steps, i) - F.length(m)).alias("start"),
                    (F.get(before, i) + F.get(steps, i)).alias("end"),
                    m.alias("value"),
                    F.get(pieces, i).alias("before"),
                ),
            )

        return let(steps, lambda steps: let(sums_before(steps), lambda before: rows(steps, before)))

    matches = let(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda found: let(F.split(text, pattern, -1), lambda pieces: places(found, pieces)),
    )
    test = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    return F.when(test, matches).otherwise(empty)


def kind_spans(kind: int, found: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """The matches that pass keep(value), as (kind, start, end)."""
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["value"]))
    return F.transform(
        found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    )


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of spans of (kind, start, end) in the order given, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
