"""Differences between two strings of bases, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import packing as P


def _count_mismatches(a: Column, b: Column) -> Column:
    """Mismatches of two equally long strings; bases compare 21 at a time, others by letter."""
    bases = a.rlike("^[ACGTN]*$") & b.rlike("^[ACGTN]*$")
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    by_letter = F.aggregate(letters, F.lit(0), lambda total, n: total + n)
    return F.when(bases, _count_base_mismatches(a, b)).otherwise(by_letter)


def _count_base_mismatches(a: Column, b: Column) -> Column:
    words = F.zip_with(
        P.pack_array(P.to_digits(a)),
        P.pack_array(P.to_digits(b)),
        lambda x, y: F.bit_count(P.mismatch_bits(x, y)),
    )
    return F.aggregate(words, F.lit(0), lambda total, n: total + n)


def k_mismatch(
    text: Column, pattern: Column, k: Column | int, require_full: bool = True
) -> Column:
    """struct(aligned_len, differences) of laying ``pattern`` at the start of ``text``.

    NULL beyond k mismatches. With ``require_full`` also where the pattern does not fit;
    otherwise only the overlap is compared.
    """
    shared = F.least(F.length(text), F.length(pattern))
    differences = _count_mismatches(
        F.substr(text, F.lit(1), shared), F.substr(pattern, F.lit(1), shared)
    )
    fits = F.length(pattern) <= F.length(text) if require_full else F.lit(True)
    result = F.struct(shared.alias("aligned_len"), differences.alias("differences"))
    return F.when(fits & (differences <= k), result)


def k_difference(text: Column, pattern: Column, k: int) -> Column:
    """struct(differences, aligned_len): the prefix of ``text`` closest to ``pattern``.

    Least edit distance first, then the shortest prefix; NULL if no prefix is within k edits.
    """
    length = F.length(pattern)
    shortest = F.greatest(length - k, F.lit(0))
    longest = F.least(length + k, F.length(text))
    tried = F.transform(
        F.sequence(shortest, longest),
        lambda j: F.struct(
            F.levenshtein(pattern, F.substr(text, F.lit(1), j), k).alias("differences"),
            j.alias("aligned_len"),
        ),
    )
    # A prefix within k edits is at most k bases longer or shorter than the pattern, so that the
    # prefix of the pattern's length is within 2k: one distance in place of 2k + 1 for most rows.
    near = F.levenshtein(pattern, F.substr(text, F.lit(1), length), 2 * k) >= 0
    return F.when(
        (shortest <= longest) & near, F.array_min(F.filter(tried, lambda t: t["differences"] >= 0))
    )


def _shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two strings."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(pairs, False)
    shorter = F.least(F.length(a), F.length(b))
    return F.when(at > 0, F.least(at - 1, shorter)).otherwise(shorter).cast("int")


def trace_edits(ref_text: Column, read_text: Column, k: int) -> Column:
    """array<struct<pos, op>>: one least set of edits that leads from ref_text to read_text.

    NULL where more than k are needed. op is mismatch, reference_base (one without a read base) or
    read_base (one without a reference base); pos counts read bases. Shared bases are passed over,
    then the first operation is taken, in that order, after which the rest needs one edit less.
    """
    text = lambda s, n: F.substr(s, n + 1)

    def step(state: Column, _: Column) -> Column:
        same = _shared_prefix(state["ref"], state["read"])
        ref, read, left = text(state["ref"], same), text(state["read"], same), state["left"]
        place = state["place"] + same

        def after(op: str, ref_bases: int, read_bases: int) -> Column:
            rest, wanted = F.substr(ref, F.lit(ref_bases + 1)), F.substr(read, F.lit(read_bases + 1))
            fits = (F.length(ref) >= ref_bases) & (F.length(read) >= read_bases)
            good = fits & (F.levenshtein(rest, wanted) == left - 1)
            edit = F.struct(place.cast("int").alias("pos"), F.lit(op).alias("op"))
            return F.when(
                good,
                F.struct(
                    rest.alias("ref"),
                    wanted.alias("read"),
                    (place + read_bases).cast("int").alias("place"),
                    (left - 1).alias("left"),
                    F.concat(state["edits"], F.array(edit)).alias("edits"),
                ),
            )

        taken = F.coalesce(after("mismatch", 1, 1), after("reference_base", 1, 0), after("read_base", 0, 1))
        return F.when(left > 0, taken).otherwise(state)

    distance = F.levenshtein(ref_text, read_text)
    start = F.struct(
        ref_text.alias("ref"),
        read_text.alias("read"),
        F.lit(0).alias("place"),
        distance.alias("left"),
        F.array().cast("array<struct<pos:int,op:string>>").alias("edits"),
    )
    traced = F.aggregate(F.sequence(F.lit(1), F.lit(max(k, 1))), start, step, lambda state: state["edits"])
    return F.when(distance <= k, traced)


# The code of each operation, and of the end of the read.
EDIT_CODES = {"mismatch": 0, "reference_base": -1, "read_base": 1}
END_CODE = 2


def edit_arrays(edits: Column, length: Column) -> Column:
    """struct(dist, what): the bases up to each next edit, the last entry up to the end of the read,
    and the code of each edit, ending with that of the end.

    A read base that an edit names is not counted in the distance that follows it.
    """
    consumed = lambda e: F.when(e["op"] == "reference_base", 0).otherwise(1)
    resumes = F.concat(F.array(F.lit(0)), F.transform(edits, lambda e: e["pos"] + consumed(e)))
    stops = F.concat(F.transform(edits, lambda e: e["pos"]), F.array(length))
    code = lambda e: F.coalesce(*[F.when(e["op"] == op, F.lit(c)) for op, c in EDIT_CODES.items()])
    return F.struct(
        F.zip_with(resumes, stops, lambda a, b: b - a).alias("dist"),
        F.concat(F.transform(edits, code), F.array(F.lit(END_CODE))).alias("what"),
    )


def edit_runs(positions: Column, length: Column) -> Column:
    """Distance to each next mismatch, the last entry reaching the end of the read."""
    before = F.concat(F.array(F.lit(0)), positions)
    after = F.concat(positions, F.array(length))
    return F.zip_with(before, after, lambda a, b: b - a)


def replay_edits(ref_text: Column, read_text: Column, edits: Column) -> Column:
    """The read as its edits make it: edited bases are the read's, all others the reference's."""

    def shift(p: Column) -> Column:
        more = F.filter(edits, lambda e: (e["op"] == "reference_base") & (e["pos"] <= p))
        less = F.filter(edits, lambda e: (e["op"] == "read_base") & (e["pos"] < p))
        return F.size(more) - F.size(less)

    def base(p: Column) -> Column:
        edited = F.exists(edits, lambda e: (e["op"] != "reference_base") & (e["pos"] == p))
        one = F.lit(1)
        return F.when(edited, F.substr(read_text, p + 1, one)).otherwise(
            F.substr(ref_text, p + shift(p) + 1, one)
        )

    places = F.sequence(F.lit(0), F.length(read_text) - 1)
    return F.array_join(F.transform(places, base), "")
