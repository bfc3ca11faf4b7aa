"""Secret scan: known forms, and strings whose windows have a high Shannon entropy.

Base forms are assignments to password-like names, access keys and long hexadecimal runs. The
method then takes every long run of key characters, without the parts that base spans cover,
slides a window over it, keeps the counts of the characters in the window by adding the one that
enters and taking off the one that leaves, and flags the run if the entropy of any window
reaches the limit of the run's character class. Every run has a class. Digits alone never reach
its limit. Runs that fit the allow-list are not flagged; its plain words are lower or upper
case, or capitalized.

DataFrame functions only. Defined results: null text is empty; repeated rows and ids give a
row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.spans import find, kind_spans, let

KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = 3

#: The forms that the contract of the query states. Possessive where the next
#: character cannot be one of those repeated.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LETTERS = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Character classes in order: what a run of the class fits, and its entropy limit in bits.
CLASSES = (
    ("hex", r"^(?=[^0-9]*[0-9])(?=[^a-fA-F]*[a-fA-F])[0-9a-fA-F]+$", 3.0),
    ("alnum", r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[0-9A-Za-z]+$", 3.7),
    ("base64", r"^(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[0-9A-Za-z+/_=-]+$", 3.9),
    ("one case", r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])", 3.9),
    ("no digits", r"^", 4.0),
)
#: Runs that look random but are public: UUIDs, alphabets and digits in sequence, examples,
#: paths and names of several plain words, checksums with their method named.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)example|sample|placeholder|dummy|xxxx",
    r"^(?:(?:(?:[A-Z]?[a-z]++)*+|[A-Z]++)[/_=-])+(?:(?:[A-Z]?[a-z]++)*+|[A-Z]++)[0-9]{0,4}$",
    r"^(?:sha(?:1|256|384|512)|md5)[-=]",
)


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits, of any window of so many characters of the run."""
    c_log_c = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def scan(codes: Column, size: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best")
        )

        def step(state: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            old_out = F.coalesce(F.get(state["counts"], leaves), F.lit(0))
            old_in = F.get(state["counts"], enters) - F.when(enters == leaves, 1).otherwise(0)
            s = state["s"] - c_log_c(old_out) + c_log_c(old_out - 1) + c_log_c(old_in + 1) - c_log_c(old_in)
            counts = F.transform(
                state["counts"],
                lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
            )

            def close(s: Column) -> Column:
                entropy = math.log2(window) - s / window
                best = F.when(i >= window - 1, F.greatest(state["best"], entropy)).otherwise(state["best"])
                return F.struct(counts.alias("counts"), s.alias("s"), best.alias("best"))

            return let(s, close)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["best"])

    def coded(letters: Column) -> Column:
        return let(
            F.array_distinct(letters),
            lambda known: let(
                F.transform(letters, lambda x: (F.array_position(known, x) - 1).cast("int")),
                lambda codes: scan(codes, F.size(known)),
            ),
        )

    return let(F.split(run, ""), lambda letters: coded(F.filter(letters, lambda x: x != "")))


def is_random(run: Column) -> Column:
    limit = F.lit(None).cast("double")
    for _, form, bits in reversed(CLASSES):
        limit = F.when(run.rlike(form), F.lit(bits)).otherwise(limit)
    allowed = F.lit(False)
    for form in ALLOW:
        allowed = allowed | run.rlike(form)
    return F.when(limit.isNull() | allowed, F.lit(False)).otherwise(window_entropy(run) >= limit)


def base_spans(text: Column) -> Column:
    """(kind, start, end) of the base forms, by start, then kind."""
    long_enough = lambda value: F.length(F.regexp_extract(value, ASSIGN, 2)) >= ASSIGN_LETTERS
    found = F.concat(
        kind_spans(0, find(text, ASSIGN), long_enough),
        kind_spans(1, find(text, ACCESS, F.contains(text, F.lit("AKIA")))),
        kind_spans(2, find(text, HEX)),
    )
    return by_place(found)


def by_place(spans: Column) -> Column:
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.transform(
        placed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def entropy_spans(text: Column, base: Column) -> Column:
    """Random-looking runs; of one that base spans touch, the parts between them, judged together."""

    def parts(m: Column, touching: Column) -> Column:
        begins = F.concat(F.array(m["start"]), F.transform(touching, lambda b: b["end"]))
        free = F.filter(
            F.array_distinct(begins),
            lambda p: (p < m["end"]) & ~F.exists(touching, lambda b: (b["start"] <= p) & (p < b["end"])),
        )

        def part(p: Column) -> Column:
            later = F.filter(touching, lambda b: b["start"] > p)
            end = F.coalesce(F.array_min(F.transform(later, lambda b: b["start"])), m["end"])
            return F.struct(p.alias("start"), end.alias("end"))

        return F.transform(free, part)

    def random_parts(m: Column) -> Column:
        cut = lambda p: F.substring(m["value"], (p["start"] - m["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))
        touching = F.filter(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))

        def judged(found: Column) -> Column:
            return let(
                F.array_join(F.transform(found, cut), ""),
                lambda left: F.filter(found, lambda _: (F.length(left) >= WINDOW) & is_random(left)),
            )

        return let(touching, lambda touching: let(parts(m, touching), judged))

    return kind_spans(3, F.flatten(F.transform(find(text, CANDIDATE), random_parts)))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (kind, start, end) by start, then kind."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def scanned(text: Column) -> Column:
        return let(
            base_spans(text),
            lambda base: F.struct(base.alias("base"), by_place(F.concat(base, entropy_spans(text, base))).alias("spans")),
        )

    found = read.select("doc_id", scanned(F.col("text")).alias("found"))
    return found.select("doc_id", "found.base", "found.spans")
