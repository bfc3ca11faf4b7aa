"""Personal data: seed forms, and contexts learned from them by bootstrapping.

Seeds are emails, IP addresses, payment cards and phone numbers by form, with their whole text, or
its digits. Candidates are runs of number tokens and tokens with a digit. The two plain words
before one are its context. Contexts that stand before at least
`min_values` different tokens are scored over the whole corpus:

    confidence = occurrences before known identifiers / all occurrences of the two words

An unseen token is scored by its contexts, 1 - product of (1 - confidence), and counts as known
in the next round if it passes. After the last round the contexts of high confidence mark the
tokens they stand before; those spans join the base spans, with the kind of most of the
context's seeds. The graph holds one edge for each context and token, counted before any
shuffle, so a token in a third of the rows is one row of each task.

The words before a token are some of all occurrences of the two words, so counting only those
gives a confidence that is never too low. The rounds first run with it, on the graph alone; a
context that does not pass there cannot pass, and only the others are counted over the corpus.

DataFrame functions only. Defined results: null text is empty; repeated rows and ids give a row
each; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.common import stage
from strandjoin.llm.spans import find, kind_spans, let, total

KINDS = ("email", "ip", "card", "phone")

#: The forms that the contract of the query states. `(?:\G|(?<!...))` starts a
#: match only where a run of the first characters starts, or where the last match ended.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})\.){3}0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: A run of number tokens, or a token with a digit, and the two whole words before the token it
#: starts in; words that fill more characters than the tail are no context.
NUMBER = r"[+(]*+[0-9][0-9().,/+-]*+"
TOKEN = rf"(?<!\S){NUMBER}(?:\s++{NUMBER}(?!\S))++|[^\s]*[0-9][^\s]*"
NUMBER_ONLY = r"^[0-9().,/+\s-]+$"
CONTEXT_TAIL = 96
CONTEXT = r"\s([^\s0-9]+)\s+([^\s0-9]+)\s+[^\s]*$"

MIN_VALUES = 3
CONFIDENCE = 0.6
ROUNDS = 3
#: Bits of the map of wanted contexts that goes with the scan, seven in a byte.
WANTED_BITS = 7 << 16


def passes_luhn(digits: Column) -> Column:
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(
        values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2).cast("long")
    )
    return total(doubled) % 10 == 0


def is_card(value: Column) -> Column:
    return let(
        F.regexp_replace(value, "[^0-9]", ""),
        lambda d: F.length(d).between(16, 19) & F.when(F.length(d) <= 19, passes_luhn(d)).otherwise(False),
    )


def is_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)


def base_spans(text: Column) -> Column:
    """(kind, start, end) of the seed forms, by kind, then start."""
    return F.concat(
        kind_spans(0, find(text, EMAIL, F.contains(text, F.lit("@")))),
        kind_spans(1, find(text, IP), lambda v: v.rlike(IP_PARTS)),
        kind_spans(2, F.filter(find(text, CARD, text.rlike("[0-9](?:[\x20-]?[0-9]){15}")), lambda m: is_card(m["value"]))),
        kind_spans(3, find(text, PHONE, F.contains(text, F.lit("+"))), is_phone),
    )


def context_key(first: Column, second: Column) -> Column:
    return F.xxhash64(F.lower(first), F.lower(second))


def mentions(text: Column, base: Column) -> Column:
    """Identifiers and candidates after two plain words: (start, end, value, context, kind).

    An identifier is a whole base span; of spans that overlap, the first. A candidate is a run of
    number tokens or a token with a digit that no base span touches; its kind is null.
    """
    number = lambda value: F.regexp_replace(value, "[^0-9]", "")

    def row(start: Column, end: Column, value: Column, kind: Column) -> Column:
        first = F.greatest(F.lit(0), start - CONTEXT_TAIL)
        before = F.substring(text, (first + 1).cast("int"), (start - first).cast("int"))
        tail = F.when(first > 0, before).otherwise(F.substring(F.concat(F.lit(" "), before), -CONTEXT_TAIL, CONTEXT_TAIL))
        return let(
            tail,
            lambda tail: F.struct(
                start.alias("start"),
                end.alias("end"),
                value.alias("value"),
                F.when(
                    tail.rlike(CONTEXT),
                    context_key(F.regexp_extract(tail, CONTEXT, 1), F.regexp_extract(tail, CONTEXT, 2)),
                ).alias("context"),
                kind.alias("kind"),
            ),
        )

    def identifier(b: Column) -> Column:
        value = F.substring(text, (b["start"] + 1).cast("int"), (b["end"] - b["start"]).cast("int"))
        return row(b["start"], b["end"], F.when(b["kind"] >= 2, number(value)).otherwise(F.lower(value)), b["kind"])

    def candidate(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["value"], r"^[\"'(\[{<]*", 0))
        trail = F.length(F.regexp_extract(m["value"], r"[.,;:!?\"')\]}>]*$", 0))
        start, end = m["start"] + lead, m["end"] - trail
        value = F.substring(m["value"], lead + 1, (end - start).cast("int"))
        digits = number(value)
        value = F.when(F.length(digits) >= 8, F.when(value.rlike(NUMBER_ONLY), digits)).otherwise(F.lower(value))
        return row(start, end, F.coalesce(value, F.lower(m["value"])), F.lit(None).cast("int"))

    first = F.filter(
        base,
        lambda b: ~F.exists(
            base,
            lambda o: (o["start"] < b["end"])
            & (o["end"] > b["start"])
            & ((o["start"] < b["start"]) | ((o["start"] == b["start"]) & (o["kind"] < b["kind"]))),
        ),
    )
    free = F.filter(
        find(text, TOKEN, text.rlike("[0-9]")),
        lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])),
    )
    rows = F.concat(F.transform(first, identifier), F.transform(free, candidate))
    return F.filter(rows, lambda m: m["context"].isNotNull() & (m["end"] > m["start"]))


def pair_keys(text: Column) -> Column:
    """The key of every two neighbouring words of a text."""
    return let(
        F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""),
        lambda words: F.when(
            F.size(words) > 1,
            F.transform(
                F.slice(words, F.lit(1), F.size(words) - 1), lambda w, i: F.xxhash64(w, F.get(words, i + 1))
            ),
        ),
    )


def wanted_map(contexts: DataFrame, bits: int = WANTED_BITS) -> bytes:
    """A bit for each hash of a context, seven in a byte; at most bits / 7 rows come to the driver."""
    slot = F.pmod(F.col("context"), F.lit(bits))
    set_bits = contexts.select(
        F.floor(slot / 7).cast("int").alias("at"),
        F.call_function("shiftleft", F.lit(1), (slot % 7).cast("int")).alias("bit"),
    )
    found = bytearray(bits // 7)
    for row in set_bits.groupBy("at").agg(F.bit_or("bit").alias("byte")).toLocalIterator():
        found[row["at"]] = row["byte"]
    return bytes(found)


def may_be_wanted(context: Column, wanted: bytes) -> Column:
    """Whether the map has the bit of a context: true for each wanted one, and for few others."""
    slot = F.pmod(context, F.lit(len(wanted) * 7))
    at = F.floor(slot / 7).cast("int")
    # Seven bits are an ASCII character, so a byte is read as the code of one.
    byte = F.ascii(F.substr(F.lit(wanted), at + 1, F.lit(1)).cast("string"))
    return F.call_function("shiftright", byte, (slot % 7).cast("int")).bitwiseAND(F.lit(1)) == 1


def count_contexts(docs: DataFrame, text: str, contexts: DataFrame) -> DataFrame:
    """context, total: occurrences of the two words anywhere in the corpus.

    Pairs are counted before they are joined. A map of fixed size leaves nearly only wanted pairs
    their name; all others are counted as one, under null, and go no further than that.
    """
    wanted = wanted_map(contexts)
    pairs = docs.select(F.explode_outer(pair_keys(F.col(text))).alias("context"))
    named = F.when(may_be_wanted(F.col("context"), wanted), F.col("context")).alias("context")
    counted = pairs.select(named).groupBy("context").agg(F.count(F.lit(1)).alias("total"))
    return counted.join(contexts, "context")


def score_contexts(edges: DataFrame, known: DataFrame, totals: DataFrame, confidence: float, min_values: int) -> DataFrame:
    """The contexts that pass: context, kind, confidence. known: value, kind."""
    positive = edges.join(known, "value").groupBy("context", "kind").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values")
    )
    summed = positive.groupBy("context").agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.max(F.struct("n", "kind")).alias("most")
    )
    scored = summed.where(F.col("n_values") >= min_values).join(totals, "context")
    scored = scored.select("context", F.col("most.kind").alias("kind"), F.least(F.lit(1.0), F.col("n") / F.col("total")).alias("confidence"))
    return scored.where(F.col("confidence") >= confidence)


def bootstrap(edges: DataFrame, totals: DataFrame, rounds: int, confidence: float, min_values: int, name: str) -> DataFrame:
    """The contexts that pass after so many rounds. edges: context, value, n, kind."""
    seeds = edges.where(F.col("kind").isNotNull()).groupBy("value").agg(F.min("kind").alias("kind"))
    known, passed = seeds, None
    for turn in range(rounds):
        scores = score_contexts(edges.drop("kind"), known, totals, confidence, min_values)
        passed = stage(scores, f"{name}-{turn}")
        if turn == rounds - 1 or passed.isEmpty():
            break
        unseen = edges.drop("kind").join(seeds.select("value"), "value", "left_anti")
        scored = unseen.join(passed, "context").groupBy("value").agg(
            F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))).alias("miss"),
            F.max(F.struct("confidence", "kind")).alias("best"),
        )
        good = scored.where(1 - F.exp("miss") >= confidence).select("value", F.col("best.kind").alias("kind"))
        known = seeds.unionByName(good)
    return passed


def learn_contexts(
    docs: DataFrame,
    text: str,
    edges: DataFrame,
    rounds: int = ROUNDS,
    confidence: float = CONFIDENCE,
    min_values: int = MIN_VALUES,
) -> DataFrame:
    """Contexts of high confidence after so many rounds. edges: context, value, n, kind.

    More known tokens and higher confidences only let more contexts pass, so the contexts that
    pass with the counts of the graph hold all that pass with the counts of the corpus.
    """
    counted = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("total"))
    counted = stage(counted.where(F.col("n_values") >= min_values).drop("n_values"), "contexts")
    edges = stage(edges.join(counted.select("context"), "context"), "edges")
    possible = bootstrap(edges, counted, rounds, confidence, min_values, "possible").select("context")
    edges = edges.join(possible, "context", "left_semi")
    totals = stage(count_contexts(docs, text, possible), "totals")
    return bootstrap(edges, totals, rounds, confidence, min_values, "passed")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (kind, start, end) by kind, then start."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = read.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        let(
            F.col("text"),
            lambda t: let(
                base_spans(t), lambda base: F.struct(base.alias("base"), mentions(t, base).alias("mentions"))
            ),
        ).alias("found"),
    )
    scanned = stage(scanned.select("doc_id", "row", "found.base", "found.mentions"), "mentions")
    each = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = each.groupBy("context", "value").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    passed = learn_contexts(read, "text", edges, **options)
    new = each.where(F.col("kind").isNull()).drop("kind").join(passed.select("context", "kind"), "context")
    added = new.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    joined = scanned.select("doc_id", "row", "base").join(added, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    return joined.select("doc_id", "base", spans.alias("spans"))
