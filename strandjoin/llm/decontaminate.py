"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item (a shorter item is one window of all its
words). Texts are cut into k-grams of 5 words; of every 9 neighbouring k-grams, which together
span 13 words, both sides keep the smallest hash. Two equal windows hold the same k-grams and so
keep the same one: no shared window is missed. Documents and items meet on the kept hashes; each
meeting is extended by comparing words to both sides, as far as the windows around the k-gram
reach, and counts if the equal stretch fills a window. Items shorter than 13 words do the same
with windows of their own length.

Documents are read in place: their words never enter a shuffle unless the benchmark is too large
to broadcast. Then the kept hashes meet by shuffle first, and only documents that share one are
joined with their words.

Arrays are exploded with explode_outer: for explode Spark infers a filter and pushes the whole
array expression below the projection that splits the text, which would split it again for each
element.

DataFrame functions only. Defined results: null text has no words; a document without words has
no hits and is not contaminated; repeated rows get a row each; items of a null id appear as
`null`; an empty benchmark contaminates nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.common import ascii_lower, stage
from strandjoin.llm.spans import let

WINDOW = 13
GRAM = 5
#: A document is contaminated when at least one word in so many is hit.
ONE_IN = 20
#: Fixed value: what separates words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many contexts, of at most 21 words each, are broadcast.
BROADCAST_CONTEXTS = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1), "")


def shape(span: int, gram: int) -> tuple[int, int]:
    """k and the number of k-grams in a window of so many words."""
    k = min(gram, span)
    return k, span - k + 1


def gram_hash(listed: Column, at: Column, span: int, k: int) -> Column:
    return F.xxhash64(F.lit(span), *[F.get(listed, at + i) for i in range(k)])


def gram_hashes(listed: Column, span: int, k: int) -> Column:
    places = F.sequence(F.lit(0), F.size(listed) - k)
    return F.transform(places, lambda i: gram_hash(listed, i, span, k))


def kept_hashes(listed: Column, span: int, gram: int) -> Column:
    """The smallest hash of every window of the listed words, each once."""
    k, w = shape(span, gram)

    def smallest(hashes: Column) -> Column:
        if w == 1:
            return hashes
        starts = F.sequence(F.lit(1), F.size(hashes) - w + 1)
        return F.transform(starts, lambda p: F.array_min(F.slice(hashes, p, F.lit(w))))

    kept = F.array_distinct(let(gram_hashes(listed, span, k), smallest))
    return F.when(F.size(listed) >= span, kept).otherwise(F.array().cast("array<bigint>"))


def side(listed: Column, at: Column, k: int, reach: int) -> tuple[Column, Column]:
    """Up to reach words before the k-gram, nearest first, and after it."""
    begin = F.greatest(F.lit(0), at - reach)
    before = F.reverse(F.slice(listed, begin + 1, at - begin))
    return before, F.slice(listed, at + k + 1, F.lit(reach))


def common_start(a: Column, b: Column) -> Column:
    """How many first elements of two arrays agree."""
    return let(
        F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        lambda same: let(
            F.array_position(same, False), lambda p: F.when(p == 0, F.size(same)).otherwise(p - 1)
        ),
    )


def item_contexts(items: DataFrame, span: int, gram: int) -> DataFrame:
    """(item, span, hash, before, gram, after) of every kept k-gram of the items."""
    k, w = shape(span, gram)
    own = items.where(F.col("span") == span)
    kept = own.withColumn("kept", kept_hashes(F.col("words"), span, gram))
    hashes = gram_hashes(F.col("words"), span, k)
    placed = kept.withColumn("hashes", hashes)
    at = F.filter(
        F.sequence(F.lit(0), F.size("hashes") - 1),
        lambda i: F.array_contains(F.col("kept"), F.get(F.col("hashes"), i)),
    )
    rows = placed.withColumn("at", F.explode_outer(at)).where(F.col("at").isNotNull())
    before, after = side(F.col("words"), F.col("at"), k, w - 1)
    return rows.select(
        "item",
        F.lit(span).alias("span"),
        F.get("hashes", "at").alias("hash"),
        before.alias("before"),
        F.slice("words", F.col("at") + 1, k).alias("gram"),
        after.alias("after"),
    )


def extend(matched: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, context, begin, end) of the stretches that fill a window."""
    k, w = shape(span, gram)
    own = matched.where(F.col("span") == span)
    listed = F.col("words")
    at = F.filter(
        F.sequence(F.lit(0), F.size(listed) - k),
        lambda i: gram_hash(listed, i, span, k) == F.col("hash"),
    )
    placed = own.withColumn("at", F.explode_outer(at))
    placed = placed.where(F.slice("words", F.col("at") + 1, k) == F.col("gram"))
    before, after = side(listed, F.col("at"), k, w - 1)
    grown = placed.select(
        "doc_id",
        "text_hash",
        "context",
        "at",
        common_start(before, F.col("before")).alias("left"),
        common_start(after, F.col("after")).alias("right"),
    )
    filled = grown.where(F.col("left") + k + F.col("right") >= span)
    return filled.select(
        "doc_id",
        "text_hash",
        "context",
        (F.col("at") - F.col("left")).cast("long").alias("begin"),
        (F.col("at") + k + F.col("right")).cast("long").alias("end"),
    )


def covered(stretches: Column) -> Column:
    """How many words an array of (begin, end) covers."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["begin"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(stretches), start, step, lambda a: a["n"])


def match_contexts(docs: DataFrame, contexts: DataFrame, spans: list[int], gram: int, small: bool) -> DataFrame:
    """Documents with their words, once for each context whose hash they keep."""
    listed = docs.withColumn("words", words(F.col("text"))).drop("text")
    kept = F.concat(*[kept_hashes(F.col("words"), span, gram) for span in spans])
    probes = listed.withColumn("kept", kept).select("doc_id", "text_hash", "words", F.explode_outer("kept").alias("hash"))
    if small:
        return probes.join(F.broadcast(contexts), "hash")
    wanted = contexts.select("hash").distinct()
    met = stage(probes.drop("words").join(wanted, "hash"), "met").select(
        "hash", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash")
    )
    match = (listed["text_hash"] == met["_text_hash"]) & listed["doc_id"].eqNullSafe(met["_id"])
    return listed.join(met, match).drop("_id", "_text_hash").join(contexts, "hash")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    one_in: int = ONE_IN,
) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit, items (sorted strings), contaminated."""
    read = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")
    )
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
        words(F.col(item_text)).alias("words"),
    )
    items = items.withColumn("span", F.least(F.size("words"), F.lit(window)))
    # At most `window` values.
    spans = sorted(r[0] for r in items.where("span > 0").select("span").distinct().collect())
    counted = read.select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if not spans:
        none = F.array().cast("array<string>")
        return counted.select("*", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), F.lit(False).alias("contaminated"))
    found = None
    for span in spans:
        one = item_contexts(items, span, gram)
        found = one if found is None else found.unionByName(one)
    key = F.xxhash64("span", "before", "gram", "after")
    found = stage(found.withColumn("context", key), "contexts")
    contexts = found.drop("item").distinct()
    members = found.select("context", "item").distinct()
    small = contexts.count() <= BROADCAST_CONTEXTS
    matched = match_contexts(read, contexts, spans, gram, small)
    stretches = None
    for span in spans:
        one = extend(matched, span, gram)
        stretches = one if stretches is None else stretches.unionByName(one)
    stretches = stage(stretches, "stretches")
    keys = ["doc_id", "text_hash"]
    hits = stretches.groupBy(*keys).agg(covered(F.collect_set(F.struct("begin", "end"))).alias("n_hit"))
    listed = stretches.select(*keys, "context").distinct().join(members, "context")
    listed = listed.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), "n_hit")
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), "items")
    joined = counted
    for more in (hits, listed):
        match = (joined["text_hash"] == more["_text_hash"]) & joined["doc_id"].eqNullSafe(more["_id"])
        joined = joined.join(more, match, "left").drop("_id", "_text_hash")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        *keys,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    judged = contamination(docs, benchmark, doc_id, text, **options).where("contaminated")
    bad = stage(judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash")).distinct(), "contaminated")
    match = (F.xxhash64(docs[text]) == bad["_text_hash"]) & docs[doc_id].eqNullSafe(bad["_id"])
    return docs.join(bad, match, "left_anti")
