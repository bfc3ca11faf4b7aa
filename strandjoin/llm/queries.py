"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandjoin.llm import (
    byte_bpe,
    conversations,
    decontaminate,
    exact_dedup,
    html_extract,
    jaccard,
    langid,
    packing,
    phrases,
    pii,
    secrets,
    spans,
    url_filter,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(found: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(spans.span_text(found, kinds), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = _table(spark, sf_dir, "benchmark")
    judged = decontaminate.contamination(_table(spark, sf_dir, "documents"), benchmark)
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    counts = [spans.count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id",
        *counts,
        _digest(F.col("base"), pii.KINDS).alias("base_sha256"),
        spans.span_text(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents")).drop("row")


#: Every page whose id leaves this remainder is damaged in the second replica.
DAMAGED = (97, 13)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages against a replica of them in which one body in 97 has a byte changed."""
    pages = _table(spark, sf_dir, "pages")
    every, rest = DAMAGED
    good = F.coalesce("html", F.lit(""))
    damaged = F.when(F.col("page_id") % every == rest, F.concat(F.lit("?"), F.substring(good, 2, 1 << 30)))
    trees = []
    for body in (good, F.coalesce(damaged, good)):
        records = pages.select(F.col("page_id").alias("id"), "url", warc.record(F.col("url"), body).alias("record"))
        trees.append(warc.merkle_tree(warc.place_records(records, ["id", "url"])))
    found = warc.audit(*trees)
    return found.select(
        F.coalesce("left_id", "right_id").alias("page_id"),
        "place",
        F.col("left_begin").alias("begin"),
        F.col("left_end").alias("end"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    names = secrets.KINDS[: secrets.BASE_KINDS]
    counts = [spans.count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(names)]
    return found.select(
        "doc_id",
        *counts,
        _digest(F.col("base"), secrets.KINDS).alias("base_sha256"),
        spans.span_text(F.col("spans"), secrets.KINDS).alias("spans"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversations.repair_conversations(turns, conversations.damage(turns))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_decontamination,
        op2_best_fit_packing,
        op3_html_extraction,
        op4_url_filter,
        op5_ngram_jaccard,
        op6_personal_data,
        op7_exact_dedup,
        op8_warc_fixity,
        op9_language_id,
        op10_secret_scan,
        op11_conversation_repair,
        op12_byte_bpe,
        op13_phrase_mining,
    )
    return {query.__name__: query for query in found}
