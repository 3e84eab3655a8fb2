"""One query per operator over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (
    decontaminate,
    html_text,
    line_dedup,
    packed_ids,
    pii,
    quality_rules,
    rank_profiles,
    rule_ensemble,
    secret_scan,
    simhash,
    turn_repair,
    whitening,
    word_bpe,
)
from spanloom.llm.shared import small_batches, spans_text

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op2_packed_ids(
    spark: SparkSession, sf_dir: str, vocabulary_file: str = public_tokenizers.path("word_bpe_49k.json")
) -> DataFrame:
    packed = packed_ids.write(
        _table(spark, sf_dir, "documents"), lambda: packed_ids.word_encoder(vocabulary_file), 49_408, end_id=2
    )
    return packed_ids.read(spark, packed)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.scan(docs, pii.fit(docs))
    return found.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(spans_text(F.col("base"), pii.KINDS), 256).alias("base_sha256"),
        spans_text(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, _table(spark, sf_dir, "labels")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_texts(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(_table(spark, sf_dir, "benchmark"))
    found = decontaminate.report(_table(spark, sf_dir, "documents"), index)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def digests(coded: DataFrame) -> DataFrame:
    """Per document the number of ids and hashes of the ids and of the decoded bytes."""
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_word_bpe(
    spark: SparkSession, sf_dir: str, vocabulary_file: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
) -> DataFrame:
    ranks = word_bpe.read_ranks(vocabulary_file)
    return digests(word_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    names = secret_scan.KINDS
    return found.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{names[k]}") for k in range(3)],
        F.sha2(spans_text(F.col("base"), names), 256).alias("base_sha256"),
        spans_text(F.col("spans"), names).alias("spans"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of the lines that go, comma-joined."""
    docs = _table(spark, sf_dir, "documents")
    gone = line_dedup.repeated_lines(docs).withColumnRenamed("doc_id", "doc")
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(F.split("text", "\n")).alias("n_lines"))
    same = rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["digest"] == gone["text_hash"])
    return rows.join(gone, same, "left").select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repairs(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = rank_profiles.held_out(F.col("doc_id"))
    found = rank_profiles.predict(docs, rank_profiles.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


REGISTRY: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_packed_ids": op2_packed_ids,
    "op3_pii": op3_pii,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_html_text": op5_html_text,
    "op6_decontaminate": op6_decontaminate,
    "op7_word_bpe": op7_word_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_whitening": op12_whitening,
    "op13_rank_profiles": op13_rank_profiles,
}
ORACLES: dict[str, str] = {}
