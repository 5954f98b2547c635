"""The registered queries of the text operators; each thin query derives its digest columns from the operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, exact_dedup, language_id, pii, quality_classifier, quality_rules, sentencepieces, simhash, source_divergence, substrings, token_files, toxicity
from .shared import held_out, labelled, table
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
PIECES, WORDS, END = "piece_bpe_32k.model", "word_bpe_49k.json", 2


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexed(out.fp).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.checksums(token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), END, packed=True))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_rules_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on labels that follow from the texts, at a risk that small tables can meet: cutoffs are admitted, and decide."""
    docs = table(spark, sf_dir, "documents")
    bad = (F.regexp_count("text", F.lit(r"[#*$%&|<>]")) > 4) | (F.col("doc_id") % 11 == 0)
    out = quality_rules.judge(docs, docs.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality")), 0.3)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs, 4, 2))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.find(docs, pii.fit(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    base = F.filter("spans", lambda s: s.base)
    count = [(F.size(base) - F.size(F.array_remove(base.kind, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *count, F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(labelled(spark, sf_dir, "quality", 3, 1, quality_classifier.SAMPLE))
    out = quality_classifier.score(table(spark, sf_dir, "documents"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = toxicity.fit(labelled(spark, sf_dir, "toxic", 4, 2, toxicity.SAMPLE))
    out = toxicity.score(table(spark, sf_dir, "documents"), lexicon)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation_repair.solve(conversation_repair.damaged(table(spark, sf_dir, "conversations")))
    digests = conversation_repair.digests(out.messages).withColumnRenamed("conv_id", "id")
    return out.summary.join(digests, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_substrings, op4_simhash, op5_token_files, op6_quality_rules, op7_pii, op8_quality_classifier, op9_decontamination, op10_toxicity, op11_conversation_repair, op12_source_divergence, op13_exact_dedup, quality_rules_planted)}
