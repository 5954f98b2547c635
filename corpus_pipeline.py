"""A training-corpus pipeline of five stages; each takes the documents that its predecessor kept, with their columns.

Every stage judges rows, not ids: repeated and null ids stay apart, and columns of any name
pass through all stages but the last. Defined results, stage by stage:

- quality rules: a null or empty text has no words and goes; labels of an id count once;
  without labels only the base rule decides.
- near duplicates: of each component one row stays, that of the smallest id (null last), then
  of the smallest text; rows repeated as a whole are one.
- decontamination: texts without words stay; items without words or id have no phrase.
- personal data: all rows stay; only texts with a span change, and n_chars with them.
- token ids: null and empty texts give the end id alone.

Texts of any length are taken whole; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm import decontamination, pii, quality_rules, sentencepieces, simhash
from lumidex.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 6)."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id (operator 4)."""
    return simhash.dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items (operator 9)."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind (operator 7)."""
    return pii.redact(docs, pii.fit(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts and the text that they give again (operator 1)."""
    out = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", benchmark_free), ("personal data", private), ("token ids", encoded)]
#: The quality cutoffs, fingerprints and boosted trees have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
