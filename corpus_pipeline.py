"""The corpus pipeline: stages over ``documents``, each calling one operator of spindrift.llm.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next one's ``docs``. All but the last return the columns of
``documents``. A stage deletes the tables that only its own steps read; what its result reads stays, so that results
of several runs can be read at once. ``run`` deletes those too once a stage's result is written.

Defined cases, of all stages: a null text is an empty one; null and repeated ids are rows of their own (the near-copy
stage keeps one of equal rows); very long texts are read whole; ties go to the smaller id; columns beyond those of
``documents`` pass through all but the last stage, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import packing, pii, simhash, toxicity
from spindrift.llm._store import materialise, release, scope, small_batches

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: A document whose toxicity score reaches this goes.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Without labels of the documents at hand, all have the
    smoothed share of toxic rows for a score, and stay."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labels), score_col="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more. Documents without
    words are copies of one another."""
    small_batches(spark)
    return simhash.drop_near_copies(docs, words=5, least=0.8)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text where that has changed, and a null
    text comes out empty."""
    found = pii.redact(pii.find_pii(docs))
    chars = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", chars).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 4096 tokens; an empty one is its end alone."""
    small_batches(spark)
    return packing.pack_documents(docs, TOKENIZER, end_id=1, capacity=4096, digests=True)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("pii", redact_pii), ("best_fit_packing", pack)]

#: No SQL expresses a trained classifier, near copies or packing; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scope() as tables:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, last + tables[:-1])  # all but the result itself, which the next stage reads
        last = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
