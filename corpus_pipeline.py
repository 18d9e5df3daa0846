"""A corpus from raw documents to packed sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents. All stages but the
last return the columns of documents. What a stage staged on its way goes once its result is written, and so does
the result before it, so the shared folder holds one stage's data at a time and the result at the end.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import mixing, near_dedup, packing, quality_rules, toxicity
from framelake.runtime import discard, fresh, shared_dir, staged, swept, table

WORDS_KEPT = 1 << 18  #: of the packing stage, which shares its executors with workers of the stages before


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it is fitted on ``labels`` of these documents."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_columns())
    odds, verdict = fresh(docs, "toxicity", "toxic")
    return toxicity.score(docs, chain, names=(odds, verdict)).where(f"not `{verdict}`").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, and all documents of failed hosts, go."""
    measures, verdict = fresh(docs, "q", "kept")
    return quality_rules.judge(docs, names=(measures, verdict)).where(F.col(verdict)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays."""
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat, and some documents go."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=WORDS_KEPT)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A fitted chain, a probabilistic forest and a tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        with swept(spark):
            docs = staged(stage(spark, docs, sf_dir), path=path)
        if before:
            discard(spark, before)
        before = path
    return docs
