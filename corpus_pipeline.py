"""The corpus pipeline: ``documents`` through the stages in ``STAGES``.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. ``run`` writes each
stage's result as Parquet to the shared folder and reads it back as the next
one's ``docs``, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import stages
from strata.llm.common import settle, table

STAGES = [
    ("language_id", stages.keep_identified_languages),
    ("ngram_jaccard", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("pii", stages.redact_personal_data),
    ("packing", stages.pack_sequences),
]

#: Stages with learned models and tokenizers are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
