"""The stages of ``corpus_pipeline``: ``(spark, docs, sf_dir) -> DataFrame``.

Each works on all the documents that it is given. All but the last return rows
of ``docs`` with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import jaccard, language, packing, pii, templates
from strata.llm.common import settle, table

#: A document whose best corrected n-gram share is below this has no known language.
MIN_LANGUAGE_SCORE = 0.05


def keep_identified_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, and those that no language
    filter recognises, go. Learns from the ``lang`` column of ``docs``; a
    document is judged by its text alone. Repeated rows are judged alike."""
    return language.keep(docs, language.fit(docs), MIN_LANGUAGE_SCORE)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of the documents that links connect, the one with
    the smallest id stays. Of rows with the same id one stays (the greatest by
    text, lang, source and n_chars). Documents without words are linked with
    nothing and stay, as do rows without an id."""
    groups = jaccard.join(docs).select("doc_id", "component_id").distinct()
    leaders = settle(groups.where("doc_id = component_id").select("doc_id"), "leaders")
    kept = docs.join(leaders, "doc_id", "left_semi")
    repeated = settle(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = (
        kept.join(repeated, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max(F.struct(*rest)).alias("row__"))
        .select("doc_id", *[F.col(f"row__.{c}").alias(c) for c in rest])
    )
    single = kept.join(repeated, "doc_id", "left_anti")
    unnamed = docs.where("doc_id IS NULL")
    return single.unionByName(one).unionByName(unnamed).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item, also
    with other numbers or names, go. Rows without an id stay."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found is replaced by its kind; ``n_chars`` follows the
    new text. Documents without personal data keep their text."""
    return pii.redact(docs, pii.fit(docs), length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1024 tokens."""
    return packing.pack(docs)
