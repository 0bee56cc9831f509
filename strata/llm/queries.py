"""The registered queries of this package: ``opN_<name>(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import (
    fingerprints,
    jaccard,
    language,
    licenses,
    oracle,
    packing,
    phrases,
    pii,
    substrings,
    templates,
    toxicity,
    urls,
    warc,
    whitening,
)
from strata.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: The fixed rules of the URL query.
URL_RULES = (
    urls.Rule("block", "net"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page's labelled outcome is that of the
    document with its id: good if of quality and not toxic."""
    labels = table(spark, sf_dir, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in the documents."""
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text."""
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers or names."""
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document. Grades of the labelled ones: 0 not toxic,
    1 toxic in a text of good quality, 2 toxic in a poor one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grades = labels.select(
        F.col("doc_id"),
        F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).alias("grade"),
    )
    return toxicity.predict(docs, toxicity.fit(grades, docs=docs))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter is held out of the learning."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    filters = language.fit(docs.where(~held_out))
    return language.predict(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenised and packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets overlap by 80 %."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 20 words that also start earlier."""
    return substrings.digest(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding projected on the 32 leading components, whitened."""
    x, size = whitening.integers(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(x, size, whitening.fit(x, size))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_urls": op1_urls,
    "op2_licenses": op2_licenses,
    "op3_order_minhash": op3_order_minhash,
    "op4_templates": op4_templates,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_jaccard": op10_jaccard,
    "op11_substrings": op11_substrings,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_urls": oracle.url_judgement(URL_RULES),
    "op2_licenses": oracle.licence_sentences(),
    "op9_warc": oracle.PAGE_ARCHIVES,
    "op10_jaccard": oracle.NEAR_DUPLICATES,
    "op11_substrings": oracle.REPEATED_WINDOWS,
    "op13_phrases": oracle.COLLOCATIONS,
}
