"""The corpus pipeline: documents through five stages, each written and read again.

quality classifier, exact dedup, MinHash near-dedup, benchmark decontamination, mixing.
The classifier is fitted on sf_dir's labels (all labelled rows may be learnt from here).

All stages take documents with extra columns of any name and return all columns, but for the
last. An empty table stays empty. Decisions go by doc_id: rows that repeat one go or stay
together, and a null one is an id like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, exact_dedup, mixing, near_dedup, quality_fm
from tideline.llm._shared import stage

#: Words of a shingle and similarity, in percent, of near copies; token weights of the mix.
SHINGLE, PERCENT = 5, 80
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
#: Documents below this score are rejected: the classifier's own decision.
GOOD = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a score of GOOD or more. Null and empty texts are scored by their
    statistics; a null n_chars counts as 0; without any label all stay. Rows of one doc_id
    share their best score."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_fm.keep_good(docs, labels, GOOD, metadata=("n_chars",))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lesser exact copies: of texts that differ in white space alone, the
    longest stays, then the smallest doc_id. Null, empty and blank texts are one group."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the smallest doc_id of each group of near copies. Texts without words are
    copies of nothing; one of fewer words than SHINGLE is one shingle; a null doc_id stays."""
    return near_dedup.drop_near_copies(docs, shingle=SHINGLE, percent=PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of whose words a twentieth or more are in windows of the
    benchmark. Texts and items without words match nothing."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each of docs: doc_id, n_tokens, domain, rate, copies, off_target. copies is
    how often to take the document (0: not at all) and is what meets the targets, on
    average; clean documents keep their row. Empty texts have no tokens and any rate does."""
    labelled = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    rates = mixing.mix(docs, labelled, TARGETS)
    return rates.select("doc_id", "n_tokens", "domain", "rate", "copies", "off_target")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminated), ("mix", mixed)]

#: The classifier, the near-dedup and the mixing rates are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, name)
    return docs
