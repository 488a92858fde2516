"""Held-out accuracy of the trained queries on given tables, and documents with columns named like their results."""

import pytest
from pyspark.sql import functions as F

from tideline.llm import language_crf, mixing, quality_fm, queries, toxicity_cnn

#: The tables whose held-out accuracy the README gives: smaller ones have too few labels to learn from.
SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "mark", "least"), [("op3_quality_fm", "quality", 0.97), ("op7_toxicity_cnn", "toxic", 0.95)])
def test_classifiers_on_rows_they_have_not_seen(spark, name, mark, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.col(mark).isNotNull()).select("doc_id", mark).distinct()
    seen = queries.QUERIES[name](spark, SF).where("held_out").join(labels, "doc_id")
    right, n, first = seen.agg(F.count_if(F.col("predicted") == F.col(mark)), F.count(F.lit(1)), F.avg(F.col(mark).cast("double"))).first()
    assert n > 50
    assert right / n >= least
    assert right / n > max(first, 1 - first)  # better than always the same answer


def test_language_on_rows_it_has_not_seen(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    right, n = queries.op5_language_crf(spark, SF).where("held_out and lang_pred <> 'und'").join(truth, "doc_id").agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count(F.lit(1))).first()
    assert n > 200 and right / n >= 0.99


CLASHING = ["score", "predicted", "held_out", "lang_pred", "n_switches", "domain", "posterior", "rate", "copies", "off_target", "n_tokens", "p", "label", "mark", "meta0", "held"]


@pytest.mark.parametrize("name", ["quality", "toxicity", "language", "mix"])
def test_columns_named_like_results_change_nothing(spark, name):
    rows = [(i, "vile rot " * (i % 2) + f"plain words and number {i}", "en" if i % 3 else "de") for i in range(60)] + [(60, None, None), (61, "", "en"), (None, "no id", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = docs.withColumns({c: F.lit("clash") for c in CLASHING})
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, label int")
    made = {
        "quality": lambda d: quality_fm.score(d, labels),
        "toxicity": lambda d: toxicity_cnn.score(d, labels),
        "language": lambda d: language_crf.label_languages(d, F.col("doc_id") % 3 != 1),
        "mix": lambda d: mixing.mix(d, d.select("doc_id", F.col("lang").alias("domain")), {"en": 0.5, "de": 0.5}),
    }[name]
    plain, clashing = made(docs), made(more)
    got = [sorted(map(str, d.select("doc_id", *[c for c in plain.columns if c not in ("doc_id", "text", "lang")]).collect())) for d in (plain, clashing)]
    assert len(got[0]) == len(rows) and got[0] == got[1]
