"""Learning from all labelled rows, over parts of bounded size."""

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import toxicity_cnn
from tideline.llm._learn import all_labelled, in_parts, part_count, summed


def test_labelled_rows_beyond_six_thousand_are_learnt_from(spark):
    # of the toxic rows, those with the largest hashes are told by a word of their own
    ids = spark.range(9000).withColumn("label", (F.col("id") % 3 == 0).cast("int")).orderBy("label", F.xxhash64("id")).collect()
    marks = {r.id: "vile" for r in ids if r.label} | {r.id: "rotten" for r in ids[-500:]}
    rows = [(i, f"plain words of house number {i % 50} {marks.get(i, 'today')}", "en") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in marks)) for i in range(9000)], "doc_id long, label int")
    scored = toxicity_cnn.score(docs, labels).collect()
    for mark in ("vile", "rotten"):
        assert all(r.score >= 0.5 for r in scored if marks.get(r.doc_id) == mark)
    assert sum(r.score >= 0.5 for r in scored if r.doc_id not in marks) < 60


def test_parts_count_every_row_and_their_order_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(toxicity_cnn, "EPOCHS", 4)
    texts = [f"{['garden', 'house', 'street'][i % 3]} number {i % 11} " + "vile rot " * (i % 4 == 0) for i in range(300)]
    rows = spark.createDataFrame([(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, label int")
    learnt = all_labelled(rows.repartition(7), labels)
    assert learnt.count() == 300 and part_count(learnt, 50) == 6
    parts = in_parts(learnt, 6, toxicity_cnn._prepare(["de", "en"]))
    got = summed(parts, toxicity_cnn._counts(2))
    each = [toxicity_cnn._counts(2)(0, toxicity_cnn._prepare(["de", "en"])(p.orderBy("doc_id").toArrow())) for p in (learnt.where(F.expr(f"pmod(xxhash64(doc_id), 6) = {i}")) for i in range(6))]
    assert (got == sum(each)).all()
    words = sum(len(t.split()) for i, t in enumerate(texts) if i % 3 != 2)
    assert got[(2 << toxicity_cnn.BITS) + 2 :].sum() == words  # profiles take the rows kept back too
    scored = {r.doc_id: r.score for r in toxicity_cnn.score(rows.repartition(7), labels, part=50).collect()}
    again = {r.doc_id: r.score for r in toxicity_cnn.score(rows.repartition(2), labels.repartition(5), part=50).collect()}
    assert all(abs(scored[i] - again[i]) < 1e-9 for i in range(300))  # texts scored in other batches differ in the last bit
    assert np.mean([(scored[i] >= 0.5) == (i % 4 == 0) for i in range(300)]) > 0.95
