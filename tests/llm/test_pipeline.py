"""run() against a brute-force version of its stages on a small corpus."""

import random
import re

import pytest

import corpus_pipeline

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(3)
    words = {"en": "the house and garden of this old town with many trees stands near river".split(), "de": "das haus und der garten dieser alten stadt mit vielen baeumen steht am fluss".split()}
    item = " ".join(f"bench{i}" for i in range(15))
    docs = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(words[lang]) + (f"x{rng.randrange(50)}" if rng.random() < 0.3 else "") for _ in range(60 + i % 20))
        docs.append([i, text, lang, f"src{i % 5}", len(text)])
    for i, of in ((240, 1), (241, 2), (242, 2)):
        docs.append([i, docs[of][1].replace(" ", "  ", 1), docs[of][2], "s", 0])
    for i, of in ((250, 7), (251, 8)):
        docs.append([i, docs[of][1] + " tail", docs[of][2], "s", 0])
    docs.append([260, item + " and a few more words", "en", "s", 0])
    docs += [[300 + i, " ".join("###$$$%%%" for _ in range(40 + i)), "en", "junk", 0] for i in range(40)]
    return docs, item


def brute(kept, item):
    """Ids that stay of (doc_id, text): exact, then near copies, then contamination."""
    groups = {}
    for d, t in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d))
    stay = {min(g)[1] for g in groups.values()}
    kept = sorted((d, t) for d, t in kept if d in stay)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in kept for w in [t.translate(LOW).split()]}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return {d for d, t in kept if group[d] == d and item not in t}


def test_run(spark, tmp_path):
    docs, item = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(docs, schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], 0 if d[3] == "junk" else 1, 0) for d in docs if d[0] % 4], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = corpus_pipeline.quality(spark, frame, str(tmp_path))
    assert good.columns == frame.columns
    kept = [(r.doc_id, r.text) for r in good.collect()]
    assert not any(d >= 300 for d, _ in kept) and len(kept) == len(docs) - 40
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == brute(kept, item)
    assert len(got) == len({r.doc_id for r in got}) and all(r.rate >= 0 for r in got)
    tokens = {k: sum(r.n_tokens * r.rate for r in got if r.domain == k) for k in ("en", "de")}
    assert abs(tokens["de"] / sum(tokens.values()) - 1 / 3) < 0.02
    taken = {k: sum(r.n_tokens * r.copies for r in got if r.domain == k) for k in ("en", "de")}
    assert abs(taken["de"] / sum(taken.values()) - 1 / 3) < 0.06


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __keep string, __bad long, kept string, score double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """labels and benchmark of a small corpus, as the stages read them."""
    docs, item = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d[0], 0 if d[3] == "junk" else 1, 0) for d in docs if d[0] % 4], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tables, name, function):
    docs, item = corpus()
    rows = [(*d, "x", 1, "y", 0.5) for d in docs]
    odd = [(900, None), (901, ""), (902, "  \n"), (903, "tie tie tie"), (904, " ".join(f"w{i % 900}" for i in range(60_000))), (905, item.upper()), (1, docs[1][1]), (None, "a text without an id"), (None, None)]
    rows += [(d, t, None, None, None, None, None, None, None) for d, t in odd]
    got = function(spark, spark.createDataFrame(rows, SCHEMA), tables)
    kept = [r.doc_id for r in got.collect()]
    if name != "mix":
        assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    have = set(kept)
    if name == "quality":  # junk goes; the rest of the labelled kind stays, repeated rows too
        assert not have & set(range(300, 340)) and set(range(260)) - have <= set(range(243, 250)) | set(range(252, 260)) and kept.count(1) == 2
    if name == "exact":  # null, empty and blank texts are one group, whose longest row stays
        assert {240, 241, 242} & have == {240, 241} or {1, 240} & have
        assert have & {900, 901, 902} == {902} and None in have
    if name == "near":  # texts without shingles are linked with nothing
        assert {900, 901, 902, 903, 904} <= have and not {250, 251} & have and kept.count(1) == 2 and kept.count(None) == 2
    if name == "decontaminate":
        assert not {260, 905} & have and len(kept) == len(rows) - 2
    if name == "mix":
        assert len(kept) == len(rows) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 and r.off_target < 0.01 for r in got.collect())


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, tables, name, function):
    assert function(spark, spark.createDataFrame([], SCHEMA), tables).collect() == []
