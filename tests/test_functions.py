"""Scalars: captions against a direct fold, rounding against Python, hashes against hashlib."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as T


def phrases(text, least=3, most=7):
    """A direct statement of the rule, word by word."""
    groups, now = [], []
    for word in text.split():
        now.append(word)
        if len(now) >= most or (len(now) >= least and re.search(r"[,;:.!?][\"')\]]*$", word)):
            groups, now = [*groups, now], []
    groups += [now] if now else []
    if len(groups) > 1 and len(groups[-1]) < least:
        moved = min(least - len(groups[-1]), max(0, len(groups[-2]) - least))
        if moved:
            groups[-2], groups[-1] = groups[-2][:-moved], groups[-2][-moved:] + groups[-1]
        if len(groups[-1]) < least and len(groups[-2]) + len(groups[-1]) <= most:
            groups[-2:] = [groups[-2] + groups[-1]]
    return [" ".join(g) for g in groups]


def test_caption_phrases(spark):
    rng = random.Random(4)
    texts = ["", " ", "one", *[" ".join(rng.choice(["a", "bb", "c,", "d.", 'e!"', "f"]) for _ in range(rng.randrange(1, 40))) for _ in range(200)]]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.transform(T.caption_phrases("text"), lambda w: F.array_join(w, " ")).alias("p")).collect()
    for row in got:
        assert row.p == phrases(texts[row.i]), texts[row.i]


def test_caption_phrases_of_long_texts_and_odd_marks(spark):
    rng = random.Random(5)
    words = ["a", "b.", '.")', '"', ",x", ",,", "c)]", "d:\'", "ü!", "."]
    texts = [" \t\n".join(rng.choice(words) for _ in range(n)) for n in (2, 3, 7, 8, 9, 50_000)]
    texts += ["x" * 300_000 + " y z, " + "," * 300_000 + "q", "," + '"' * 200_000 + " b c d"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.transform(T.caption_phrases("text"), lambda w: F.array_join(w, " ")).alias("p")).collect()
    for row in got:
        assert row.p == phrases(texts[row.i]), row.i
    assert spark.sql("select cast(null as string) as text").select(T.caption_phrases("text").alias("p")).first().p is None


def test_two_decimals_is_exact(spark):
    values = [k / 1000 for k in range(0, 1001)] + [0.005, 0.125, 0.715, 0.835, 2.675]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.two_decimals("v").alias("s")).collect()
    for row in got:
        assert row.s == f"{row.v:.2f}"


@pytest.mark.parametrize("parts", [("a",), ("a", "b"), ("", "ü")])
def test_content_hash(spark, parts):
    row = spark.range(1).select(T.content_hash(*[F.lit(p) for p in parts]).alias("h")).first()
    assert row.h == hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


def test_small_scalars(spark):
    row = spark.range(1).select(
        T.word_count(F.lit("  ")).alias("none"), T.word_count(F.lit(" a  b ")).alias("two"), T.srt_time(F.lit(3_723_004)).alias("time"), T.srt_seconds(F.lit("02:03,5")).alias("short"),
        T.speech_ms(F.lit(13), 145).alias("ms"), T.is_unknown_label(F.lit(" Speaker_3 ")).alias("unknown"), T.safe_id(F.lit(" --a b?c-- ")).alias("safe"),
        T.speech_text(F.lit("Mr. X  in s01e02"), "en-US").alias("spoken"), T.normal_purpose(F.lit(" original hook ")).alias("purpose"),
    ).first()
    assert (row.none, row.two, row.time, row.short, row.ms) == (0, 2, "01:02:03,004", 123.5, 5400)
    assert (row.unknown, row.safe, row.spoken, row.purpose) == (True, "a-b-c", "Mister X in season 1, episode 2", "ORIGINAL_HOOK")
