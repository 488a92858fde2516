"""Captions: phrases on a timeline, cues out of text, and SRT documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T

#: A word, the pause in words that a phrase's last mark gives, and the entities of cues, the ampersand last (fixed values).
WORD = r"[\p{L}\p{N}_'][\p{L}\p{N}_']*"
FULL_STOP, FULL_PAUSE = r"[.!?][\"')\]]*$", 0.65
SHORT_STOP, SHORT_PAUSE = r"[,;:][\"')\]]*$", 0.25
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def timed_phrases(rows: DataFrame, keys: list[str], text: str, start: str, end: str) -> DataFrame:
    """Phrases of each text spread over [start, end): a phrase weighs its words plus a
    pause; the last ends exactly at end. Times are doubles. Both sums of weights add in the order
    of the cues: the last bit decides where a border falls on half a millisecond."""
    phrases = rows.where(F.col(end) > F.col(start)).withColumn("_text", F.col(text)).withColumn("_p", T.caption_phrases("_text"))
    each = phrases.select(*keys, start, end, F.posexplode("_p").alias("cue", "_w")).withColumn("phrase", F.array_join("_w", " "))
    words = F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.col("phrase"), F.lit(WORD), F.lit(0))))
    pause = F.when(F.col("phrase").rlike(FULL_STOP), FULL_PAUSE).when(F.col("phrase").rlike(SHORT_STOP), SHORT_PAUSE).otherwise(0.0)
    each = each.withColumn("_weight", words + pause)
    line = W.partitionBy(*keys).orderBy("cue")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.sum("_weight").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)) / F.sum("_weight").over(whole)
    last = F.col("cue") == F.max("cue").over(whole)
    each = each.withColumn("cue_end", F.when(last, F.col(end)).otherwise(F.col(start) + (F.col(end) - F.col(start)) * share))
    begin = F.coalesce(F.lag("cue_end").over(line), F.col(start))
    return each.select(*keys, "cue", begin.alias("cue_start"), "cue_end", "phrase")


def running_offset(duration: Column, partition: list[str], order: list) -> Column:
    """Sum of the durations before each row."""
    return F.coalesce(F.sum(duration).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def srt_document(cues: DataFrame, keys: list[str], order: list[str], start_ms: str, end_ms: str, text: str) -> DataFrame:
    """One SRT text for each key, cues numbered from 1."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    block = F.concat(number.cast("string"), F.lit("\n"), T.srt_time(start_ms), F.lit(" --> "), T.srt_time(end_ms), F.lit("\n"), F.trim(text), F.lit("\n"))
    listed = cues.select(*keys, number.alias("_n"), block.alias("_b"))
    return listed.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda c: c["_b"]), "\n").alias("srt"))


def parsed_cues(documents: DataFrame, keys: list[str], srt: str) -> DataFrame:
    """Cues of SRT texts: blocks between blank lines, a timing line (hours optional, comma or
    point), tags and entities out, empty cues dropped."""
    stamp = r"((?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3})[^\n]*"
    blocks = documents.select(*keys, F.posexplode(F.split(F.replace(F.col(srt), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")).alias("pos", "block"))
    timed = blocks.withColumn("a", F.regexp_extract("block", stamp, 1)).withColumn("b", F.regexp_extract("block", stamp, 2)).where("a <> ''")
    body = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"<[^>]*>|\{\\[^}]*\}", "")
    for mark, char in ENTITIES:
        body = F.replace(body, F.lit(mark), F.lit(char))
    body = F.trim(F.regexp_replace(body, r"\s+", " "))
    return timed.select(*keys, "pos", T.srt_seconds("a").alias("start_s"), T.srt_seconds("b").alias("end_s"), body.alias("text")).where("text <> ''")
