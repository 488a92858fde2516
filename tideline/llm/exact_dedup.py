"""Exact deduplication with a heavy-hitter split.

Digests of the normalised texts go through a Misra-Gries frequency sketch (Spark's
``approx_top_k``). Digests that the sketch finds frequent are counted exactly and their
winners are broadcast, so rows of a huge group of copies are resolved where they are
read and never meet in one task. All other digests take an ordinary shuffle.

DataFrame functions only. The table of heavy digests is bounded: at most ``max_heavy``
rows, whatever the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.llm._shared import stage

#: Characters that do not count when texts are compared (fixed values).
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), IGNORED, text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the original text), digest (32 bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
    )


def heavy_digests(table: DataFrame, max_heavy: int, heavy_rows: int) -> DataFrame:
    """Digests that the Misra-Gries sketch reports with more than heavy_rows rows.

    The sketch keeps 16 counters for each digest asked for, so a digest with more than
    1/(16 * max_heavy) of all rows can't be missed. At most max_heavy rows.
    """
    tracked = 16 * max_heavy
    return (
        table.agg(F.expr(f"approx_top_k(hex(digest), {max_heavy}, {tracked})").alias("top"))
        .select(F.explode("top").alias("t"))
        .where(F.col("t.count") > heavy_rows)
        .select(F.unhex("t.item").alias("digest"))
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_heavy: int = 1000,
    heavy_rows: int = 100,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest original, then the smallest doc_id stays. Null text is
    empty, so null, empty and blank texts form one group. A null doc_id sorts last. Rows
    that repeat both text and doc_id count as rows of the group, and all of them carry
    kept = true if their doc_id wins. Other columns are ignored. An empty table gives an
    empty result.
    """
    table = stage(digests(docs, id_col, text_col), "digests")
    best = F.max_by("doc_id", F.struct("n_points", (-F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("r")))
    winners = (
        table.join(F.broadcast(heavy_digests(table, max_heavy, heavy_rows)), "digest", "left_semi")
        .groupBy("digest")
        .agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = stage(winners, "heavy")
    heavy = table.join(F.broadcast(winners), "digest").select("doc_id", "digest", "keep_id", "group_size")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    same = W.Window.partitionBy("digest")
    ranked = W.Window.partitionBy("digest").orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"))
    rest = rest.select(
        "doc_id",
        "digest",
        F.first("doc_id").over(ranked).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose doc_id exact_groups does not keep; all columns stay, and
    rows that repeat a kept doc_id stay with it."""
    keep = exact_groups(docs, **options).where("kept").select("doc_id").distinct()
    id_col = options.get("id_col", "doc_id")
    return docs.alias("all").join(keep.alias("keep"), F.col(f"all.{id_col}").eqNullSafe(F.col("keep.doc_id")), "left_semi")
