"""Running sums, places and pointers along the ordered rows of a key, whatever a key's share.

Keys of ordinary size take a window. A key of more than ``most`` rows would be one task, so
its rows are dealt into ranges of their order (repartitionByRange: quantiles of a sample),
staged, and scanned at two levels: inside each range by a window, and over the ranges' sums,
of which a key has one for each range; the sums before a range are added to its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.staging import BROADCAST_BYTES, stage

#: Rows of a key from which on it is dealt into ranges.
MOST = 1_000_000


def hot_keys(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """The keys of more than most rows, staged; None if there are none."""
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key)
    return None if hot.isEmpty() else stage(hot, "hot_keys")


def ranged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with _range, the number of their range of (key, order), staged: rows of equal order
    lie in one range, and later ranges hold later rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def split(rows: DataFrame, hot: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the hot keys, and the others. There are as few hot keys as rows / most."""
    few = F.broadcast(hot) if hot.count() * 64 <= BROADCAST_BYTES else hot
    return rows.join(few, key, "left_semi"), rows.join(few, key, "left_anti")


def _local(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], total: dict[str, Column], number: str | None) -> DataFrame:
    line = W.partitionBy(*keys).orderBy(*order)
    before = line.rowsBetween(W.unboundedPreceding, -1)
    made = {name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()}
    made |= {name: F.sum(c).over(W.partitionBy(*keys)) for name, c in total.items()}
    if number:
        made[number] = (F.row_number().over(line) - 1).cast("long")
    return rows.withColumns(made)


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, total: dict[str, Column] | None = None, number: str | None = None, most: int = MOST, hot: DataFrame | bool | None = True) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over the earlier rows of the key (0
    for the first); for each of total, the key's sum; as number, the row's place from 0. order
    must tell a key's rows apart where that matters. A null key is a key like others. hot: what
    hot_keys() gave for these rows or more, where it is known (True: look)."""
    sums, total = sums or {}, total or {}
    hot = hot_keys(rows, key, most) if hot is True else hot
    if hot is None:
        return _local(rows, [key], order, sums, total, number)
    # null keys go with the others: what a left_semi join drops, the left_anti join keeps
    large, rest = split(rows, hot, key)
    large = ranged(large.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_t_{n}": c for n, c in total.items()}), key, order)
    per = large.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(f"_s_{n}").alias(f"_b_{n}") for n in sums), *(F.sum(f"_t_{n}").alias(f"_w_{n}") for n in total))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(
        key, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        *(F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.sum(f"_w_{n}").over(W.partitionBy(key)).alias(n) for n in total),
    )
    local = _local(large, [key, "_range"], order, {n: F.col(f"_s_{n}") for n in sums}, {}, number).join(offsets, [key, "_range"])
    made = {n: F.col(n) + F.col(f"_b_{n}") for n in sums} | ({number: F.col(number) + F.col("_rows")} if number else {})
    plain = _local(rest, [key], order, sums, total, number)
    return local.withColumns(made).select(*plain.columns).unionByName(plain)


def following(rows: DataFrame, key: str, at: str, targets: DataFrame, target: str) -> DataFrame:
    """rows with _next, the least target of the key (a column of targets) that is not before at;
    null where none is. Ranges as in running(), for all keys: the first target of each range is
    what rows of earlier ranges without one in their own fall back to."""
    marked = rows.withColumn("_at", F.col(at)).withColumn("_target", F.lit(None).cast("long")).withColumn("_row", F.lit(True))
    aims = targets.select(key, F.col(target).cast("long").alias("_at"), F.col(target).cast("long").alias("_target"), F.lit(False).alias("_row")).distinct()
    both = ranged(marked.unionByName(aims, allowMissingColumns=True), key, ["_at"])
    onward = W.partitionBy(key, "_range").orderBy(F.desc("_at"), F.col("_row"))  # targets stand before rows at the same place
    own = both.withColumn("_own", F.min("_target").over(onward.rowsBetween(W.unboundedPreceding, W.currentRow))).where("_row")
    least = both.where(~F.col("_row")).groupBy(key, "_range").agg(F.min("_target").alias("_least"))
    # a row's fallback is the least target of the next range of its key that has one
    spots = both.select(key, "_range").distinct().join(least, [key, "_range"], "left")
    later = F.min("_least").over(W.partitionBy(key).orderBy("_range").rowsBetween(1, W.unboundedFollowing))
    found = own.join(spots.select(key, "_range", later.alias("_later")), [key, "_range"], "left")
    return found.withColumn("_next", F.coalesce("_own", "_later")).drop("_at", "_target", "_row", "_range", "_own", "_least", "_later")


def reached(pointers: DataFrame, key: str, at: str, to: str, starts: DataFrame) -> DataFrame:
    """(key, at) of all that starts (key, at) lead to by following pointers (key, at -> to),
    themselves included, by pointer doubling: round k follows 2^k pointers at once, so
    a chain of n takes about log2(n) rounds however long."""
    jump = stage(pointers.select(key, F.col(at).alias("_from"), F.col(to).alias("_to")).where("_to is not null"), "pointers")
    held = stage(starts.select(key, F.col(at).alias("_at")).distinct(), "reached")
    while not jump.isEmpty():
        onward = held.join(jump.withColumnRenamed("_from", "_at"), [key, "_at"]).select(key, F.col("_to").alias("_at"))
        held = stage(held.unionByName(onward).distinct(), "reached")
        twice = jump.select(key, "_from", F.col("_to").alias("_mid")).join(jump.select(key, F.col("_from").alias("_mid"), "_to"), [key, "_mid"])
        jump = stage(twice.select(key, "_from", "_to"), "pointers")
    return held.withColumnRenamed("_at", at)
