"""A revisioned store on Parquet: upserts, insert-if-absent, scoped deletes, constraint
checks and checkpoint validity, each as a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def append(current: DataFrame, rows: DataFrame) -> DataFrame:
    """rows behind those of current; columns are matched by name."""
    return current.unionByName(rows)


def upsert(current: DataFrame, changes: DataFrame, key: str, updates: list[str]) -> DataFrame:
    """Rows of changes replace the named columns of current rows with their key; new keys are added."""
    marked = current.withColumn("_v", F.lit(0)).unionByName(changes.withColumn("_v", F.lit(1)))
    line = W.partitionBy(key).orderBy("_v")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last, first = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_v"))), {c: F.first(c).over(whole) for c in current.columns if c not in (key, *updates)}
    return marked.select(key, *[F.col(c) if c in updates else first[c].alias(c) for c in current.columns if c != key], last.alias("_k")).where("_k = 1").select(*current.columns)


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_unlinked(rows: DataFrame, links: DataFrame, key: str, scope: Column) -> DataFrame:
    """rows without those in scope that no link names."""
    return rows.where(~scope).unionByName(rows.where(scope).join(links.select(key), key, "left_semi"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys), keys, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, key) for each row and rule that is broken (or can't be told)."""
    hits = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(hits).alias("rule"), F.col(key).cast("string").alias("key"))


def assert_empty(found: DataFrame, what: str) -> None:
    """Raises where the reference would: at the first violation."""
    row = found.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def valid_checkpoints(checkpoints: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Each checkpoint with valid: as many artifacts as declared, all of declared size and hash."""
    good = artifacts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bool_and((F.col("sha") == F.col("declared_sha")) & (F.col("size") == F.col("declared_size"))).alias("_ok"))
    joined = checkpoints.join(good, key, "left")
    return joined.withColumn("valid", F.coalesce((F.col("_n") == F.col("n_artifacts")) & F.col("_ok"), F.lit(False))).drop("_n", "_ok")
