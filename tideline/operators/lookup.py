"""Names that contain a wanted text, by an inverted index of grams: no wanted text meets all names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the longest grams.
GRAM = 3


def _grams(name: Column, n: int | Column) -> Column:
    last = F.length(name) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(name, i, F.lit(n) if isinstance(n, int) else n))))


def only_containing(wanted: DataFrame, files: DataFrame, needle: str, name: str, file: str, n: int = GRAM) -> DataFrame:
    """(needle, file) of each distinct needle that exactly one of files has in its name. Names and
    needles are compared as they are. Each needle probes the index with its rarest gram
    (of its own length, if it is shorter than n), and what comes back is held against the
    whole needle. A null or empty needle is in no name; files of one name count each."""
    named = files.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.min(file).alias("_file"), F.count(F.lit(1)).alias("_n"))
    asked = wanted.where(F.col(needle).isNotNull() & (F.length(needle) > 0)).select(F.col(needle).alias("_needle")).distinct()
    index = named.select("_name", F.explode(F.flatten(F.array_compact(F.array(*(_grams(F.col("_name"), k) for k in range(1, n + 1)))))).alias("_gram"))
    often = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    probes = asked.select("_needle", F.explode(_grams(F.col("_needle"), F.least(F.lit(n), F.length("_needle")))).alias("_gram"))
    counted = probes.join(often, "_gram", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("_often"), "_gram")).alias("_rare"))
    rare = counted.where("_rare._often > 0").select("_needle", F.col("_rare._gram").alias("_gram"))
    found = rare.join(index, "_gram").where(F.contains("_name", "_needle")).join(named, "_name")
    one = found.groupBy("_needle").agg(F.sum("_n").alias("_n"), F.min("_file").alias("_file")).where("_n = 1")
    return one.select(F.col("_needle").alias(needle), F.col("_file").alias(file))


def only_named(files: DataFrame, name: str, file: str) -> DataFrame:
    """(name, file) of the names that exactly one of files has."""
    return files.groupBy(name).agg(F.min(file).alias(file), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
