"""Queries that publish tables and documents and read them back through their manifest, and that scan files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import scan
from tideline.operators import store as st
from tideline.operators.staging import shared_folder
from tideline.sources import adapters as ad
from tideline.sources import files, published

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, oracle
        return function

    return add


def _root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/published/{uuid.uuid4().hex}"


@query("k7_atomic_document", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def k7_atomic_document(spark: SparkSession, sf: str) -> DataFrame:
    """A small document that is replaced in one rename: first with one status, then with the counts of all."""
    path = f"{_root(spark)}/reports/status.json"
    counts = {r.o_orderstatus: r.n for r in ad.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).collect()}
    published.write_document(spark, path, json.dumps(dict(list(counts.items())[:1])))
    published.write_document(spark, path, json.dumps(counts))
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,long>")).alias("status", "n"))
    return found.select("status", "n")


@query("i4_published_tables", """SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(worth, 0) AS worth FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS worth FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def i4_published_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and their sums, published together; then the sums again without open orders. Readers join what the manifest names."""
    root, customers, orders = _root(spark), ad.table(spark, sf, "customer").select("c_custkey"), ad.table(spark, sf, "orders")
    sums = lambda rows: rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("worth"))
    sources = {"customer": (customers, published.summary(customers))}
    published.publish(spark, root, {"customers": customers, "sums": sums(orders)}, sources)
    published.publish(spark, root, {"sums": sums(orders.where("o_orderstatus <> 'P'"))}, sources)
    now = published.current(spark, root)
    joined = published.read(spark, root, "customers", now).join(published.read(spark, root, "sums", now), "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("worth", F.lit(0.0)).alias("worth"))


@query("x5_published_import", """WITH n AS (SELECT c_custkey AS id, c_name AS name, c_acctbal > 0 AS fresh FROM customer WHERE c_nationkey < 12 OR c_acctbal > 0)
SELECT 'episode' AS kind, count(*) AS n, max(id) AS last FROM n UNION ALL SELECT 'job', (SELECT count(*) FROM customer WHERE c_acctbal > 0), (SELECT max(c_custkey) FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'event', (SELECT count(*) FROM customer WHERE c_acctbal > 0) + 1, (SELECT count(*) FROM customer WHERE c_acctbal > 0)""")
def x5_published_import(spark: SparkSession, sf: str) -> DataFrame:
    """An import: episodes where they are absent, jobs replaced, an event for each with the next
    ordinals, all published as one version."""
    root, people = _root(spark), ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey", "c_acctbal")
    known, incoming = people.where("c_nationkey < 12").select("id", "name"), people.where("c_acctbal > 0").select("id", "name")
    jobs = incoming.where("id % 3 = 0").select("id", F.lit("QUEUED").alias("state"))
    events = spark.range(1).select(F.lit(0).cast("long").alias("ordinal"), F.lit("CREATED").alias("what"))
    published.publish(spark, root, {"episode": known, "job": jobs, "event": events})
    before = published.current(spark, root)
    read = lambda name: published.read(spark, root, name, before)
    done = incoming.select("id", F.lit("SUCCEEDED").alias("state"))
    following = read("event").agg(F.coalesce(F.max("ordinal"), F.lit(0)) + 1).first()[0]
    numbered = scan.running(incoming.withColumn("all", F.lit(0)), "all", ["id"], number="place").select((F.col("place") + following).alias("ordinal"), F.lit("IMPORTED").alias("what"))
    tables = {"episode": st.insert_absent(read("episode"), incoming, ["id"]), "job": st.upsert(read("job"), done, "id", ["state"]), "event": st.append(read("event"), numbered)}
    now = published.publish(spark, root, tables, {"customer": (people, published.summary(people))})
    told = [published.read(spark, root, name, now).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"), F.max(c).alias("last")) for name, c in (("episode", "id"), ("job", "id"), ("event", "ordinal"))]
    return told[0].unionByName(told[1]).unionByName(told[2])


#: The folder that the oracles of the file scans list: theirs is the one path that SQL can't take from a table.
FOLDER = "/root/testdata/sf0.01"


@query("s8_listed_files", f"SELECT parse_filename(filename) AS name, size AS bytes FROM read_blob('{FOLDER}/*.parquet')")
def s8_listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The Parquet files of the tables' folder and below; no content is read."""
    return files.listed(spark, sf, (".parquet",))


@query("s9_file_hashes", f"SELECT parse_filename(filename) AS name, size AS bytes, sha256(content) AS sha256 FROM read_blob('{FOLDER}/*.parquet')")
def s9_file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return files.hashed(spark, sf, (".parquet",))
