"""Queries over artifacts and the store: hashes, keys, upserts, constraints, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import store as st
from tideline.sources import adapters as ad

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "documents")


def _s(c: str):
    return F.col(c).cast("string")


@query("h1_content_hash", "SELECT doc_id, sha256(lang || chr(0) || source || chr(0) || n_chars || chr(0)) AS h FROM documents")
def h1_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.content_hash(F.col("lang"), F.col("source"), _s("n_chars")).alias("h"))


@query("h2_cache_key", "SELECT doc_id, sha256('p' || chr(0) || '1' || chr(0) || coalesce(nullif(lang, 'en'), '-') || chr(0) || source || chr(0)) AS h FROM documents")
def h2_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.lit("-"))
    return _docs(spark, sf).select("doc_id", T.content_hash(F.lit("p"), F.lit("1"), lang, F.col("source")).alias("h"))


@query("h3_config_hash", "SELECT doc_id, sha256(sha256(text) || chr(0) || 'lang=' || lang || chr(0) || 'source=' || source || chr(0)) AS h FROM documents")
def h3_config_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.content_hash(F.sha2("text", 256), F.concat(F.lit("lang="), F.col("lang")), F.concat(F.lit("source="), F.col("source"))).alias("h"))


@query("h7_sub_key", "SELECT doc_id, sha256(lang || chr(0) || source) AS h FROM documents")
def h7_sub_key(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.pair_hash(F.col("lang"), F.col("source")).alias("h"))


@query("h8_fingerprint", "SELECT doc_id, left(sha256(concat_ws('|', lang, source, n_chars)), 20) AS f FROM documents")
def h8_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.fingerprint("|", 20, F.col("lang"), F.col("source"), _s("n_chars")).alias("f"))


@query("h9_sha_valid", "SELECT doc_id, regexp_matches(lower(trim(h)), '^[0-9a-f]{64}$') AS valid FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ' || upper(sha256(source)) WHEN 1 THEN left(sha256(source), 63) ELSE sha256(source) END AS h FROM documents)")
def h9_sha_valid(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.sha2("source", 256)
    h = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper(sha))).when(F.col("doc_id") % 3 == 1, F.substring(sha, 1, 63)).otherwise(sha)
    return _docs(spark, sf).select("doc_id", F.lower(F.trim(h)).rlike("^[0-9a-f]{64}$").alias("valid"))


@query("m10_stable_seed", "SELECT doc_id, ('0x' || left(sha256(source || doc_id), 8))::BIGINT AS seed FROM documents")
def m10_stable_seed(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.stable_seed(F.concat(F.col("source"), _s("doc_id"))).alias("seed"))


@query("s9_content_hashes", "SELECT doc_id, sha256(text) AS sha, length(text) AS n FROM documents")
def s9_content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))


@query("s1_key_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def s1_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "orders").where("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_totalprice")


@query("s3_parents_with_children", """SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey), '') AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def s3_parents_with_children(spark: SparkSession, sf: str) -> DataFrame:
    orders = ad.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"))
    joined = ad.table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce(F.array_join(F.transform("o", lambda x: x["o_orderkey"].cast("string")), ","), F.lit("")).alias("orders"))


@query("s5_json_column", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def s5_json_column(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("s6_loose_json", """SELECT event_id, (regexp_extract(raw, '\\{.*\\}')::JSON->>'k')::BIGINT AS k FROM (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'text ```json ' || props || ' ``` end' ELSE 'so: ' || props || ' ok' END AS raw FROM events)""")
def s6_loose_json(spark: SparkSession, sf: str) -> DataFrame:
    """An object out of a fenced block, or else between the outermost braces."""
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("text ```json "), F.col("props"), F.lit(" ``` end"))).otherwise(F.concat(F.lit("so: "), F.col("props"), F.lit(" ok")))
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return ad.table(spark, sf, "events").select("event_id", F.from_json(F.when(fenced != "", fenced).otherwise(loose), "k bigint")["k"].alias("k"))


@query("j1_equi_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def j1_equi_join(spark: SparkSession, sf: str) -> DataFrame:
    lines = ad.table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    return lines.join(ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@query("j7_last_artifact", "SELECT l_partkey, arg_max(l_orderkey * 10 + l_linenumber, (l_returnflag, l_orderkey * 10 + l_linenumber)) AS artifact FROM lineitem GROUP BY 1")
def j7_last_artifact(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return ad.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max_by(key, F.struct("l_returnflag", key)).alias("artifact"))


@query("j14_declared_summary", "SELECT o_orderkey, o.n AS declared, l.n AS found FROM (SELECT o_orderkey, 1 + o_orderkey % 4 AS n FROM orders) o FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o.n IS DISTINCT FROM l.n AND o_orderkey IS NOT NULL")
def j14_declared_summary(spark: SparkSession, sf: str) -> DataFrame:
    declared = ad.table(spark, sf, "orders").select("o_orderkey", (F.lit(1) + F.col("o_orderkey") % 4).alias("declared"))
    found = ad.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("found"))
    return declared.join(found, "o_orderkey", "left").where(~F.col("declared").eqNullSafe(F.col("found"))).select("o_orderkey", "declared", "found")


_CHANGES = "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, 0.0::DOUBLE AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N', 1.0::DOUBLE FROM orders WHERE o_orderkey % 100 = 1"


@query("k2_upsert", f"""WITH c AS ({_CHANGES}) SELECT o_orderkey, o_custkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_totalprice FROM orders o LEFT JOIN c USING (o_orderkey, o_custkey)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM c WHERE o_orderkey < 0""")
def k2_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Only the status of a known order changes; new orders are added whole."""
    now = ad.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = now.where("o_orderkey % 10 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})
    new = now.where("o_orderkey % 100 = 1").select((F.lit(-1) - F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return st.upsert(now, changed.unionByName(new), "o_orderkey", ["o_orderstatus"])


@query("k3_insert_if_absent", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def k3_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    people = ad.table(spark, sf, "customer").select("c_custkey", "c_name")
    return st.insert_absent(people.where("c_custkey % 2 = 0"), people.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("k4_update_by_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'PAUSED' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def k4_update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return st.update_where(ad.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") % 7 == 3, {"o_orderstatus": F.lit("PAUSED")})


@query("k5_delete_by_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority <> '5-LOW'")
def k5_delete_by_scope(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_custkey")


@query("k6_delete_unlinked", "SELECT p_partkey FROM part WHERE NOT p_type = 'ECONOMY' OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def k6_delete_unlinked(spark: SparkSession, sf: str) -> DataFrame:
    links = ad.table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return st.delete_unlinked(ad.table(spark, sf, "part").select("p_partkey", "p_type"), links, "p_partkey", F.col("p_type") == "ECONOMY").select("p_partkey")


@query("v12_constraint_checks", """SELECT 'quantity' AS rule, l_orderkey::VARCHAR AS key FROM lineitem WHERE NOT l_quantity <= 49 UNION ALL SELECT 'discount', l_orderkey::VARCHAR FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09::DOUBLE
UNION ALL SELECT 'line', l_orderkey::VARCHAR FROM lineitem WHERE NOT l_linenumber >= 1""")
def v12_constraint_checks(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"quantity": F.col("l_quantity") <= 49, "discount": F.col("l_discount").between(0, 0.09), "line": F.col("l_linenumber") >= 1}
    return st.violations(ad.table(spark, sf, "lineitem"), rules, "l_orderkey")


@query("v12_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v12_unique_keys(spark: SparkSession, sf: str) -> DataFrame:
    return st.duplicate_keys(ad.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v13_foreign_keys", """SELECT 'line' AS child, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def v13_foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: ad.table(spark, sf, n)
    pairs = [
        ("line", t("lineitem").select(F.col("l_orderkey").alias("k")), t("orders").select(F.col("o_orderkey").alias("k"))),
        ("order", t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k"))),
        ("label", t("labels").select(F.col("doc_id").alias("k")), t("documents").select(F.col("doc_id").alias("k"))),
    ]
    counts = [st.orphans(c, p, ["k"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("child"), "n") for n, c, p in pairs]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("i1_checkpoint_validity", """WITH a AS (SELECT source, sha256(text) AS sha, length(text) AS size, CASE WHEN doc_id % 97 = 5 THEN 'bad' ELSE sha256(text) END AS dsha, n_chars AS dsize FROM documents)
SELECT source, bool_and(sha = dsha AND size = dsize) AND count(*) = (SELECT count(*) FROM documents d WHERE d.source = a.source) AS valid FROM a GROUP BY 1""")
def i1_checkpoint_validity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    sha = F.sha2("text", 256)
    artifacts = docs.select("source", sha.alias("sha"), F.length("text").alias("size"), F.when(F.col("doc_id") % 97 == 5, "bad").otherwise(sha).alias("declared_sha"), F.col("n_chars").alias("declared_size"))
    declared = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_artifacts"))
    return st.valid_checkpoints(declared, artifacts, "source").select("source", "valid")


@query("i5_revision_lookup", "SELECT DISTINCT lang, sha256(lang || chr(0) || source || chr(0)) AS revision FROM documents")
def i5_revision_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("lang", T.content_hash(F.col("lang"), F.col("source")).alias("revision")).distinct()


@query("i8_uncached_work", "SELECT doc_id FROM documents WHERE left(sha256(source || '|' || doc_id), 20) NOT IN (SELECT left(sha256(source || '|' || doc_id), 20) FROM documents WHERE doc_id % 3 = 0)")
def i8_uncached_work(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _docs(spark, sf).select("doc_id", T.fingerprint("|", 20, F.col("source"), _s("doc_id")).alias("k"))
    return keyed.join(keyed.where("doc_id % 3 = 0").select("k"), "k", "left_anti").select("doc_id")


@query("g1_counts_by_scope", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def g1_counts_by_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("g18_distinct_revisions", "SELECT lang AS revision FROM documents UNION SELECT source FROM documents UNION SELECT event_type FROM events")
def g18_distinct_revisions(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return docs.select(F.col("lang").alias("revision")).union(docs.select("source")).union(ad.table(spark, sf, "events").select("event_type")).distinct()


@query("u3_unknown_keys", "SELECT event_id, len(list_filter(json_keys(props), lambda k: k NOT IN ('a', 'b'))) AS n_unknown FROM events")
def u3_unknown_keys(spark: SparkSession, sf: str) -> DataFrame:
    unknown = F.array_except(F.json_object_keys("props"), F.array(F.lit("a"), F.lit("b")))
    return ad.table(spark, sf, "events").select("event_id", F.size(unknown).cast("long").alias("n_unknown"))


@query("u5_set_equality", """SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O', 'P'] AS complete FROM orders GROUP BY 1""")
def u5_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    want = F.array(*[F.lit(x) for x in "FOP"])
    seen = F.collect_set("o_orderstatus")
    return ad.table(spark, sf, "orders").groupBy("o_custkey").agg(((F.size(F.array_except(seen, want)) == 0) & (F.size(F.array_except(want, seen)) == 0)).alias("complete"))


@query("x1_cut_times", r"""SELECT conv_id, t AS cut_ms FROM (SELECT conv_id, unnest(list_distinct(list_transform(regexp_extract_all(log, 'pts_time:([0-9]+(?:\.[0-9]+)?)', 1), lambda x: round_even(x::DOUBLE * 1000, 0)::BIGINT))) AS t
FROM (SELECT conv_id, string_agg('n:' || turn || ' pts_time:' || (turn * 1.25::DOUBLE) || ' pos', chr(10)) AS log FROM conversations GROUP BY 1)) WHERE t > 0""")
def x1_cut_times(spark: SparkSession, sf: str) -> DataFrame:
    log = F.concat(F.lit("n:"), _s("turn"), F.lit(" pts_time:"), (F.col("turn") * F.lit(1.25)).cast("string"), F.lit(" pos"))
    logs = ad.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(log), "\n").alias("log"))
    times = F.transform(F.regexp_extract_all("log", F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.bround(x.cast("double") * 1000).cast("long"))
    return logs.select("conv_id", F.explode(F.array_distinct(times)).alias("cut_ms")).where("cut_ms > 0")


@query("x14_free_name", "WITH used AS (SELECT DISTINCT o_custkey, 1 + o_orderkey % 6 AS v FROM orders) SELECT o_custkey, (SELECT min(n) FROM range(1, 8) t(n) WHERE n NOT IN (SELECT v FROM used u WHERE u.o_custkey = x.o_custkey)) AS free FROM (SELECT DISTINCT o_custkey FROM used) x")
def x14_free_name(spark: SparkSession, sf: str) -> DataFrame:
    used = ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.lit(1) + F.col("o_orderkey") % 6).alias("v"))
    return used.select("o_custkey", F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long")), "v")).alias("free"))


@query("w15_recent_ten", "SELECT user_id, event_type, last_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_us DESC, event_type) AS k FROM (SELECT user_id, event_type, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2)) WHERE k <= 3")
def w15_recent_ten(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    last = ad.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(micros).alias("last_us"))
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last_us"), "event_type"))
    return last.withColumn("k", k).where("k <= 3").select("user_id", "event_type", "last_us")
