"""Queries that hold documents against the published schemas, all failures collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import schemas as S
from tideline.sources import adapters as ad

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str):
    def add(function):
        QUERIES[name], ORACLES[name] = function, oracle
        return function

    return add


def event_documents(spark: SparkSession, sf: str) -> DataFrame:
    sent = F.struct(F.col("event_type").alias("type"), "value", F.col("user_id").alias("user"), F.from_json("props", "k bigint").alias("props"))
    return ad.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.to_json(sent).alias("doc"))


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their items in order; a note is missing where there is no discount, a tax is told where it is high."""
    line = ad.table(spark, sf, "lineitem")
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    note, tax = F.when(F.col("l_discount") > 0, F.col("l_linestatus")), F.when(F.col("l_tax") > 0.07, F.col("l_tax"))
    clip = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), note.alias("note"), tax.alias("tax"))
    held = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(*keys, clip.alias("clip")))).alias("c")).select("o_orderkey", F.col("c.clip").alias("clips"))
    docs = ad.table(spark, sf, "orders").join(held, "o_orderkey", "left")
    empty = F.coalesce("clips", F.slice("clips", 1, 0), F.from_json(F.lit("[]"), held.schema["clips"].dataType))
    whole = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), empty.alias("clips"))
    return docs.select(F.col("o_orderkey").alias("id"), F.to_json(whole).alias("doc"))


def conversation_documents(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    held = ad.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("t"))
    whole = F.struct("id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return held.select("id", F.to_json(whole).alias("doc"))


DOCUMENTS = {"event": event_documents, "order": order_documents, "conversation": conversation_documents}
_EVENT = """SELECT event_id AS id, t.* FROM events, (SELECT (props::JSON->>'k')::BIGINT AS k, event_id AS e FROM events) j,
LATERAL (SELECT unnest(['$.type', '$.value', '$.value', '$.user', '$.props.k', '$.props.k', '$.props.k']) AS path,
    unnest(['enum', 'exclusiveMinimum', 'maximum', 'minimum', 'minimum', 'maximum', 'multipleOf']) AS rule,
    unnest([event_type NOT IN ('click', 'view', 'purchase', 'signup'), value <= 0.5, value > 60, user_id < 1, k < 5, k > 90, k % 3 <> 0]) AS bad) t WHERE e = event_id AND bad""".replace("t.* FROM", "path, rule FROM")
_ORDER = r"""SELECT o.id, path, rule FROM (
WITH l AS (SELECT *, CASE WHEN l_discount > 0 THEN l_linestatus END AS note, CASE WHEN l_tax > 0.07 THEN l_tax END AS tax,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_discount, l_tax) - 1 AS i FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT concat_ws('|', l_linenumber, l_quantity, l_returnflag, coalesce(note, '-'), coalesce(tax, -1))) AS kinds FROM l GROUP BY 1),
head AS (SELECT o_orderkey AS id, unnest(['$.status', '$.priority', '$.priority', '$.clips', '$.clips', '$.clips']) AS path, unnest(['const', 'minLength', 'pattern', 'minItems', 'maxItems', 'uniqueItems']) AS rule,
    unnest([o_orderstatus <> 'F', length(o_orderpriority) < 6, NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+'), coalesce(n, 0) < 2, coalesce(n, 0) > 6, coalesce(kinds <> n, false)]) AS bad
    FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
item AS (SELECT l_orderkey AS id, '$.clips[' || i || ']' || unnest(['', '.line', '.qty', '.flag', '.tax']) AS path, unnest(['required:note', 'exclusiveMaximum', 'maximum', 'enum', 'type']) AS rule,
    unnest([note IS NULL, l_linenumber >= 7, l_quantity > 45, l_returnflag NOT IN ('A', 'N'), tax IS NOT NULL]) AS bad FROM l JOIN orders ON o_orderkey = l_orderkey)
SELECT * FROM head WHERE bad UNION ALL SELECT * FROM item WHERE bad) o"""
_CONVERSATION = r"""SELECT id, path, rule FROM (
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) - 1 AS i FROM conversations),
head AS (SELECT conv_id AS id, unnest(['$.id', '$.turns']) AS path, unnest(['minimum', 'minItems']) AS rule, unnest([conv_id < 10, count(*) < 4]) AS bad FROM t GROUP BY conv_id),
item AS (SELECT conv_id AS id, '$.turns[' || i || ']' || unnest(['.role', '.text', '.text']) AS path, unnest(['enum', 'minLength', 'pattern']) AS rule,
    unnest([role NOT IN ('user', 'assistant'), length(text) < 300, NOT regexp_matches(text, '[.!?]')]) AS bad FROM t)
SELECT * FROM head WHERE bad UNION ALL SELECT * FROM item WHERE bad)"""
SQL = {"event": _EVENT, "order": _ORDER, "conversation": _CONVERSATION}


def _broken(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return S.violations(DOCUMENTS[name](spark, sf), "doc", S.load(name), "id")


@query("v1_schema_rules", _EVENT)
def v1_schema_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Events, sent as JSON, against their schema."""
    return _broken(spark, sf, "event")


@query("v1_order_documents", _ORDER)
def v1_order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their items as nested documents against their schema: arrays, a $ref for each item, additional fields by type."""
    return _broken(spark, sf, "order")


@query("v1_conversation_documents", _CONVERSATION)
def v1_conversation_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(spark, sf, "conversation")


@query("v2_referred_rules", f"SELECT schema, path, rule, count(*) AS n FROM (SELECT 'event' AS schema, path, rule FROM ({_EVENT}) WHERE starts_with(path, '$.props.k') UNION ALL SELECT 'order', regexp_replace(path, '\\[\\d+\\]', '[*]', 'g'), rule FROM ({_ORDER}) WHERE contains(path, '[')) GROUP BY ALL")
def v2_referred_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule behind a $ref is broken, by its place in the schema; every published schema is checked first."""
    for name in S.names():
        S.check(S.load(name), name)
    place = F.regexp_replace("path", r"\[\d+\]", "[*]")
    event = _broken(spark, sf, "event").where(F.col("path").startswith("$.props.k")).select(F.lit("event").alias("schema"), "path", "rule")
    order = _broken(spark, sf, "order").where(F.col("path").contains("[")).select(F.lit("order").alias("schema"), place.alias("path"), "rule")
    return event.unionByName(order).groupBy("schema", "path", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("s14_schema_registry", " UNION ALL ".join(f"SELECT '{n}' AS schema, (SELECT count({'DISTINCT conv_id' if n == 'conversation' else '*'}) FROM {t}) AS documents, count(DISTINCT id) AS invalid, count(*) AS broken FROM ({SQL[n]})" for n, t in (("event", "events"), ("order", "orders"), ("conversation", "conversations"))))
def s14_schema_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Each published schema with the documents that it speaks of, how many break it, and how many rules are broken."""
    each = []
    for name in S.names():
        n = DOCUMENTS[name](spark, sf).agg(F.lit(name).alias("schema"), F.count(F.lit(1)).alias("documents"))
        bad = _broken(spark, sf, name).agg(F.lit(name).alias("schema"), F.count_distinct("id").alias("invalid"), F.count(F.lit(1)).alias("broken"))
        each.append(n.join(bad, "schema"))
    return reduce(DataFrame.unionByName, each)
