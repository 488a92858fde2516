"""The queries of the corpus operators, op<N>_<name>, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, exact_dedup, html_extract, language_crf, lexical_search, mixing, near_dedup, permutation_index, prefix_trie, quality_fm, suffix_dedup, suffix_tree_lm, toxicity_cnn
from tideline.llm._shared import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Token weights of the languages in op1's mix.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    return mixing.mix(docs, labelled, TARGETS)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _marks(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _marks(spark, sf_dir, "quality").where(crc_mod("doc_id", 3) != 1)
    scored = quality_fm.score(table(spark, sf_dir, "documents"), labels, metadata=("n_chars",))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = language_crf.label_languages(table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) != 1)
    return labelled.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_switches")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_cnn.score(table(spark, sf_dir, "documents"), _marks(spark, sf_dir, "toxic").where(crc_mod("doc_id", 5) != 0))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree_lm.score(table(spark, sf_dir, "documents"), ~suffix_tree_lm.held_out())
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", (F.col("train") == 0).alias("held_out"), *columns)


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_soft_mixing": op1_soft_mixing,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_fm": op3_quality_fm,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_crf": op5_language_crf,
    "op6_html_extract": op6_html_extract,
    "op7_toxicity_cnn": op7_toxicity_cnn,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_superminhash": op10_superminhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_permutation_index": op13_permutation_index,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM it, unnest(range(1, greatest(1, len(w) - 12) + 1)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY c DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
""",
    "op11_prefix_trie": r"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
             FROM conversations WHERE conv_id IS NOT NULL),
shared AS (SELECT DISTINCT c, c - c % 20 AS base,  -- crc32 of the id in decimal, eight bits a byte
                  xor(4294967295, list_reduce(list_prepend(4294967295, [ord(x) for x in string_split(c::VARCHAR, '')]),
                      lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, k: xor(z >> 1, 3988292384 * (z & 1))))) % 4 AS h
           FROM own),
made AS (SELECT s.c, 0 AS part, o.i, o.role, o.text FROM shared s JOIN own o ON o.c = s.base AND o.i <= s.h
         UNION ALL SELECT s.c, 1, o.i, o.role, o.text FROM shared s JOIN own o ON o.c = s.c AND o.i > s.h),
turns AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM made),
step AS (SELECT c, d, text, array_agg(sha256(length(role)::VARCHAR || ' ' || role || text)) OVER (PARTITION BY c ORDER BY d) AS path FROM turns),
member AS (SELECT c, d, sha256(array_to_string(path, ' ')) AS node, sha256(array_to_string(path[:d - 1], ' ')) AS up,
                  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM step
           UNION ALL SELECT c, 0, sha256(''), NULL, 0 FROM shared),
lengths AS (SELECT c, max(d) AS last FROM member GROUP BY 1),
node AS (SELECT d, node, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(words) AS words,
                coalesce(string_agg(CASE WHEN d = last THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends
         FROM member JOIN lengths USING (c) GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, node)),
below AS (SELECT DISTINCT a.d, a.node, b.d AS bd, b.node AS bnode FROM member a JOIN member b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT below.d, below.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * words)::BIGINT AS saved_tokens
         FROM below JOIN whole ON whole.d = bd AND whole.node = bnode GROUP BY 1, 2)
SELECT whole.conv_id, whole.d::BIGINT AS depth, up.conv_id AS parent_conv_id, whole.n AS n_convs, whole.n_children, n_leaves, saved_tokens, sha256(whole.ends) AS ends_sha256
FROM whole JOIN sums ON sums.d = whole.d AND sums.node = whole.node LEFT JOIN node up ON up.d = whole.d - 1 AND up.node = whole.up
""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN df USING (term) JOIN tf USING (term), corpus GROUP BY 1, 2, 3),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
""",
}
