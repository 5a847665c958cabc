"""The registered queries of this package: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.llm import decontam, filter_audit, html_crf, langid, mixing, packing, pii, prefix_trie, quality, sharding, simhash, suffix_tree, token_counts
from convspark.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
SHARD_BYTES = 32 << 20


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)]
    both = F.array_sort(F.concat("base", "learned"))
    digest = F.sha2(pii.spelled(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.spelled(both).alias("spans"), F.size("learned").cast("long").alias("n_learned"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return sharding.shard(docs, SHARD_BYTES, columns=("doc_id",))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, folder, "documents"), TOKENIZER, TOKEN_LIMIT)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_crf.extract(read_table(spark, folder, "pages"))


def op7_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score_documents(read_table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(read_table(spark, folder, "documents"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(read_table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), TOKENIZER, packing.Rules(capacity=TOKEN_LIMIT))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_sharding,
        op3_simhash,
        op4_token_counts,
        op5_decontamination,
        op6_html_text,
        op7_suffix_tree,
        op8_quality,
        op9_language,
        op10_mixing,
        op11_packing,
        op12_filter_audit,
        op13_prefix_trie,
    )
}

#: What SQL can state. The others are tested against brute force, the library or held-out texts (tests/llm).
ORACLE: dict[str, str] = {
    "op2_sharding": f"""
WITH keyed AS (
  SELECT doc_id, COALESCE(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 8))::BIGINT AS bits FROM documents
), nodes AS (
  SELECT d.depth, (k.bits >> (32 - d.depth)::INTEGER) AS prefix, SUM(k.n_bytes) AS bytes, COUNT(*) AS documents
  FROM keyed k, range(0, 33) AS d(depth) GROUP BY ALL
), shards AS (
  SELECT n.* FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
  WHERE (n.bytes <= {SHARD_BYTES} OR n.documents = 1) AND (n.depth = 0 OR (p.bytes > {SHARD_BYTES} AND p.documents > 1))
)
SELECT k.doc_id, k.n_bytes,
  CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.prefix), s.depth::INTEGER, '0') END AS shard_id,
  s.depth::INTEGER AS shard_depth, s.bytes::BIGINT AS shard_bytes
FROM keyed k JOIN shards s ON (k.bits >> (32 - s.depth)::INTEGER) = s.prefix
""",
    "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t,
    list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), judged AS (
  SELECT doc_id, MAX((quality = 1)::INT) AS good, MAX((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic, map(['A', 'B', 'C', 'D', 'E'], [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    COALESCE(MIN(doc_id) OVER (PARTITION BY t) < texts.doc_id, false)]) AS fails
  FROM texts LEFT JOIN judged USING (doc_id)
), masks AS (
  SELECT part, fails, COUNT(*) AS n, SUM(good) AS n_good, SUM(toxic) AS n_toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, s::INT AS step, substr(filter_order, s, 1) AS letter, string_split(substr(filter_order, 1, s - 1), '') AS earlier
  FROM orders, range(1, 6) r(s)
), marked AS (
  SELECT part, filter_order, step, letter, n, n_good, n_toxic, fails[letter] AS now,
    len(list_filter(earlier, lambda x: x <> '' AND fails[x])) > 0 AS gone,
    len(list_filter(map_values(fails), lambda f: f)) = 1 AS one
  FROM masks, steps
), counted AS (
  SELECT part, filter_order, step, letter,
    SUM(CASE WHEN NOT gone AND NOT now THEN n ELSE 0 END)::BIGINT AS kept,
    SUM(CASE WHEN NOT gone AND now THEN n ELSE 0 END)::BIGINT AS removed,
    SUM(CASE WHEN gone AND now THEN n ELSE 0 END)::BIGINT AS redundant,
    SUM(CASE WHEN now AND one THEN n ELSE 0 END)::BIGINT AS unique_fails,
    SUM(CASE WHEN NOT gone AND now THEN n_good ELSE 0 END)::BIGINT AS good_lost,
    SUM(CASE WHEN NOT gone AND now THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM marked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (SUM(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, list({'role': COALESCE(role, ''), 'text': COALESCE(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), shares AS (
  SELECT conv_id, turns, (xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))
  ), 4294967295) % 9)::BIGINT AS h FROM own
), rebuilt AS (
  SELECT s.conv_id, list_concat(COALESCE(f.turns, [])[1:s.h], s.turns[s.h + 1:]) AS path
  FROM shares s LEFT JOIN own f ON f.conv_id = s.conv_id - s.conv_id % 5
), prefixes AS (
  SELECT conv_id, path[1:d] AS node, d AS depth, d = len(path) AS ends FROM rebuilt, range(0, len(path) + 1) r(d)
), nodes AS (
  SELECT node, depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
    sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), family AS (
  SELECT node[1:depth - 1] AS parent, COUNT(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, COALESCE(f.n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN family f ON f.parent = n.node
), below AS (
  SELECT node[1:d] AS top, SUM((n_children = 0)::BIGINT)::BIGINT AS n_leaves, SUM(saved)::BIGINT AS saved_tokens
  FROM full_nodes, range(0, depth + 1) r(d) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.top = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
""",
}
