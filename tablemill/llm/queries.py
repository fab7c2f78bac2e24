"""The operators' queries, with production parameters over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, jaccard, lm, media, merkle, packing, quality, secrets, simhash, substring, tokencount, trie

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
#: The free id after a rank file's last; ends a document in flat token files.
END_OF_DOCUMENT = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, PATTERN, end_id=2, capacity=1024)


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.measure(_table(spark, sf_dir, "documents"), window=35)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"), order=3)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), MULTI_RANKS, PATTERN, END_OF_DOCUMENT)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(_table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_best_fit_packing, op2_byte_level_bpe, op3_ngram_jaccard_join, op4_substring_dedup, op5_lm_scoring, op6_secret_scans, op7_media_columns, op8_token_counts, op9_chat_formatting, op10_quality_rules, op11_merkle_manifest, op12_simhash_near_dedup, op13_conversation_prefix_trie, pipeline)
    return {f.__name__: f for f in own}


#: Links by shared shingles, then all that links reach.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 2], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_ AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least_.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_ ON least_.a = w.doc_id
"""

#: Windows of 35 words by their text, and the words that repeated ones cover.
SUBSTRING_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), twice AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM win WHERE h IN (SELECT h FROM twice))
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = x.r AND g.p = x.p) GROUP BY r
), lost AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.r = w.r LEFT JOIN lost ON lost.r = w.r
"""

#: Turns by text, escaped as the template escapes them; the probe conversation beside the table's.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, '<s>[ROLE]' || regexp_replace(role, '([\\<\[])', '\\\1', 'g') || '[/ROLE]' || CASE WHEN role = 'user' THEN '[INST] ' ELSE '' END
    || regexp_replace(text, '([\\<\[])', '\\\1', 'g') || CASE WHEN role = 'user' THEN ' [/INST]' ELSE '' END || '</s>' AS formatted FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: The counts, and every rule's verdict whatever the order of the cascade.
QUALITY_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT r, i, array_to_string(words[i:i + 2], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), twice AS (
  SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (r, g)) GROUP BY r
), f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM w LEFT JOIN covered ON covered.r = w.r
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words OR (n_lines > 5 AND 2 * n_dup_lines > n_lines) OR NOT word_chars BETWEEN 2 * n_words AND 25 * n_words OR 10 * n_letter_words < 6 * n_words AS rejected FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v
"""


#: CRC-32 of an integer's decimal digits, bit by bit.
_CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"


def _shown(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(map(_shown, ("doc_id", "source", "lang", chars, "text"))) + ")"


_UP = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"

#: Levels of every language's tree and of the tree over them; each row's steps, and its fold.
MERKLE_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_CRC.format('doc_id')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS claim FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l
), t AS (
  SELECT lang, 0 AS h, list(leaf ORDER BY place) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, h + 1, {_UP} FROM t WHERE len(nodes) > 1
), s AS (
  SELECT lang, h, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1
), u AS (
  SELECT 0 AS h, (SELECT list(subroot ORDER BY place) FROM s) AS nodes
  UNION ALL SELECT h + 1, {_UP} FROM u WHERE len(nodes) > 1
), steps AS (
  SELECT p.doc_id, p.place AS r, p.lang, t.h, xor(p.place >> t.h, 1) AS o, t.nodes FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang WHERE len(t.nodes) > 1
  UNION ALL SELECT p.doc_id, p.place, p.lang, s.h + u.h, xor(s.place >> u.h, 1), u.nodes FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang, u WHERE len(u.nodes) > 1
), paths AS (
  SELECT doc_id, r, lang, string_agg(coalesce(nodes[o + 1], ''), '' ORDER BY h) AS beside, list(CASE WHEN nodes[o + 1] IS NULL THEN '-' WHEN o % 2 = 0 THEN 'l' ELSE 'r' END || coalesce(nodes[o + 1], '') ORDER BY h) AS steps FROM steps GROUP BY ALL
), f AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(coalesce(beside, '')) AS proof_sha256,
    list_reduce([claim] || coalesce(steps, []), lambda x, y: sha256(CASE y[1] WHEN 'l' THEN y[2:] || x WHEN 'r' THEN x || y[2:] ELSE x END)) AS folded_root
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN paths ON paths.r = p.place AND paths.lang IS NOT DISTINCT FROM p.lang
)
SELECT *, folded_root = root AS verified FROM f
"""

#: Prefixes by the digests of their turns, and every node with all nodes below it.
TRIE_SQL = rf"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS label,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS words FROM conversations
), c AS (
  SELECT conv_id, {_CRC.format('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT conv_id, label, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d
  FROM (SELECT c.conv_id, 0 AS own, i, label, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, i, label, words FROM c JOIN o USING (conv_id) WHERE o.i > c.h)
), x AS (
  SELECT conv_id, d, words, string_agg(label, '') OVER (PARTITION BY conv_id ORDER BY d) AS seq FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c
), path AS (
  SELECT conv_id, d, words, md5(seq) AS node FROM x
), n AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words FROM path GROUP BY ALL
), up AS (
  SELECT DISTINCT a.d AS ad, a.node AS a, b.d AS bd, b.node AS b FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.d <= b.d
), sums AS (
  SELECT ad, a, count(*) FILTER (bd = ad + 1) AS n_children, count(*) FILTER (NOT EXISTS (SELECT 1 FROM up k WHERE k.ad = up.bd AND k.a = up.b AND k.bd = k.ad + 1)) AS n_leaves, sum((n.n - 1) * n.words) AS saved
  FROM up JOIN n ON n.d = bd AND n.node = b GROUP BY ALL
), ends AS (
  SELECT d, node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(d) AS d, arg_max(node, d) AS node FROM path GROUP BY conv_id) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums ON ad = n.d AND a = n.node LEFT JOIN up ON up.bd = n.d AND up.b = n.node AND up.ad = n.d - 1 LEFT JOIN n p ON p.d = up.ad AND p.node = up.a LEFT JOIN ends ON ends.d = n.d AND ends.node = n.node
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express in full; each other one is tested against a brute-force version."""
    return {"op3_ngram_jaccard_join": JACCARD_SQL, "op4_substring_dedup": SUBSTRING_SQL, "op9_chat_formatting": CHAT_SQL, "op10_quality_rules": QUALITY_SQL, "op11_merkle_manifest": MERKLE_SQL, "op13_conversation_prefix_trie": TRIE_SQL}
