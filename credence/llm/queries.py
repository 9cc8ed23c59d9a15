"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from credence.llm import decontamination, importance, lexical, neardup, packing, pii, pitman_yor, prefix_trie, rules, subwords, warc, wordpiece, wrappers
from credence.plans.registry import Registry
from credence.session import run_dir

R = Registry()


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@R.add("op2_vector_packing")
def op2_vector_packing(spark, folder):
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@R.add("op6_importance_resampling")
def op6_importance_resampling(spark, folder):
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@R.add("op7_wordpiece_counts")
def op7_wordpiece_counts(spark, folder):
    vocabulary = wordpiece.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return wordpiece.token_counts(_table(spark, folder, "documents"), vocabulary)


@R.add("op8_edit_decontamination")
def op8_edit_decontamination(spark, folder):
    return decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@R.add("op10_weighted_minhash")
def op10_weighted_minhash(spark, folder):
    return neardup.near_duplicates(_table(spark, folder, "documents"))


@R.add("op3_decision_lists")
def op3_decision_lists(spark, folder):
    return rules.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@R.add("op5_checked_spans")
def op5_checked_spans(spark, folder):
    return pii.digest(_table(spark, folder, "documents"))


@R.add("op4_host_wrappers")
def op4_host_wrappers(spark, folder):
    return wrappers.extract(_table(spark, folder, "pages"))


@R.add("op9_warc_chains")
def op9_warc_chains(spark, folder):
    path = run_dir(spark, "archives")
    warc.write_archives(_table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path)


@R.add("op1_pitman_yor")
def op1_pitman_yor(spark, folder):
    return pitman_yor.score_documents(_table(spark, folder, "documents"))


@R.add("op13_sentencepiece_rounds")
def op13_sentencepiece_rounds(spark, folder):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return subwords.digest(subwords.decode(subwords.encode(_table(spark, folder, "documents"), model), model))


#: The ASCII characters that are in no term, as a class of DuckDB's regular expressions.
_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@R.add("op12_pair_maxscore", f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_FOLDED_SQL}, '{_TERM_SQL}') AS terms FROM documents),
dt AS (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT k, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM dt GROUP BY k, term),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, total),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_FOLDED_SQL}, '{_TERM_SQL}') AS terms FROM benchmark),
bt AS (SELECT q, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM b) GROUP BY q, term),
s AS (SELECT q, k, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
  sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM bt JOIN tf USING (term) JOIN w USING (term), total GROUP BY q, k),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""")
def op12_pair_maxscore(spark, folder):
    return lexical.rank(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


#: CRC-32 of the decimal text of conv_id, a byte and a bit at a time.
_CRC_SQL = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
    "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, _: xor(r >> 1, 3988292384 * (r & 1)))))"
)


@R.add("op11_prefix_trie", f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 32)) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS family, {_CRC_SQL} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT h.conv_id, t.k, 0 AS own, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.family AND t.k <= h.h
  UNION ALL SELECT h.conv_id, t.k, 1, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d, sha256(concat(length(role), ':', role, text)) AS key, length(text) AS size FROM parts),
prefixes AS (SELECT conv_id, d, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, size FROM placed UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
last AS (SELECT conv_id, max(d) AS len FROM prefixes GROUP BY conv_id),
nodes AS (SELECT path, any_value(p.d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(p.size) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE p.d = l.len) AS ends
  FROM prefixes p JOIN last l USING (conv_id) GROUP BY path),
links AS (SELECT a.path AS path, b.path AS child, b.depth - a.depth AS steps FROM nodes a JOIN nodes b ON starts_with(b.path, a.path)),
kids AS (SELECT path, count(*) FILTER (WHERE steps = 1) AS n_children FROM links GROUP BY path),
sums AS (SELECT l.path, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
  FROM links l JOIN nodes n ON n.path = l.child JOIN kids k ON k.path = l.child GROUP BY l.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN kids k USING (path) JOIN sums s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1))""")
def op11_prefix_trie(spark, folder):
    return prefix_trie.shared_prefixes(_table(spark, folder, "conversations"))
