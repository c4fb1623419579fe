"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.chat import maximal_chats
from tessel.llm.language import identify
from tessel.llm.near_dup import NearDupParams, near_duplicates
from tessel.llm.packing import pack
from tessel.llm.quality import judge
from tessel.llm.secrets import secret_digest
from tessel.llm.substring import substring_digest
from tessel.llm.toxicity import toxicity
from tessel.llm.vectors import near_vectors
from tessel.llm.word_bpe import encode_digest
from tessel.runtime import input_table


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(input_table(spark, sf_dir, "documents"), _fold(4) == 2)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(input_table(spark, sf_dir, "documents"), NearDupParams(shingle=2))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(input_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(input_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(input_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(input_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(input_table(spark, sf_dir, "embeddings"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_chats(input_table(spark, sf_dir, "conversations"))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(input_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels"), _fold(5) == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_minhash_near_dedup, op3_substring_dedup, op4_quality_rules, op5_best_fit_packing, op6_secret_scans, op7_embedding_near_dedup, op8_chat_formatting, op9_bpe_encode_decode, op10_toxicity)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id, r.root = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

_OP3 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM (SELECT h.doc_id, h.i FROM h JOIN m ON m.h = h.h WHERE m.first < h.doc_id)),
gone AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.ks), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN g.ks IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda k: NOT list_contains(g.ks, k)), lambda k: w.w[k]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id
"""

_OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM z a JOIN z b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.id),
c AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, c.root = e.vec_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

_OP8 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS s FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT s[1:k] AS s FROM (SELECT s, unnest(range(1, len(s))) AS k FROM c)),
f AS (SELECT min(conv_id) AS conv_id, s FROM c WHERE s NOT IN (SELECT s FROM p) GROUP BY s)
SELECT conv_id, len(s)::BIGINT AS n_turns,
  array_to_string(list_transform(s, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10)), '') AS chat
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": _OP2, "op3_substring_dedup": _OP3, "op7_embedding_near_dedup": _OP7, "op8_chat_formatting": _OP8}
