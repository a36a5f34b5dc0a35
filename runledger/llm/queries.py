"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import binpacking, blocknames, bytegru, divergence, fattrie, lengthcurve, linebitmaps, mixture, orderminhash, residuegemm, speculativebpe, warc, weaklabels
from runledger.llm.frames import scratch, table
from runledger.session import materialised
from runledger.sources.files import remove_tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CONTEXT_LIMITS = tuple(512 << i for i in range(9))
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_block_names(spark, sf_dir):
    return blocknames.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op7_block_names"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
w AS (SELECT doc_id, norm, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size FROM t WINDOW g AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


@query
def op9_line_bitmaps(spark, sf_dir):
    out = linebitmaps.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op9_line_bitmaps"] = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.owner AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op10_bin_completion(spark, sf_dir):
    return binpacking.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_speculative_bpe(spark, sf_dir):
    return speculativebpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_byte_gru(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = bytegru.predict(docs, bytegru.fit(docs))
    return out.select("doc_id", bytegru.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_divergence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return divergence.judge(docs, divergence.references(docs))


@query
def op6_order_minhash(spark, sf_dir):
    return orderminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_transactions(spark, sf_dir):
    folder = scratch(spark, "archives")
    try:
        return warc.archive_round_trip(table(spark, sf_dir, "pages"), folder).drop("capture_id")
    finally:
        remove_tree(spark, folder)


ORACLE["op1_transactions"] = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM w
"""


@query
def op4_weak_labels(spark, sf_dir):
    return weaklabels.classify(table(spark, sf_dir, "documents"))


@query
def op5_length_curve(spark, sf_dir):
    lengths = lengthcurve.length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return lengthcurve.curve(materialised(lengths), CONTEXT_LIMITS, QUANTILES)


@query
def op11_hash_thresholds(spark, sf_dir):
    return mixture.decisions(table(spark, sf_dir, "documents"))


ORACLE["op11_hash_thresholds"] = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t GROUP BY source),
w AS (SELECT *, [2, 3, 1][place % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS words FROM s),
o AS (
  SELECT *, (1.5::DOUBLE * words - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, cap / weight) AS level FROM o WHERE weight * level <= cap),
g AS (SELECT w.source, source_size, least(cap::DOUBLE, weight * l.level) AS target FROM w, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
c AS (
  SELECT t.*, source_size, target, whole, target - whole * source_size AS budget,
         coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
         sum(size) OVER (PARTITION BY t.source, h) AS same, count(*) OVER (PARTITION BY t.source, h) AS n,
         row_number() OVER (PARTITION BY t.source, h) AS nth
  FROM t JOIN b ON t.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= budget THEN 1 WHEN upto - same > budget OR size = 0 THEN 0
                             WHEN nth <= ceil((budget - (upto - same)) / (same / n) - 0.5) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query
def op12_residue_gemm(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND label IS NOT NULL")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return residuegemm.hard_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLE["op12_residue_gemm"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, other_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def op13_zfast_trie(spark, sf_dir):
    return fattrie.prefix_nodes(fattrie.with_family_heads(fattrie.sequences(table(spark, sf_dir, "conversations"))))


ORACLE["op13_zfast_trie"] = r"""
WITH o AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''),
                         md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT),
                        lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, k: xor(y >> 1, 3988292384 * (y & 1))), 4294967295::BIGINT) AS crc FROM o),
r AS (
  SELECT h.c, list_concat(list_slice(coalesce(b.own, []), 1, xor(crc, 4294967295) % 4), list_slice(h.own, xor(crc, 4294967295) % 4 + 1, len(h.own))) AS seq
  FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM r),
n AS (
  SELECT list_slice(seq, 1, d) AS key, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(seq) = d), '')) AS ends_sha256
  FROM p GROUP BY ALL),
k AS (SELECT list_slice(key, 1, d - 1) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.key[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM n LEFT JOIN k ON n.key = k.key),
u AS (SELECT *, unnest(range(0, d + 1)) AS a FROM w),
s AS (SELECT list_slice(key, 1, a) AS key, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, v.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN s ON w.key = s.key LEFT JOIN n v ON w.d > 0 AND v.key = list_slice(w.key, 1, w.d - 1)
"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
