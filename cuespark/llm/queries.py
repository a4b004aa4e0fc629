"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuespark.llm import ann, ball_tree, bpe, cuckoo, langid, line_dedup, mixing, quality, simhash, substring_fm, suffix_dedup, token_blocks, token_pairs
from cuespark.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.encode_to_blocks(documents(spark, sf_dir), vocabulary())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_frequent_lines(documents(spark, sf_dir)).drop("kept_text")


def op4_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_fm.drop_repeated_words(documents(spark, sf_dir)).drop("kept_text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.learn(docs))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_bytes(documents(spark, sf_dir)).drop("kept")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.first_of_equal(documents(spark, sf_dir))


def op13_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pairs.align(documents(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_blocks,
        op2_quality_rules,
        op3_line_dedup,
        op4_anisotropic_search,
        op5_substring_fm,
        op6_simhash,
        op7_bpe_codec,
        op8_language_id,
        op9_suffix_dedup,
        op10_source_mixing,
        op11_hard_negatives,
        op12_exact_dedup,
        op13_token_pairs,
    )
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), each_line AS (
  SELECT row_no, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM lines
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each_line
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id""",
    "op5_substring_fm": r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT row_no, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts
), windows AS (
  SELECT row_no, doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM texts WHERE len(w) >= 13
), keyed AS (
  SELECT row_no, doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS key FROM windows
), first AS (
  SELECT key, min(doc_id) AS doc_id FROM keyed GROUP BY key
), starts AS (
  SELECT k.row_no, k.pos FROM keyed k JOIN first f USING (key) WHERE f.doc_id < k.doc_id
), covered AS (
  SELECT w.row_no, w.doc_id, w.word, w.pos,
         max((s.pos IS NOT NULL)::INT) OVER (PARTITION BY w.row_no ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM words w LEFT JOIN starts s ON s.row_no = w.row_no AND s.pos = w.pos
), kept AS (
  SELECT row_no, count(*)::BIGINT AS n_words, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM covered GROUP BY row_no
)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (row_no)""",
    "op9_suffix_dedup": r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), strings AS (
  SELECT row_no, unnest(range(1, n - 398)) AS pos, unnest(list_transform(range(1, n - 398), lambda i: md5(substr(h, 2 * i - 1, 800)))) AS key FROM texts WHERE n >= 400
), repeated AS (
  SELECT key FROM strings GROUP BY key HAVING count(*) > 1
), starts AS (
  SELECT row_no, pos FROM strings SEMI JOIN repeated USING (key)
), positions AS (
  SELECT row_no, unnest(range(1, n + 1)) AS pos FROM texts
), covered AS (
  SELECT p.row_no, p.pos, max((s.pos IS NOT NULL)::INT) OVER (PARTITION BY p.row_no ORDER BY p.pos ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM positions p LEFT JOIN starts s ON s.row_no = p.row_no AND s.pos = p.pos
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row_no ORDER BY pos), false) AS opens FROM covered
), flags AS (
  SELECT row_no, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, list(gone ORDER BY pos) AS gone FROM edges GROUP BY row_no
)
SELECT t.doc_id, t.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(array_to_string(list_transform(list_filter(range(1, t.n + 1), lambda i: NOT f.gone[i]), lambda i: substr(t.h, 2 * i - 1, 2)), ''))) AS kept_sha256
FROM texts t LEFT JOIN flags f USING (row_no)""",
    "op10_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS h FROM documents
), classed AS (
  SELECT *,
         length(bin(size)) * 4 + (((size * 8) >> length(bin(size))::BIGINT) & 3) AS class FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight, source_size * 3 AS cap FROM sources
), levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT min_by(level, ratio) FROM levels WHERE level <= ratio), 0.0) * weight) AS target,
         ('0x' || substr(md5('mix-1:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM levels
), ranked AS (
  SELECT c.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY c.source ORDER BY class, h, size)::DOUBLE AS k
  FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * least(3, floor(u + rate * k) - floor(u + rate * (k - 1))))::BIGINT AS taken
FROM ranked""",
    "op11_hard_negatives": r"""
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row_no, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.row_no, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.row_no = p.row_no AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""",
    "op12_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, (count(*) OVER (PARTITION BY t))::BIGINT AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts""",
}
