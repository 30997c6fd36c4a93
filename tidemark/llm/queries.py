"""Queries opN_<name> of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, common, decontam, exactdup, fingerprint, lexical, mixing, neardup, substrings, tokens, toxicity, urlgraph, warc, webtext

#: Vocabulary of the token counts; a parameter of the operator, read on the driver only.
VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(_table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokens.read_ranks(VOCABULARY))


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), options=neardup.Options(shingle=3, percent=85))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.main_text(_table(spark, sf_dir, "pages"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), common.word_count(F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(_table(spark, sf_dir, "documents"))


#: Base32 is read off the SHA-1's 160 bits: a 0 in front keeps the hexadecimal digits whole, then 5 bits a character.
OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) % 32 + 1, 1)), '') AS payload_digest
  FROM p),
r AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first
  FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE place WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to
FROM r
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (
  SELECT doc_id, pos, md5_number(array_to_string(list_slice(words, pos, pos + 49), ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM d WHERE len(words) >= 50)),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) AS first FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM f WHERE first < doc_id),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM p ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(words, pos, pos + 2), ' ')) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS pos FROM d WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach(doc_id, other) AS (SELECT a, b FROM l UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.other = l.a),
c AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       c.low IS NULL OR c.low >= d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / w AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
l AS (
  SELECT *, (total - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level_here
  FROM f WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size::BIGINT AS source_size,
         least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN level_here <= full_at THEN level_here END) OVER (), full_at) * w) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""


#: One round of assignment and update; {p} is the round before.
_OP11_ROUND = """
a{n} AS MATERIALIZED (
  SELECT id, part, min(d * 64 + entry) AS best
  FROM (SELECT id, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x))::HUGEINT AS d FROM v JOIN c{p} c USING (part, place) GROUP BY ALL) GROUP BY ALL),
c{n} AS MATERIALIZED (
  SELECT c.part, c.entry, c.place, coalesce(m.x, c.x) AS x
  FROM c{p} c LEFT JOIN (
    SELECT v.part, (best % 64)::BIGINT AS entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM v JOIN a{n} USING (id, part) GROUP BY ALL) m
  USING (part, entry, place)),
"""

OP11_SQL = """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT id, i // (width // 16) AS part, i % (width // 16) AS place, floor(256 * x::DOUBLE)::BIGINT AS x
  FROM (SELECT id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i, len(embedding) AS width FROM k)),
c0 AS MATERIALIZED (SELECT part, id AS entry, place, x FROM v WHERE id < 64),
""" + _OP11_ROUND.format(n=1, p=0) + _OP11_ROUND.format(n=2, p=1) + _OP11_ROUND.format(n=3, p=2).split("c3 AS")[0] + """
r AS (SELECT id, string_agg(printf('%02x', (best % 64)::INTEGER), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a3 GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(coalesce(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place), '')) FROM c2) AS codebooks_sha256
FROM r JOIN k USING (id)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
q AS MATERIALIZED (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
p AS MATERIALIZED (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs),
i AS MATERIALIZED (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS impact FROM p JOIN w USING (term), s),
t AS (SELECT item, item_id, row, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM t WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": OP3_SQL, "op5_repeated_substrings": OP5_SQL, "op7_near_duplicates": OP7_SQL, "op9_source_mix": OP9_SQL, "op11_vector_codes": OP11_SQL,
        "op12_ranked_search": OP12_SQL, "op13_exact_duplicates": OP13_SQL,
    }
