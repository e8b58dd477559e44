"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, jaccard_join, language_model, license_scan, media, quality_classifier, sentence_pieces, sharding, substring_dedup, token_counts, url_filter, whitening
from .shared import read

def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_pieces(read(spark, sf_dir, "documents"), sentence_pieces.read_model(spark))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"), wrapped=True).drop("blocks")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.read_vocabulary(spark))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    reported = pages.where("page_id % 50 = 0")  # the list: canonical URLs of a stated fiftieth; every page is judged
    listed = reported.select(url_filter.canonical(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("canonical"))
    return url_filter.filter_urls(pages, listed)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_quality_classifier, op3_lm_scoring, op4_media_columns, op5_sentence_pieces,
        op6_license_scans, op7_token_counts, op8_benchmark_decontamination, op9_url_filters, op10_sharding,
        op11_importance_resampling, op12_embedding_whitening, op13_substring_dedup,
    )
}

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every pair that shares a shingle is counted, and links are followed to a fixed point.
OP1_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS gram FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * p.shared >= 75 * (s.n + t.n - p.shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS doc_id, any_value(coalesce(s.n, 0))::BIGINT AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a GROUP BY r.a
"""

OP8_SQL = rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') FROM benchmark
), grams AS (
  SELECT DISTINCT side, id, gram FROM (SELECT side, id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS gram FROM words)
), items AS (
  SELECT id, gram, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE side = 'i'
)
SELECT d.id AS doc_id, i.id AS item_id, any_value(i.n)::INTEGER AS item_shingles, count(*)::INTEGER AS shared, count(*)::DOUBLE / any_value(i.n) AS containment
FROM grams d JOIN items i ON d.gram = i.gram WHERE d.side = 'd'
GROUP BY d.id, i.id HAVING 4 * count(*) >= 3 * any_value(i.n)
"""

OP9_SQL = rf"""
WITH parts AS (
  SELECT page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE page_id % 50 = 0 AND canonical <> ''
), judged AS (
  SELECT n.*, l.canonical IS NOT NULL AS listed, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named n LEFT JOIN listed l ON l.canonical = n.canonical
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(license_scan.TEMPLATES))

#: Phrases by neighbouring words; every line, and every window from a template's token on, is counted.
OP6_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), found AS (
  SELECT doc_id, n, regexp_extract_all({_LOW.format("line")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM lines
), words AS (
  SELECT doc_id, n, word, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS pos FROM (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM found)
), next AS (
  SELECT *, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), places AS (
  SELECT doc_id, pos, CASE WHEN word = 'cc' AND second = 'by' THEN 'cc-by' WHEN word = 'general' AND second = 'public' AND third = 'license' THEN 'gpl' WHEN word = 'all' AND second = 'rights' AND third = 'reserved' THEN 'reserved' END AS label FROM next
), base AS (
  SELECT doc_id, count(*) AS n_words, count(label) AS n_base, min(pos) FILTER (label IS NOT NULL) AS first_word, max(pos) FILTER (label IS NOT NULL) AS last_word FROM places GROUP BY doc_id
), templates AS (
  SELECT i, label, regexp_extract_all({_LOW.format("text")}, '[a-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) t(i, label, text)
), sized AS (
  SELECT i, label, list_distinct(w) AS tokens, len(list_distinct(w)) AS size, ceil(round(0.85::DOUBLE * len(list_distinct(w)), 9)) AS need, floor(round(len(w) / 0.85::DOUBLE, 9)) AS width FROM templates
), hits AS (
  SELECT doc_id, n, pos, word, i, label, size, need, width FROM words JOIN (SELECT *, unnest(tokens) AS token FROM sized) ON word = token
), likely AS (
  SELECT doc_id, i FROM hits GROUP BY ALL HAVING count(DISTINCT word) >= any_value(need)
), kept AS (
  SELECT h.* FROM hits h JOIN likely USING (doc_id, i)
), joined AS (
  SELECT doc_id, label, count(DISTINCT word) / any_value(size) AS share FROM kept GROUP BY doc_id, n, i, label HAVING count(DISTINCT word) >= any_value(need)
  UNION ALL SELECT a.doc_id, a.label, count(DISTINCT b.word) / any_value(a.size) FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.i = b.i AND b.pos BETWEEN a.pos AND a.pos + a.width - 1 GROUP BY a.doc_id, a.i, a.label, a.pos HAVING count(DISTINCT b.word) >= any_value(a.need)
), own AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places WHERE label IS NOT NULL UNION ALL SELECT doc_id, label FROM joined) GROUP BY doc_id
), plain AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places WHERE label IS NOT NULL GROUP BY doc_id
), best AS (
  SELECT doc_id, max(share) AS score FROM joined GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM documents LEFT JOIN base USING (doc_id) LEFT JOIN plain USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN best USING (doc_id)
"""

#: Ranks within each source and fractional ranks over all rows, without ranges.
OP10_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), rows AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('s' || source, '') AS stratum FROM documents
), hashed AS (
  SELECT doc_id, stratum, octet_length(encode(text)) + 8 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM rows, crc_table
), shuffled AS (
  SELECT *, md5('20240607|' || stratum || '|' || coalesce(doc_id::VARCHAR, '') || '|' || crc)[1:16] AS h FROM hashed
), ranked AS (
  SELECT *, 2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, crc, size) - 1 AS odd, count(*) OVER (PARTITION BY stratum) AS of FROM shuffled
), placed AS (
  SELECT *, row_number() OVER (ORDER BY odd::DOUBLE / of, h, stratum, doc_id, crc, size) - 1 AS place, count(*) OVER () AS total FROM ranked
), cut AS (
  SELECT *, place * 24 // total AS shard FROM placed
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, place - (shard * total + 23) // 24 AS slot, NULL::INTEGER AS grown_shard FROM cut
"""

#: Each distinct feature's crc32 by a byte table; the draw by sorting all rows.
OP11_SQL = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') FROM benchmark
), each AS (
  SELECT side, id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), near AS (
  SELECT side, id, word, word || ' ' || lead(word, 1) OVER o AS two, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS three FROM each WINDOW o AS (PARTITION BY side, id ORDER BY i)
), features AS (
  SELECT side, id, word AS feature FROM near UNION ALL SELECT side, id, two FROM near WHERE two IS NOT NULL UNION ALL SELECT side, id, three FROM near WHERE three IS NOT NULL
), hashed AS (
  SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda p: ('0x' || p)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM features), crc_table
), placed AS (
  SELECT side, id, bucket FROM features JOIN hashed USING (feature)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM counts) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))::DOUBLE))::BIGINT AS gain FROM counts
), weights AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

#: Every window's words are compared as one string.
OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), each AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM words
), windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER o AS words, count(*) OVER o AS size FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS n FROM windows WHERE size = 35) WHERE n > 1
), marked AS (
  SELECT e.doc_id, e.i, word, count(r.i) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS removed FROM each e LEFT JOIN repeated r ON r.doc_id = e.doc_id AND r.i = e.i
), kept AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS rest FROM marked GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op6_license_scans": OP6_SQL, "op8_benchmark_decontamination": OP8_SQL, "op9_url_filters": OP9_SQL, "op10_sharding": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_substring_dedup": OP13_SQL}
