"""The registered queries of this package: each derives its columns from what the operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagekin.llm import (
    byte_bpe, decontaminate, embedding_dedup, filter_audit, html_text, importance, jaccard_join, language_id, token_count,
    token_store, url_filter, warc, word_bpe,
)
from stagekin.llm.common import new_folder

#: Fixed values of the queries.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
WORD_FILE, WORD_END, WORD_IDS, WORD_SEPARATOR = "word_bpe_49k.json", 1, 49_408, 49_407
BYTE_FILE = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(docs: DataFrame) -> F.Column:
    """Documents that nothing is learned from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score, learned from the documents that are not held out."""
    return language_id.predicted(docs, language_id.fitted(docs.filter(~held_out(docs))))


def op1_language_id(spark, folder):
    docs = _table(spark, folder, "documents")
    return languages(docs).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")


def op2_embedding_dedup(spark, folder):
    return embedding_dedup.deduplicated(_table(spark, folder, "embeddings"))


def op3_jaccard_join(spark, folder):
    return jaccard_join.joined(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_benchmark_decontamination(spark, folder):
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_url_filter(spark, folder):
    return url_filter.judged(_table(spark, folder, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def byte_tokens(docs: DataFrame) -> DataFrame:
    """``docs`` with ids and the bytes decoded from them."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, vocabulary(BYTE_FILE), public_tokenizers.PATTERN)


def op6_byte_bpe(spark, folder):
    return byte_tokens(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_files(spark, folder):
    at = new_folder(spark, "token-shards")
    manifest = token_store.write(_table(spark, folder, "documents"), at, vocabulary(WORD_FILE), WORD_END)
    return token_store.read(manifest, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_token_counts(spark, folder):
    return token_count.document_counts(_table(spark, folder, "documents"), new_folder(spark, "flat-tokens"),
                                       vocabulary(WORD_FILE), WORD_SEPARATOR, WORD_IDS).select("doc_id", "n_tokens")


def op9_html_text(spark, folder):
    return html_text.extracted(_table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_warc(spark, folder):
    fields, capture = F.col("metadata.fields"), F.col("capture")
    refers = F.try_element_at(fields, F.lit("refersToPageId")).cast("long")
    return warc.round_trip(_table(spark, folder, "pages")).select(
        F.expr("try_cast(metadata.fields['pageId'] as long)").alias("page_id"),
        F.coalesce(capture["payload_bytes"], fields["payloadLength"].cast("long")).alias("payload_bytes"),
        capture["payload_digest"].alias("payload_digest"), capture["record_type"].alias("record_type"),
        refers.alias("refers_to"))


def op11_filter_audit(spark, folder):
    text = F.coalesce(F.col("text"), F.lit(""))
    return filter_audit.audited(_table(spark, folder, "documents"), _table(spark, folder, "labels"),
                                filter_audit.text_rules(text), copies="E")


def word_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ids and the text decoded from them, in UTF-8."""
    path = vocabulary(WORD_FILE)
    return word_bpe.decoded(word_bpe.encoded(docs, path), path)


def op12_word_bpe(spark, folder):
    return word_ids(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance(spark, folder):
    return importance.drawn(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = (
    op1_language_id, op2_embedding_dedup, op3_jaccard_join, op4_benchmark_decontamination, op5_url_filter, op6_byte_bpe,
    op7_token_files, op8_token_counts, op9_html_text, op10_warc, op11_filter_audit, op12_word_bpe, op13_importance,
)

_REACH = """
reach(a, b) AS (
  SELECT {id}, {id} FROM {table}
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)"""

ORACLES = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links(a, b) AS (
  SELECT p.vec_id, q.vec_id FROM valid p JOIN valid q
    ON p.label = q.label AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.v, q.v) >= 0.93
),{_REACH.format(id="vec_id", table="embeddings")}
SELECT r.a AS vec_id, coalesce(n.n, 0) AS n_links, r.component_id, r.a = r.component_id AS kept
FROM (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = r.a""",
    "op3_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM grams p JOIN grams q ON p.g = q.g AND p.doc_id < q.doc_id
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
),
links(a, b) AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),{_REACH.format(id="doc_id", table="documents")}
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id""",
    "op5_url_filter": """
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
),
rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict),
    length(rule_host) * 1000000 + length(rule_path)) AS r
  FROM split JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, b.r.rule AS rule, coalesce(b.r.verdict, 'allow') AS verdict
FROM split s LEFT JOIN best b USING (page_id)""",
    "op10_warc": """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
),
firsts AS (SELECT h, max(page_id) AS top FROM digests GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(d.h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM digests d JOIN firsts USING (h)""",
    "op11_filter_audit": """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text))::INT
    + 8 * regexp_matches(t.text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > first, FALSE)::INT AS mask
  FROM texts t JOIN firsts f ON t.text = f.text LEFT JOIN said s ON t.doc_id = s.doc_id
),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
),
moves AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
),
told AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM cells, moves GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told""",
}
