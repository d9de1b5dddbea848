"""The driver's queries over this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest_index, line_dedup, ngram_join, packing, piece_codec, quality, token_counts, topk_search, toxicity, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the url query: host, path, verdict. Fixed values.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, default="allow")


OP1_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    COALESCE(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed) AS judged
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP2_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, MIN(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(COUNT(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  doc_id = MIN(doc_id) OVER (PARTITION BY t) AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM norm
"""


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=20, scale=64, every=20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored) AS ranked
WHERE rank <= 20
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score_documents(documents, quality.model_for(documents, table(spark, sf_dir, "labels")), threshold=0.7)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operator leaves of each document, as a digest."""
    left = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"), per=line_dedup.CHARS_PER_EDIT)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("left_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"), window=2048, closing_id=1)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
g AS (SELECT doc_id, len(s) AS size, unnest(s) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * COUNT(*) >= 80 * (a.size + b.size - COUNT(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, MIN(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY ALL
"""


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score_documents(documents, toxicity.model_for(documents, table(spark, sf_dir, "labels")), threshold=0.5)


def op10_piece_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trips(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filter, op2_exact_dedup, op3_topk_search, op4_token_counts, op5_quality, op6_line_dedup, op7_packing, op8_ngram_join, op9_toxicity, op10_piece_round_trips]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_topk_search": OP3_SQL, "op8_ngram_join": OP8_SQL}
