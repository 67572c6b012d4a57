"""Named queries of the text operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caselight.llm import (
    bpe, fingerprints, jaccard, licenses, lines, neighbours, packing, pii, runs, sharding, substrings, toxicity,
    whitening,
)
from caselight.llm.shared import let_workers_import

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_read(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.report(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def edited_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_read(spark, sf_dir, "documents"))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_read(spark, sf_dir, "documents"))


def tokens_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(_read(spark, sf_dir, "documents"), path)


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"), path, keep_ids=False)
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_read(spark, sf_dir, "documents"), least_bytes=None)


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_read(spark, sf_dir, "documents"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_read(spark, sf_dir, "embeddings"), each=20)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def equal_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_read(spark, sf_dir, "documents"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_read(spark, sf_dir, "documents"))


def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_substrings": repeated_substrings,
    "op2_toxicity": toxicity_scores,
    "op3_fingerprints": edited_fingerprints,
    "op4_lines": repeated_lines,
    "op5_licenses": license_notices,
    "op6_jaccard": similar_documents,
    "op7_bpe": tokens_round_trip,
    "op8_packing": packed_sequences,
    "op9_neighbours": nearest_vectors,
    "op10_pii": personal_data,
    "op11_shards": equal_shards,
    "op12_runs": periodic_runs,
    "op13_whitening": whitened_vectors,
}

#: All inner products, exact; the operator's search is approximate, and whole on small tables.
NEAREST_SQL = """
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.x, v.x) AS score
  FROM sound q JOIN sound v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
WHERE place <= 20
"""

#: Every pair of documents that share an n-gram, and the closure of their links.
SIMILAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS gram
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * common >= 90 * (s.n + t.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id
GROUP BY d.doc_id
"""

#: Every string of 100 bytes of every text, by way of short blocks; the later ones of equal strings cover bytes.
REPEATED_SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), blocks AS (
  SELECT doc_id, n, base, substr(h, 2 * base + 1, 512 + 198) AS block
  FROM (SELECT doc_id, n, h, unnest(range(0, n - 99, 256)) AS base FROM docs WHERE n >= 100)
), windows AS (
  SELECT doc_id, base + j AS i, substr(block, 2 * j + 1, 200) AS s
  FROM (SELECT doc_id, base, block, unnest(range(least(256, n - 99 - base))) AS j FROM blocks)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM windows)
  WHERE place > 1
), opened AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM repeats
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM opened) GROUP BY doc_id, span
), cuts AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM spans
), kept AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS past,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM cuts JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(past, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

#: DuckDB SQL where it can express the operator.
ORACLE: dict[str, str] = {
    "op1_substrings": REPEATED_SQL, "op6_jaccard": SIMILAR_SQL, "op9_neighbours": NEAREST_SQL,
}
