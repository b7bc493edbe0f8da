"""The registered queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chaining, decontam, jaccard, langid, licences, lm, mixing, sharding, wrappers
from .scratch import keep

SHARD_BYTES = 1 << 20


def vocabulary(name: str) -> str:
    """A file of the public vocabularies; TOKENIZER_DIR names another folder for them."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "held_out", "lang_pred", "score")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.describe(keep(audio.store(table(spark, sf_dir, "documents")), "media"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


SHARDING_SQL = f"""
WITH addressed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h,
         coalesce(strlen(text), 0)::BIGINT AS n_bytes
  FROM documents),
buckets AS (
  SELECT d, h >> (60 - d) AS p, sum(n_bytes)::BIGINT AS bytes, min(h) <> max(h) AS many
  FROM addressed, range(0, 61) t(d) GROUP BY ALL),
leaf AS (
  SELECT h, min(d) AS d FROM (SELECT DISTINCT h FROM addressed) a, buckets b
  WHERE b.p = a.h >> (60 - b.d) AND NOT (bytes > {SHARD_BYTES} AND many) GROUP BY h)
SELECT a.doc_id, a.n_bytes, leaf.d::INTEGER AS shard_depth, b.p AS shard_prefix, b.bytes AS shard_bytes,
       b.bytes > {SHARD_BYTES} AS oversized
FROM addressed a JOIN leaf ON leaf.h = a.h JOIN buckets b ON b.d = leaf.d AND b.p = a.h >> (60 - leaf.d)
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS g
  FROM words),
items AS (SELECT doc_id, len(g) AS n, unnest(g) AS e FROM grams),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.e = b.e AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.root, l.y FROM reach r JOIN links l ON l.x = r.node)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, (SELECT min(r.node) FROM reach r WHERE r.root = g.doc_id) AS component_id
FROM grams g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": SHARDING_SQL, "op4_ngram_jaccard": JACCARD_SQL}
