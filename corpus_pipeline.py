"""A corpus pipeline of five stages, each written to the shared folder and read again.

Language ID drops documents without an identified language, the Jaccard join keeps one document
of each group of near copies, decontamination drops documents that hold benchmark items, mixing
repeats or leaves out documents to reach the target weights, and sharding assigns the rest.

Nulls and odd input: a null or empty text, or one without a letter, has no language and goes in the
first stage. Rows with a null doc_id are documents like others; repeated rows count as copies, and
different texts under one doc_id as different documents. A null source is a source of its own. Very
long texts pass whole. Ties go to the smaller doc_id. Empty tables give an empty result. Columns of
the documents pass unchanged up to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstore.llm import decontam, jaccard, langid, mixing, sharding
from runstore.llm.queries import SHARD_BYTES, vocabulary
from runstore.llm.scratch import keep, passing

#: Posterior below which no language counts as identified.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Columns that the operator would replace wait under names that no column has.
    waiting = {c: c + "_" * max(map(len, docs.columns)) for c in ("held_out", "lang_pred", "score") if c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(waiting), vocabulary("piece_bpe_32k.model"))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col(waiting.get(c, c)).alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id, of equal ids that of the smallest hash; of equal rows, one.

    Rows are told apart by a hash of id and text, so ids may repeat or be null. The decisions are a
    small table of the rows that go or that repeat; the texts are shuffled once, for the anti-join
    with it, and those of repeated rows that stay once more where there are any.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    with passing(spark):
        rows = jaccard.jaccard_groups(docs, key).where("group_id is not null").groupBy("group_id", "row_key", "doc_id").agg(F.count("*").alias("n"))
        rows = keep(rows, "rows")
        best = rows.groupBy("group_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_key")).alias("b"), F.sum("n").alias("all")).where("all > 1").select("group_id", "b.row_key")
        best = keep(best, "best")  # so that the join shuffles both sides itself and a large group can be split
        marks = rows.join(best.withColumnRenamed("row_key", "best"), "group_id").select(F.col("row_key").alias("jaccard_key"), (F.col("row_key") == F.col("best")).alias("stays"), "n")
        marks = keep(marks.where("n > 1 or not stays"), "marks", stay=True)
    # A name that no column of the documents has, whatever theirs are.
    mark = "jaccard_key" + "_" * max(len(c) for c in docs.columns)
    marks, keyed = marks.withColumnRenamed("jaccard_key", mark), docs.withColumn(mark, key)
    once = keyed.join(marks, mark, "left_anti").select(*docs.columns)
    repeated = marks.where("stays").select(mark)
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.join(repeated, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharding_by_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", sharding_by_bytes),
]

#: The learned and searching stages have no SQL form; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
