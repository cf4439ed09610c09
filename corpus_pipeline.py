"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage judges each row by itself: ids and texts may be null or repeat, rows may be the same in all columns, tables may be
empty, texts of any length are taken whole, and columns of any name may stand beside those of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.bpe import bpe_encode
from graphlens.llm.common import new_folder, reliable, row_key, table, unused, without
from graphlens.llm.exact_dedup import drop_copies
from graphlens.llm.language_id import identify_documents, train
from graphlens.llm.mixing import mix_sources
from graphlens.llm.near_dup import drop_near_copies

#: Copies of a row that the mix takes are made so many to a task.
COPIES = 1024


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go (texts that are null, empty or of no language of the labels); rows that are the same share a verdict."""
    key = unused(docs, "_key")
    marked = docs.withColumn(key, row_key(docs))
    found = reliable(identify_documents(marked, train(docs), key))
    return without(marked, found.where("NOT accepted").select(key).distinct(), [key]).select(*_columns(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty are equal) the row with the smallest id stays, a null id before others; of ties one."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links connect the one with the smallest id stays, a null id after others, ties by a digest of the row; rows without words stay."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stands as often as the mix takes it: not at all, once or twice; rows without words go. Rows that are the same stand as often as all of them are taken."""
    key, copy = unused(docs, "_key"), unused(docs, "_copy")
    marked = docs.withColumn(key, row_key(docs))
    times = mix_sources(marked, key).groupBy(F.col("doc_id").alias(key)).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n"))
    times = reliable(times)
    other, twice = times.where("times = 0 OR n > 1").select(key), times.where("n = 1 AND times = 2").select(key)
    out = without(marked, other, [key]).unionByName(without(marked, twice, [key], "left_semi"))
    same = times.where("n > 1 AND times > 0").select(F.col(key).alias(copy), F.col("times").cast("int").alias("times"))
    if same.limit(1).count():
        one = without(marked, same.select(F.col(copy).alias(key)), [key], "left_semi").dropDuplicates([key])
        one = one.select(F.col(key).alias("of"), F.struct(*_columns(docs)).alias("doc"))  # the row stands apart, so that its columns cannot clash
        runs = same.select(F.col(copy).alias("of"), F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(COPIES))).alias("from"), "times")
        one = one.join(runs, "of").select("doc", F.least(F.lit(COPIES), F.col("times") - F.col("from")).alias("n"))
        one = one.repartition(spark.sparkContext.defaultParallelism).select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")
        out = out.select(*_columns(docs)).unionByName(one.select(*_columns(docs)))
    return out.select(*_columns(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    return bpe_encode(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("n-gram Jaccard join", jaccard_join), ("mixing", mixing), ("BPE", bpe)]

#: The stages learn a model, fit budgets and encode; SQL cannot say them. tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table documents; each stage is written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
