"""An index of names for searches by letters in order: a search reads the names that hold the pairs of its letters, not all.

A row (pair, node) says that a name has two letters one after the other, with any others between, or that it has a letter (a pair of one). Rows are sorted
by pair over the files, so that the bounds of pairs in Parquet let a search open only what it asks for. Letters are compared in lower case.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pairs_of(text: str) -> list[str]:
    """The pairs that a name must have to be found: neighbours in the text that is searched for, or its only letter."""
    letters = text.lower()
    return sorted({a + b for a, b in zip(letters, letters[1:])}) or sorted(set(letters))


def write_index(nodes: DataFrame, folder: str) -> None:
    """Write the index of names (node): for each name each different pair once."""
    letters = F.split(F.lower("node"), "")
    rows = nodes.select("node", letters.alias("_l"))
    later = F.transform("_l", lambda a, k: F.transform(F.array_distinct(F.slice(F.col("_l"), k + 2, F.size("_l"))), lambda b: F.concat(a, b)))
    pairs = F.array_distinct(F.concat(F.flatten(later), F.col("_l")))
    # the hash parts a pair that most names have
    rows.select(F.explode(pairs).alias("pair"), "node").where("pair <> ''").repartitionByRange("pair", F.xxhash64("node")).sortWithinPartitions("pair").write.parquet(folder)


def candidates(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """(node): the names that have all pairs of the text: what a search reads."""
    pairs = pairs_of(text)
    held = spark.read.schema("pair string, node string").parquet(folder).where(F.col("pair").isin(pairs))
    return held.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(pairs)).select("node")


def search(spark: SparkSession, folder: str, text: str, limit: int = 1000) -> DataFrame:
    """(node): names with the letters of the text in their order, the shortest first, ties by name."""
    if not text:
        raise ValueError("nothing to search for")
    hit = candidates(spark, folder, text).where(F.lower("node").rlike(".*".join(map(re.escape, text.lower()))))
    return hit.orderBy(F.octet_length("node"), "node").limit(limit)
