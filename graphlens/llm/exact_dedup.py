"""Exact deduplication by progressive refinement (DataFrame functions only).

Texts are equal when identical after each run of white space became one space; null
counts as the empty text. Rows are grouped by normalised length, what still has company by
a hash of its first characters, and only rows of groups that survive both get a full
SHA-256 of their content. (A length can only be had by reading the text, so each pass scans
the column; what the refinement saves is hashing and the shuffle of what is alone.) Per group the
row with the smallest id stays (a null id counts as smallest; of rows that tie in id any one, and
only one, stays). Only lengths and hashes are shuffled, never texts, so their length does not matter.
Counts are combined before each shuffle, so a group that holds a third of all rows is a handful of
partial rows, and the verdict of a hot group is broadcast to its rows. Columns of any
name may stand beside: helper columns take names that the table does not have. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_hot, reliable, unused, without

PREFIX_CHARS = 256
#: Surviving (length, prefix) keys are broadcast up to this many (16 bytes each); beyond, all rows are hashed in the scan, as that costs less than to shuffle the texts, and the hashes of those that do not survive are dropped.
BROADCAST_KEYS = 200_000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _survivors(docs: DataFrame, text_col: str) -> DataFrame:
    """(_len, _head) of lengths and prefixes that several rows share."""
    text = normalised(docs[f"`{text_col}`"])
    probe = docs.select(text.alias("_t")).select(F.length("_t").alias("_len"), F.xxhash64(F.substring("_t", 1, PREFIX_CHARS)).alias("_head"))
    probe = probe.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_n"))
    lengths = probe.groupBy("_len").agg(F.sum("_n").alias("_all")).where("_all > 1").select("_len")
    return reliable(probe.where("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_head", F.lit(True).alias("_again")))


def _hashed(rows: DataFrame, keys: DataFrame, text: str, digest_all: bool) -> DataFrame:
    """``rows`` with _again (whether length and prefix survive) and text_sha256 in place of the column ``text`` (normalised)."""
    rows = rows.withColumn("_len", F.length(text)).withColumn("_head", F.xxhash64(F.substring(text, 1, PREFIX_CHARS)))
    full = F.sha2(text, 256)
    if keys.count() <= BROADCAST_KEYS:
        out = rows.join(F.broadcast(keys), ["_len", "_head"], "left").withColumn("text_sha256", full if digest_all else F.when(F.col("_again"), full))
    else:
        out = rows.withColumn("text_sha256", full).drop(text).join(keys, ["_len", "_head"], "left")
        out = out if digest_all else out.withColumn("text_sha256", F.when(F.col("_again"), F.col("text_sha256")))
    return out.drop(text, "_head").withColumn("_again", F.coalesce("_again", F.lit(False)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is the full hash of the normalised text; rows whose length or prefix
    occurs once have none unless ``digest_all``. An empty table gives an empty result.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), normalised(docs[f"`{text_col}`"]).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    hashed = reliable(_hashed(rows, _survivors(docs, text_col), "_t", digest_all))

    groups = (
        hashed.where("_again")
        .groupBy("_len", "text_sha256")
        .agg(F.min(F.struct("doc_id", "_row")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    single = F.col("_n").isNull()
    return join_hot(hashed, groups, ["_len", "text_sha256"], "_n", hashed.count(), "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_first._row") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are, whatever their names.

    A row is found again by its id and text; of rows that share both, one stays. Up to BROADCAST_KEYS, only texts whose length and prefix come again are hashed.
    """
    verdicts = reliable(exact_dedup(docs, id_col, text_col).where("NOT kept").select("doc_id", "keep_id", "text_sha256"))
    keys = _survivors(docs, text_col)
    # the row itself stands apart, so that its columns cannot clash with helpers
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), docs[f"`{id_col}`"].alias("doc_id"), normalised(docs[f"`{text_col}`"]).alias("_t"))
    rows = rows.select("*", F.length("_t").alias("_len"), F.xxhash64(F.substring("_t", 1, PREFIX_CHARS)).alias("_head"))
    if keys.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(keys), ["_len", "_head"], "left").withColumn("text_sha256", F.when(F.col("_again"), F.sha2("_t", 256)))
    else:
        rows = rows.withColumn("text_sha256", F.sha2("_t", 256))
    rows, on = rows.select("_doc", "doc_id", "text_sha256"), ["doc_id", "text_sha256"]
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = without(rows, verdicts.where(~same).select(*on).distinct(), on)
    twice = verdicts.where(same).select(*on).distinct()  # copies under the id of the row that stays
    if twice.limit(1).count():
        kept = without(kept, twice, on).unionByName(without(kept, twice, on, "left_semi").dropDuplicates(on))
    return kept.select("_doc.*")
