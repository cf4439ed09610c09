"""Contiguous shards of near equal bytes (DataFrame functions only).

A document weighs the UTF-8 bytes of its text (null: none) plus one. In the order of the
ids, totals of ranges give each row the global sum before it; the row goes to the
shard into whose equal share of all bytes its middle falls. So shards are contiguous in
the id order and differ from an equal share by one document at most on each side. Only
(id, size, checksum) is shuffled. Null ids come first; rows with equal or null ids stand
side by side in any order. A text of any length is one row of one shard, so a shard can be as far
from an equal share as its longest text is long. Equal texts are not held together. Other columns
are not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable, with_running


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no law by key)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = reliable(with_running(rows, [F.col("doc_id")], {"size": "_start"}, "_index"))
    middle = F.expr(f"(2 * _start + size) * {int(shards)} div (2 * _start_total)")
    placed = placed.withColumn("shard", middle.cast("int"))
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
