"""Histories fed by a stream of frames that arrive in any order.

A record is (graph_id, has_data, node, metric, value); a frame arrives whole, in one micro-batch, and an
empty one is a record without a node. The store is a folder of Parquet tables partitioned by
graph_id: frames, values and kept (the judged rows). A batch replaces the partitions of its
frames and of those next to them and nothing else, so that running it again changes nothing and late
frames need no watermark. Each replaced partition of ``kept`` holds one row without a node, so that one that loses
its last row is replaced too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from graphlens.operators.fixpoint import saved
from graphlens.operators.history import judge

RECORD = "graph_id long, has_data boolean, node string, metric string, value double"


def _replace(rows: DataFrame, path: str) -> None:
    rows.repartition("graph_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(path)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, graph_id long").parquet(path)


def _frames(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, f"{store}/frames", "has_data boolean").select("graph_id", "has_data")


def fold(batch: DataFrame, store: str, threshold: float) -> None:
    """Take the frames of a batch into the store and judge them and their neighbours again."""
    spark = batch.sparkSession
    batch = saved(batch)
    here = batch.groupBy("graph_id").agg(F.bool_or("has_data").alias("has_data"))
    if not here.limit(1).count():
        return
    _replace(here, f"{store}/frames")
    nothing = here.select("graph_id", F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"))
    _replace(batch.where("has_data AND node IS NOT NULL").select("graph_id", "node", "metric", "value").unionByName(nothing), f"{store}/values")

    w = Window.orderBy("graph_id")  # one row for each frame
    frames = saved(_frames(spark, store))
    places = frames.join(here.select("graph_id", F.lit(True).alias("_new")), "graph_id", "left").withColumn("_place", F.row_number().over(w))
    rank = F.row_number().over(Window.partitionBy("has_data").orderBy(F.col("graph_id").desc()))
    places = saved(places.withColumn("_newest", F.col("has_data") & (rank <= here.count() + 1)))  # the newest before this batch is among them
    centre = places.where("_new OR _newest").select(F.explode(F.array(F.col("_place") - 1, "_place", F.col("_place") + 1)).alias("_place")).distinct()
    touched = saved(places.join(centre, "_place", "left_semi").select("graph_id", "_place"))
    around = touched.select(F.explode(F.array(F.col("_place") - 1, "_place", F.col("_place") + 1)).alias("_place")).distinct()
    around = saved(places.join(around, "_place", "left_semi").select("graph_id"))  # its size is known, so that the planner may broadcast it

    values = _stored(spark, f"{store}/values", "node string, metric string, value double").where("node IS NOT NULL")
    values = values.join(around, "graph_id", "left_semi")
    kept = judge(frames, values, threshold).join(touched.select("graph_id"), "graph_id", "left_semi").select("graph_id", "node", "reasons", "metrics")
    mark = touched.select("graph_id", F.lit(None).cast("string").alias("node"), F.lit(0).alias("reasons"), F.lit(None).cast("map<string,double>").alias("metrics"))
    _replace(kept.unionByName(mark), f"{store}/kept")


def ingest(records: DataFrame, store: str, checkpoint: str, threshold: float) -> StreamingQuery:
    """Start a query that folds all records that are there and ends; started again, it goes on from there."""
    writer = records.writeStream.foreachBatch(lambda batch, _: fold(batch, store, threshold))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, store: str) -> DataFrame:
    """(node, graph_id, reasons, metrics) of all kept rows."""
    return _stored(spark, f"{store}/kept", "node string, reasons int, metrics map<string,double>").where("node IS NOT NULL").select("node", "graph_id", "reasons", "metrics")


def delete(spark: SparkSession, store: str, first: int | None = None, last: int | None = None, node: str | None = None) -> int:
    """Delete the kept rows of frames from ``first`` to ``last`` (None: without end), of one node or of all, and return how many; other rows are not judged again."""
    within = F.lit(True)
    if first is not None:
        within = within & (F.col("graph_id") >= first)
    if last is not None:
        within = within & (F.col("graph_id") <= last)
    held = _stored(spark, f"{store}/kept", "node string, reasons int, metrics map<string,double>").where(within)
    gone = F.col("node").isNotNull() if node is None else F.col("node").eqNullSafe(node)
    touched = held.where(gone).select("graph_id").distinct()
    held = saved(held.join(touched, "graph_id", "left_semi"))  # a copy, as what is read is replaced; the marks of frames stay
    count = held.where(gone).count()
    if count:
        _replace(held.where(~gone), f"{store}/kept")
    return count
