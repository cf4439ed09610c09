"""Loops over frontiers, with lineage cut by tables written to the shared folder."""

from __future__ import annotations

import itertools
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rounds of loops whose end is certain but whose number is not worth a limit count up to this; more are an error.
MOST_ROUNDS = 1_000_000
#: Tables of more rows than LARGE are dealt by keys into parts of about PART rows, whatever the session's number of partitions, so that what a task holds does not grow with them.
LARGE, PART = 4_000_000, 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session within one process (as in tests) may do without and gets a new one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-graph-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, which outlives executors. Its size is known, so that small ones are broadcast by the planner and large ones are not."""
    path = new_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession, rows: int) -> int:
    """In how many parts so many rows are dealt: no fewer than the session's, so that joins keep to them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / PART))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows, of which there are about so many, dealt by keys if they are many."""
    return df.repartition(parts_of(df.sparkSession, rows), *keys) if rows > LARGE else df


def saved_by(df: DataFrame, rows: int, key: str) -> DataFrame:
    """As ``saved``; a large table is bucketed by the key, so that joins by it in later rounds shuffle the other side only. ``df`` is dealt by the key already if it is ``dealt`` or a join over such a table."""
    if rows <= LARGE:
        return saved(df)
    spark, parts = df.sparkSession, parts_of(df.sparkSession, rows)
    name = f"graph_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).sortBy(key).option("path", new_folder(spark, "saved")).format("parquet").saveAsTable(name)
    return spark.table(name)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add the place of each row in a total order, from 0: ranges are counted first, then each is numbered by itself."""
    ranged = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + place).drop("_range", "_start")


def steps_of(edges: DataFrame) -> DataFrame:
    """(src, dst), each pair once: what a loop joins in every round, written once."""
    pairs = saved(edges.select("src", "dst"))
    rows = pairs.count()
    return saved_by(dealt(pairs, rows, "src").distinct(), rows, "src") if rows > LARGE else saved(pairs.distinct())


class Near:
    """What a round joins of steps (src, ...) of a loop: of many rows only those whose src lies between the least and the greatest name of the frontier.

    Bucketed steps are sorted by src, so that pages of their files outside of it are not read.
    """

    def __init__(self, steps: DataFrame):
        self.steps, self.large = steps, steps.count() > LARGE

    def __call__(self, frontier: DataFrame) -> DataFrame | None:
        """None if the frontier (saved; node) is empty."""
        if not self.large:
            return None if frontier.isEmpty() else self.steps
        n, least, greatest = frontier.agg(F.count(F.lit(1)), F.min("node"), F.max("node")).first()
        return self.steps.where(F.col("src").between(F.lit(least), F.lit(greatest))) if n else None


def reach(edges: DataFrame, seeds: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): what each root reaches, itself at depth 0, by edges (src, dst).

    ``seeds`` has (root, node), each pair once. Only the last frontier is joined in a round, and a
    pair enters once, at its least depth; the rows are those of the answer. There are as many rounds as the longest of
    all shortest paths has edges. ``steps`` may be given where several loops walk the same edges.
    """
    steps = steps_of(edges) if steps is None else steps
    frontier = saved(seeds.select("root", "node", F.lit(0).alias("depth")))
    seen, near = frontier, Near(steps)
    at_hand = near(frontier)
    if at_hand is None:
        return seen
    for depth in itertools.count(1):
        step = frontier.join(at_hand, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        at_hand = near(frontier)
        if at_hand is None:
            return seen
        seen = saved(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)


def reach_set(edges: DataFrame, roots: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(node, depth): what any of the roots (node) reaches."""
    return reach(edges, roots.select(F.lit(0).alias("root"), "node").distinct(), steps).drop("root")
