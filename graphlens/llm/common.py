"""What the corpus operators share: tables, the shared folder, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. Only a session within one process (as in tests) may do without and gets a new one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, which outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def by_bytes(batch, column: int | str, most: int = 8 << 20):
    """Slices of an Arrow batch whose texts in a column have some bytes together, or one row each where a text has more."""
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_uri(uri: str):
    """(filesystem, path) of a folder named by URI, for tasks that write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_running(df: DataFrame, order: list, sums: dict[str, str], index: str) -> DataFrame:
    """Add to each row its index in the global order of ``order`` and, by column, the sum of that column before it (``sums``: column to new name; its total as new name + "_total").

    Rows are dealt into ranges of the order, totals are taken per range (one small row
    each), and each range is then numbered by itself from its offset: no task sees all rows.
    """
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("_row"))
    ranged = reliable(ranged.withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"{new}_s") for c, new in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"{new}_s").over(before), F.lit(0)).alias(f"{new}_0") for new in sums.values()],
        *[F.sum(f"{new}_s").over(Window.partitionBy()).alias(f"{new}_total") for new in sums.values()],
    )
    own = Window.partitionBy("_range").orderBy(*order, "_row")
    out = ranged.join(F.broadcast(totals), "_range").withColumn(index, F.col("_n0") + F.row_number().over(own) - 1)
    for c, new in sums.items():
        out = out.withColumn(new, F.col(f"{new}_0") + F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c))
    return out.drop("_row", "_range", "_n0", *[f"{new}_0" for new in sums.values()])


#: Rows of ids up to which a list of rows to drop is broadcast (at most some 20 MB).
BROADCAST_ROWS = 200_000


def without(df: DataFrame, gone: DataFrame, on: list[str], how: str = "left_anti") -> DataFrame:
    """The rows of ``df`` whose columns ``on`` (null equals null) are not in ``gone`` (or, with left_semi, are); that is broadcast only if counted small."""
    gone = gone.select(*[F.col(c).alias(f"_gone_{k}") for k, c in enumerate(on)])
    match = None
    for k, c in enumerate(on):
        one = df[c].eqNullSafe(gone[f"_gone_{k}"])
        match = one if match is None else match & one
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, match, how)


def row_key(df: DataFrame):
    """A digest of all columns of a row: rows that share it are the same in all they hold, whatever their ids."""
    return F.sha2(F.concat_ws(",", *[F.coalesce(F.sha2(df[f"`{c}`"].cast("string"), 256), F.lit("-")) for c in df.columns]), 256)


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if it has more than one in so many of all rows; so there are fewer hot keys than this.
HOT_KEYS = 2000


def join_hot(rows: DataFrame, side: DataFrame, on: list[str], times: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` (``total`` of them at most) joined to ``side``, which has one row for each key and says in ``times`` how many of ``rows`` have it.

    Nulls equal nulls. If there are few rows, all of ``side`` is broadcast; else only its hot keys (fewer than HOT_KEYS) are, and
    the rows of other keys are shuffled, of which no key has more than one in HOT_KEYS. ``rows`` is read twice, so it should be saved.
    """
    named = side.withColumnsRenamed({c: f"_key_{k}" for k, c in enumerate(on)})

    def match(other: DataFrame):
        out = None
        for k, c in enumerate(on):
            one = rows[c].eqNullSafe(other[f"_key_{k}"])
            out = one if out is None else out & one
        return out

    keys = [f"_key_{k}" for k in range(len(on))]
    if total <= BROADCAST_ROWS:
        few = F.broadcast(named)
        return rows.join(few, match(few), how).drop(*keys)
    hot = F.broadcast(named.where(F.col(times) * HOT_KEYS > total))
    cold = named.where(F.col(times) * HOT_KEYS <= total)
    mild = rows.join(hot.select(*keys), match(hot), "left_anti")
    return rows.join(hot, match(hot)).drop(*keys).unionByName(mild.join(cold, match(cold), how).drop(*keys))
