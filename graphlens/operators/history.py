"""Metric histories of nodes over the frames of a timeline.

frames(graph_id, has_data) are ordered by graph_id; values(graph_id, node, metric, value) are the
metrics of frames with data, where zeros count as absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST, OVER_THRESHOLD, ANCHOR, LATEST = 1, 2, 4, 8
NO_DATA, AFTER_GAP, BEFORE_GAP = 1, 2, 4


def frame_flags(frames: DataFrame) -> DataFrame:
    """(graph_id, has_data, flags, position, segment): gaps, the place among frames with data, and the island between gaps."""
    w = Window.orderBy("graph_id")  # one row for each frame
    before, after = F.lag("has_data").over(w), F.lead("has_data").over(w)
    flags = F.when(~F.col("has_data"), NO_DATA).otherwise(F.when(before == F.lit(False), AFTER_GAP).otherwise(0) + F.when(after == F.lit(False), BEFORE_GAP).otherwise(0))
    data = F.when(F.col("has_data"), 1).otherwise(0)
    out = frames.select("graph_id", "has_data", flags.alias("flags"), F.sum(data).over(w).alias("position"), F.sum(1 - data).over(w).alias("segment"))
    return out


def judge(frames: DataFrame, values: DataFrame, threshold: float) -> DataFrame:
    """(node, graph_id, reasons, metrics, position, segment, flags) of the rows that are kept; a node that vanished has no metrics.

    A node is new (FIRST) in a frame with data if it is absent from the one just before; it is OVER_THRESHOLD if any
    metric moved by the threshold or more since then, absent values being 0, and then the row before is its ANCHOR. Frames
    next to a gap keep every node's row, and the one after a gap is not judged. The newest frame is LATEST.
    """
    flags = frame_flags(frames).where("has_data")
    live = values.where("value <> 0").join(flags.select("graph_id"), "graph_id", "left_semi")
    wide = live.groupBy("graph_id", "node").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    at = flags.select("graph_id", "position", "segment", "flags")
    rows = wide.join(F.broadcast(at) if frames.count() <= 100_000 else at, "graph_id").withColumn("_real", F.lit(True))
    # the frame after a node's last in a run holds the news that it vanished
    places = at.select(F.col("graph_id").alias("_g"), F.col("position").alias("_p"), F.col("segment").alias("_s"), F.col("flags").alias("_f"))
    gone = rows.select("node", (F.col("position") + 1).alias("_p"), F.col("segment").alias("_s")).join(rows.select("node", F.col("position").alias("_p")), ["node", "_p"], "left_anti").join(places, ["_p", "_s"])
    none = F.create_map().cast("map<string,double>")
    rows = rows.unionByName(gone.select(F.col("_g").alias("graph_id"), "node", none.alias("metrics"), F.col("_p").alias("position"), F.col("_s").alias("segment"), F.col("_f").alias("flags"), F.lit(False).alias("_real")))
    w = Window.partitionBy("node").orderBy("position")
    near = lambda c: F.when((F.lag("position").over(w) == F.col("position") - 1) & (F.lag("segment").over(w) == F.col("segment")) & F.lag("_real").over(w), F.lag(c).over(w))
    rows = rows.withColumn("_was", near("metrics"))
    moved = F.exists(
        F.array_union(F.map_keys("metrics"), F.map_keys("_was")),
        lambda k: F.abs(F.coalesce(F.element_at("metrics", k), F.lit(0.0)) - F.coalesce(F.element_at("_was", k), F.lit(0.0))) >= threshold,
    )
    judged = (F.col("flags").bitwiseAND(AFTER_GAP)) == 0
    rows = rows.withColumn("_over", judged & F.col("_was").isNotNull() & moved).withColumn("_first", judged & F.col("_real") & F.col("_was").isNull())
    follows = (F.lead("position").over(w) == F.col("position") + 1) & (F.lead("segment").over(w) == F.col("segment"))
    anchor = F.col("_real") & F.coalesce(follows & F.lead("_over").over(w), F.lit(False))
    last = flags.agg(F.max("position").alias("_last"))  # one row
    rows = rows.withColumn("_anchor", anchor).join(F.broadcast(last), F.lit(True))
    newest = F.col("_real") & (F.col("position") == F.col("_last"))
    bits = [(F.col("_first"), FIRST), (F.col("_over"), OVER_THRESHOLD), (F.col("_anchor"), ANCHOR), (newest, LATEST)]
    reasons = sum((F.when(c, v).otherwise(0) for c, v in bits[1:]), F.when(bits[0][0], bits[0][1]).otherwise(0))
    kept = (F.col("reasons") > 0) | (F.col("_real") & (F.col("flags") > 0))
    return rows.withColumn("reasons", reasons).where(kept).select("node", "graph_id", "reasons", "metrics", "position", "segment", "flags")


def series(kept: DataFrame) -> DataFrame:
    """The kept rows with attributable: whether the row before is of the frame just before it, in the same run."""
    w = Window.partitionBy("node").orderBy("graph_id")
    near = (F.lag("position").over(w) == F.col("position") - 1) & (F.lag("segment").over(w) == F.col("segment"))
    return kept.withColumn("attributable", F.coalesce(near, F.lit(False)))


def compact(kept: DataFrame, threshold: float) -> DataFrame:
    """Judge stored rows again at a higher threshold: a verdict goes if the row of the frame before is there and did not move so much."""
    w = Window.partitionBy("node").orderBy("graph_id")
    near = (F.lag("position").over(w) == F.col("position") - 1) & (F.lag("segment").over(w) == F.col("segment"))
    was = F.when(near, F.lag("metrics").over(w))
    rows = kept.withColumn("_was", was)
    moved = F.exists(F.array_union(F.map_keys("metrics"), F.map_keys("_was")), lambda k: F.abs(F.coalesce(F.element_at("metrics", k), F.lit(0.0)) - F.coalesce(F.element_at("_was", k), F.lit(0.0))) >= threshold)
    over = (F.col("reasons").bitwiseAND(OVER_THRESHOLD) != 0) & F.coalesce(moved, F.lit(True))
    rows = rows.withColumn("_over", over)
    follows = (F.lead("position").over(w) == F.col("position") + 1) & (F.lead("segment").over(w) == F.col("segment"))
    anchor = (F.col("reasons").bitwiseAND(ANCHOR) != 0) & F.coalesce(~follows | F.lead("_over").over(w), F.lit(True))
    base = F.col("reasons").bitwiseAND(FIRST + LATEST)
    out = rows.withColumn("_r", base + F.when(over, OVER_THRESHOLD).otherwise(0) + F.when(anchor, ANCHOR).otherwise(0))
    stay = (F.col("_r") > 0) | ((F.size("metrics") > 0) & (F.col("flags") > 0))  # next to a gap all rows stay
    return out.where(stay).select("node", "graph_id", F.col("_r").alias("reasons"), "metrics", "position", "segment", "flags")


def weekly(values: DataFrame, ts: str = "ts") -> DataFrame:
    """(node, week, ts, metric, value): change points of each node and ISO week; values are kept in thousandths."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col(ts)), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    w = Window.partitionBy("node", "metric", "week").orderBy(ts)
    rows = values.select("node", ts, "metric", F.round(F.col("value") * 1000).cast("long").alias("value")).withColumn("week", week)
    was = F.lag("value").over(w)
    return rows.withColumn("_was", was).where(F.col("_was").isNull() | (F.col("_was") != F.col("value"))).select("node", "week", ts, "metric", (F.col("value") / 1000).alias("value"))


def weekly_merge(stored: DataFrame, late: DataFrame, frames: DataFrame, ts: str = "ts") -> DataFrame:
    """(node, week, ts, metric, value): stored change points of weeks once late values (node, ts, metric, value) are put among them; late ones win over stored ones of the same frame.

    ``frames`` (ts) are all frames of these weeks, late ones included. A stored value holds until the next point, so where a late value stands the frame after it gets a point
    of its own with what was held there; then points that say what the one before says fall out. Weeks without late values pass unread by the sort.
    """
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col(ts)), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    keys = ["node", "metric", "week"]
    new = late.select("node", "metric", week.alias("week"), ts, F.round(F.col("value") * 1000).cast("long").alias("_late"))
    touched = new.select(*keys).distinct()
    calm = stored.join(touched, keys, "left_anti").select("node", "week", ts, "metric", "value")
    old = stored.join(touched, keys, "left_semi").select(*keys, ts, F.round(F.col("value") * 1000).cast("long").alias("_held"))
    order = Window.partitionBy("week").orderBy(ts)  # the frames of a week are few
    follow = frames.select(week.alias("week"), ts).distinct().select("week", ts, F.lead(ts).over(order).alias("_next")).where("_next IS NOT NULL")
    after = new.join(follow, ["week", ts]).select(*keys, F.col("_next").alias(ts))
    none = F.lit(None).cast("long")
    points = old.select(*keys, ts, "_held", none.alias("_late")).unionByName(new.select(*keys, ts, none.alias("_held"), "_late")).unionByName(after.select(*keys, ts, none.alias("_held"), none.alias("_late")))
    points = points.groupBy(*keys, ts).agg(F.max("_held").alias("_held"), F.max("_late").alias("_late"))
    line = Window.partitionBy(*keys).orderBy(ts)
    points = points.withColumn("_value", F.coalesce("_late", F.last("_held", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))).where("_value IS NOT NULL")
    was = F.lag("_value").over(line)
    made = points.withColumn("_was", was).where("_was IS NULL OR _was <> _value").select("node", "week", ts, "metric", (F.col("_value") / 1000).alias("value"))
    return calm.unionByName(made)


def dense(values: DataFrame, frames: DataFrame) -> DataFrame:
    """(node, week, graph_id, metric, value): each metric of a node in every frame of the weeks in which it has one; null where it is absent.

    ``values`` and ``frames`` have graph_id and week. The frames of a week are few and travel as one array.
    """
    weeks = frames.groupBy("week").agg(F.sort_array(F.collect_set("graph_id")).alias("_ids"))
    grid = values.select("node", "week", "metric").distinct().join(weeks, "week").select("node", "week", "metric", F.explode("_ids").alias("graph_id"))
    return grid.join(values.select("node", "week", "metric", "graph_id", "value"), ["node", "week", "metric", "graph_id"], "left").select("node", "week", "graph_id", "metric", "value")


def read_range(rows: DataFrame, nodes: DataFrame, first: int, last: int) -> DataFrame:
    """(node, metric, graph_id, value): the rows (node, week, graph_id, metric, value) of the wanted nodes (node) from frame ``first`` to ``last``, over all weeks, each once; nodes without any value there are left out."""
    part = rows.where(F.col("graph_id").between(first, last)).join(nodes.select("node").distinct(), "node", "left_semi")
    once = part.groupBy("node", "metric", "graph_id").agg(F.max("value").alias("value"))  # a frame that is held twice says the same
    return once.join(once.where("value IS NOT NULL").select("node").distinct(), "node", "left_semi")


def encode_series(rows: DataFrame) -> DataFrame:
    """(node, metric, seq, frame_step, value_step) of rows (node, metric, graph_id, value): steps from the row before; a null keeps the baseline and stays null."""
    w = Window.partitionBy("node", "metric").orderBy("graph_id")
    base = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "node", "metric", (F.row_number().over(w) - 1).alias("seq"),
        (F.col("graph_id") - F.coalesce(F.lag("graph_id").over(w), F.lit(0))).alias("frame_step"),
        (F.col("value") - F.coalesce(base, F.lit(0.0))).alias("value_step"),
    )


def decode_series(steps: DataFrame) -> DataFrame:
    """The rows again: running sums of the steps."""
    w = Window.partitionBy("node", "metric").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("node", "metric", F.sum("frame_step").over(w).alias("graph_id"), F.when(F.col("value_step").isNotNull(), F.sum("value_step").over(w)).alias("value"))
