"""Frames of timelines, and deltas between versions of tables.

A change is a row (op, key..., value): op is add, remove or change. frames(timeline_id,
graph_id, ts, frame_type) has the types full, delta, empty and error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import MOST_ROUNDS, numbered, saved


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer join in which null keys equal null keys; the keys stand once."""
    other = b.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = None
    for k in keys:
        one = a[k].eqNullSafe(other[f"_key_{k}"])
        match = one if match is None else match & one
    return a.join(other, match, "full_outer").withColumns({k: F.coalesce(F.col(k), F.col(f"_key_{k}")) for k in keys}).drop(*[f"_key_{k}" for k in keys])


def derive(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(op, keys, value): what turns one table into the other; keys may be null."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    op = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "remove").when(~F.col("_old").eqNullSafe(F.col("_new")), "change")
    return _met(a, b, keys).select(op.alias("op"), *keys, F.col("_new").alias(value)).where("op IS NOT NULL")


def merge(deltas: DataFrame, keys: list[str], value: str, order: str = "graph_id") -> DataFrame:
    """One change for each key from changes in order: none if a key was added and removed again; a removed key that returns is a change."""
    of = deltas.groupBy(*keys).agg(F.min_by("op", order).alias("_first"), F.max_by("op", order).alias("_last"), F.max_by(F.struct(value), order).alias("_v"))
    born, gone = F.col("_first") == "add", F.col("_last") == "remove"
    op = F.when(born & gone, None).when(born, "add").when(gone, "remove").otherwise("change")
    return of.select(op.alias("op"), *keys, F.col(f"_v.{value}").alias(value)).where("op IS NOT NULL")


def apply(base: DataFrame, deltas: DataFrame, keys: list[str], value: str, order: str = "graph_id") -> DataFrame:
    """The base with changes applied in order: the last change of a key counts."""
    last = deltas.groupBy(*keys).agg(F.max_by(F.struct(F.col("op").alias("op"), F.col(value).alias("v")), order).alias("_d"))
    out = _met(base.select(*keys, value), last, keys)
    return out.where("_d IS NULL OR _d.op <> 'remove'").select(*keys, F.when(F.col("_d").isNull(), F.col(value)).otherwise(F.col("_d.v")).alias(value))


def nearest_full(frames: DataFrame) -> DataFrame:
    """Each frame with the last full one at or before it in its timeline, and how many changes lie between; a gap cuts the chain."""
    w = Window.partitionBy("timeline_id").orderBy("graph_id")
    cut = F.sum(F.when(F.col("frame_type").isin("empty", "error"), 1).otherwise(0)).over(w)
    rows = frames.withColumn("_cut", cut)
    of = Window.partitionBy("timeline_id", "_cut").orderBy("graph_id")
    full = F.max(F.when(F.col("frame_type") == "full", F.col("graph_id"))).over(of)
    rows = rows.withColumn("full_id", F.when(F.col("frame_type").isin("full", "delta"), full))
    chain = Window.partitionBy("timeline_id", "full_id").orderBy("graph_id")
    return rows.withColumn("deltas", F.when(F.col("full_id").isNotNull(), F.row_number().over(chain) - 1)).drop("_cut")


def compaction(frames: DataFrame) -> DataFrame:
    """(timeline_id, graph_id, frame_type, becomes): full frames become deltas but for those that begin a run."""
    w = Window.partitionBy("timeline_id").orderBy("graph_id")
    head = F.coalesce(F.lag("frame_type").over(w).isin("empty", "error"), F.lit(True))
    return frames.select("timeline_id", "graph_id", "frame_type", F.when((F.col("frame_type") == "full") & ~head, "delta").otherwise(F.col("frame_type")).alias("becomes"))


def append_violations(frames: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that do not come after what is there: ids must rise, times must not fall."""
    last = frames.groupBy("timeline_id").agg(F.max("graph_id").alias("_id"), F.max("ts").alias("_ts"))
    w = Window.partitionBy("timeline_id").orderBy("graph_id")
    rows = new.join(last, "timeline_id", "left").withColumn("_before", F.coalesce(F.lag("ts").over(w), "_ts"))
    return rows.where((F.col("graph_id") <= F.col("_id")) | (F.col("ts") < F.col("_before"))).select(*new.columns)


def type_counts(frames: DataFrame, now: str, hours: tuple[int, ...] = (24, 168, 720)) -> DataFrame:
    """(timeline_id, frame_type, h24, h168, h720, every): frames by type in windows of so many hours up to now, both ends included, zeros included."""
    end = F.lit(now).cast("timestamp_ntz")
    counts = [F.count_if(F.col("ts").between(end - F.make_dt_interval(hours=F.lit(h)), end)).alias(f"h{h}") for h in hours]
    types = F.explode(F.array(*map(F.lit, ("full", "delta", "empty", "error"))))
    grid = frames.select("timeline_id").distinct().select("timeline_id", types.alias("frame_type"))
    got = frames.groupBy("timeline_id", "frame_type").agg(*counts, F.count(F.lit(1)).alias("every"))
    return grid.join(got, ["timeline_id", "frame_type"], "left").fillna(0)


def needed(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """(timeline_id, graph_id) of the kept frames and of all that their versions are made of: along bases (which may lie in other timelines), else back through adjacent changes to a full frame.

    Adjacent frames are settled at once, as all that lie from the nearest full frame on, so that there are as many rounds as the longest chain of bases has links.
    """
    of = saved(nearest_full(frames).select("timeline_id", "graph_id", "frame_type", "full_id", F.coalesce("base_timeline", "timeline_id").alias("_base_of"), "base_id"))
    found = frontier = saved(kept.select("timeline_id", "graph_id").distinct())
    for _ in range(MOST_ROUNDS):
        rows = of.join(frontier, ["timeline_id", "graph_id"], "left_semi").where("frame_type = 'delta'")
        along = rows.where("base_id IS NOT NULL").select(F.col("_base_of").alias("timeline_id"), F.col("base_id").alias("graph_id"))
        spans = rows.where("base_id IS NULL").groupBy("timeline_id", "full_id").agg(F.max("graph_id").alias("_to"))
        back = of.join(spans, ["timeline_id", "full_id"]).where(F.col("graph_id") <= F.col("_to")).select("timeline_id", "graph_id")
        frontier = saved(along.unionByName(back).distinct().join(found, ["timeline_id", "graph_id"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = saved(found.unionByName(frontier))
    raise RuntimeError("bases go round")


def expired(rows: DataFrame, now: str) -> DataFrame:
    return rows.where(F.col("expires_at") <= F.lit(now).cast(rows.schema["expires_at"].dataType))


def add_external_ids(known: DataFrame, new: DataFrame) -> DataFrame:
    """Number ids (external_id, ord) that are not known yet after the greatest number; what is known is passed over."""
    last = known.agg(F.coalesce(F.max("graph_id"), F.lit(0)).alias("_max"))  # one row
    fresh = numbered(new.join(known.select("external_id"), "external_id", "left_anti"), ["ord", "external_id"], "_place")
    return fresh.join(F.broadcast(last), F.lit(True)).select("external_id", (F.col("_max") + 1 + F.col("_place")).alias("graph_id"))


def select_frames(frames: DataFrame, timeline: str, types: list[str] | None = None, since=None, until=None, ids: list[int] | None = None, least_id: int | None = None, most_id: int | None = None, before: tuple | None = None, expires_before=None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Frames of a timeline within inclusive bounds, in the order of (ts, graph_id).

    ``before`` is a point (ts, graph_id): only the frame just before it stays. ``expires_before`` leaves frames that have expired by then.
    """
    out = frames.where(F.col("timeline_id") == timeline)
    for given, test in (
        (types, lambda: F.col("frame_type").isin(types)),
        (since, lambda: F.col("ts") >= F.lit(since)),
        (until, lambda: F.col("ts") <= F.lit(until)),
        (ids, lambda: F.col("graph_id").isin(ids)),
        (least_id, lambda: F.col("graph_id") >= least_id),
        (most_id, lambda: F.col("graph_id") <= most_id),
        (before, lambda: (F.col("ts") < F.lit(before[0])) | ((F.col("ts") == F.lit(before[0])) & (F.col("graph_id") < before[1]))),
        (expires_before, lambda: F.col("expires_at") <= F.lit(expires_before)),
    ):
        if given is not None:
            out = out.where(test())
    descending, limit = descending or before is not None, 1 if before is not None else limit
    if limit is None:
        return out.sort(*[F.col(c).desc() if descending else F.col(c).asc() for c in ("ts", "graph_id")])
    return out.sort(*[F.col(c).desc() if descending else F.col(c).asc() for c in ("ts", "graph_id")]).limit(limit)
