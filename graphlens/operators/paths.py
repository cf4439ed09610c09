"""Paths, ancestors and minimum cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import LARGE, MOST_ROUNDS, Near, dealt, reach_set, saved, saved_by, steps_of

def shortest_paths(edges: DataFrame, start: DataFrame, avoid: DataFrame | None = None, until: DataFrame | None = None) -> DataFrame:
    """(node, depth, route, parent): the first shortest path to each node, in the order of a breadth-first search.

    A search that serves nodes in order of discovery finds a node by the least sequence of (edge_ord)
    among shortest paths, so that sequence is carried along and its least taken. Starts win over avoided nodes.
    The search ends with the level in which a node of ``until`` is found.
    """
    steps = edges.select("src", "dst", "edge_ord")
    starts = start.select("node").distinct()
    if avoid is not None:
        closed = avoid.select("node").join(starts, "node", "left_anti")
        steps = steps.join(closed.withColumnRenamed("node", "dst"), "dst", "left_anti")
    steps = saved(steps)
    rows = steps.count()
    steps = saved_by(dealt(steps, rows, "src"), rows, "src") if rows > LARGE else steps
    seen = saved(starts.select("node", F.lit(0).alias("depth"), F.array().cast("array<struct<node:string,ord:bigint>>").alias("route"), F.lit(None).cast("string").alias("parent")))
    frontier = seen
    for depth in range(1, MOST_ROUNDS):
        if until is not None and frontier.join(until.select("node"), "node", "left_semi").limit(1).count():
            return seen
        step = frontier.select(F.col("node").alias("src"), "route").join(steps, "src")
        route = F.concat("route", F.array(F.struct(F.when(F.size("route") == 0, F.col("src")).alias("node"), F.col("edge_ord").cast("bigint").alias("ord"))))
        best = step.select(F.col("dst").alias("node"), F.struct(route.alias("route"), F.col("src").alias("parent")).alias("r")).groupBy("node").agg(F.min("r").alias("r"))
        frontier = saved(best.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "r.route", "r.parent"))
        if not frontier.limit(1).count():
            return seen
        seen = saved(seen.unionByName(frontier))
    raise RuntimeError("a search did not end")


def find_path(edges: DataFrame, start: DataFrame, goal: DataFrame, avoid: DataFrame | None = None, laid: bool = False) -> DataFrame:
    """(position, node) of the nodes of a shortest path, start first; no rows if there is none. A start that is a goal is the path.

    Levels of names are searched first; sequences of edges are compared only among what lies on shortest ways to the goals that are found, which is all that
    decides. ``laid``: the edges are a table already, best one that is bucketed by src.
    """
    steps, starts, goal = edges.select("src", "dst", "edge_ord"), saved(start.select("node").distinct()), saved(goal.select("node").distinct())
    if avoid is not None:
        steps = steps.join(avoid.select("node").join(starts, "node", "left_anti").withColumnRenamed("node", "dst"), "dst", "left_anti")
    if not laid or avoid is not None:
        steps = saved(steps)
        rows = steps.count()
        steps = saved_by(dealt(steps, rows, "src"), rows, "src") if rows > LARGE else steps
    near, levels, seen = Near(steps), [starts], starts
    while (ends := saved(levels[-1].join(goal, "node", "left_semi"))).isEmpty():
        at_hand = near(levels[-1])
        if at_hand is None:
            return starts.limit(0).select(F.lit(0).alias("position"), "node")
        step = levels[-1].join(at_hand, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        levels.append(saved(step.join(seen, "node", "left_anti")))
        seen = saved(seen.unionByName(levels[-1])) if len(levels) % 8 == 0 else seen.unionByName(levels[-1])
    ways = steps.limit(0)
    for k, level in enumerate(reversed(levels[:-1]), 1):
        here = saved(near(level).join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").join(level.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "edge_ord"))
        ends = here.select(F.col("src").alias("node")).distinct()
        ways = saved(ways.unionByName(here)) if k % 8 == 0 else ways.unionByName(here)
    found = shortest_paths(ways, starts, until=goal)
    at = found.join(goal.select("node"), "node", "left_semi").orderBy("depth", "route", "node").limit(1)
    path = at.select("depth", "node", "parent")
    steps = path
    while True:  # one row a step
        steps = saved(steps.where("parent IS NOT NULL").select(F.col("parent").alias("node")).join(found, "node").select("depth", "node", "parent"))
        if not steps.limit(1).count():
            return path.select(F.col("depth").alias("position"), "node")
        path = path.unionByName(steps)


def ancestors(edges: DataFrame, of: DataFrame, chosen: DataFrame | None = None, parentless: bool = False, limit: int | None = 100) -> DataFrame:
    """(node, depth) of what reaches the nodes over all edges, themselves left out; at least one condition is needed."""
    if chosen is None and not parentless:
        raise ValueError("ancestors need a selection or parentless")
    back = steps_of(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    up = reach_set(back, of, back).join(of.select("node"), "node", "left_anti")
    if chosen is not None:
        up = up.join(chosen.select("node"), "node", "left_semi")
    if parentless:
        up = up.join(back.select(F.col("src").alias("node")), "node", "left_anti")
    return up if limit is None else up.orderBy("node").limit(limit)


def path_hops(edges: DataFrame, start: str, goal: str, avoid: tuple[str, ...] = ()) -> DataFrame:
    """(position, src, dst, kind, tag, type_key, edge_name, branch) of the hops of a shortest path: the first edge (by edge_ord) between its nodes.

    No rows if there is no path. Names that no edge knows, and avoided ones that are an end of the path, are errors.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    unknown = sorted({start, goal, *avoid} - {r[0] for r in ends.where(F.col("node").isin(start, goal, *avoid)).distinct().collect()})  # the names asked for at most
    if unknown:
        raise ValueError(f"unknown nodes: {', '.join(unknown)}")
    if {start, goal} & {*avoid}:
        raise ValueError("an end of the path cannot be avoided")
    one = lambda *names: edges.sparkSession.createDataFrame([(n,) for n in names], "node string")
    path = saved(find_path(edges, one(start), one(goal), one(*avoid) if avoid else None))
    hops = path.select("position", F.col("node").alias("src")).join(path.select((F.col("position") - 1).alias("position"), F.col("node").alias("dst")), "position")
    form = [c for c in ("kind", "tag", "type_key", "edge_name", "branch") if c in edges.columns]
    first = hops.join(edges, ["src", "dst"]).groupBy("position", "src", "dst").agg(F.min(F.struct("edge_ord", *form)).alias("_e"))
    return first.select("position", "src", "dst", *[F.col(f"_e.{c}").alias(c) for c in form])


def blocking_flow(levels: list[DataFrame]) -> DataFrame:
    """(src, dst, flow): a flow from the sources of the first level that leaves no way to the last one open.

    ``levels``: arcs (src, dst, cap) from each level of nodes to the next. All that the sources can send moves down level by level at once, each
    node dealing out what it got to its arcs in the order of names. Nodes that keep some are closed, and give it back to where it came from; what was given back
    moves on to nodes that are open, until none is left.
    """
    depth = len(levels)
    arcs = [saved(a.select("src", "dst", "cap", F.lit(0).cast("long").alias("flow"))) for a in levels]
    spare: list[DataFrame | None] = [None] * (depth + 1)  # (node, spare) of each level that holds any
    closed: list[DataFrame | None] = [None] * (depth + 1)
    before = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def add(at: int, more: DataFrame) -> None:
        both = more if spare[at] is None else spare[at].unionByName(more)
        held = saved(both.groupBy("node").agg(F.sum("spare").alias("spare")).where("spare > 0"))
        spare[at] = None if held.isEmpty() else held

    for wave in range(MOST_ROUNDS):
        for at in range(depth):
            if (wave and at == 0) or (at and spare[at] is None):
                continue
            rows, room = arcs[at], F.col("cap") - F.col("flow")
            if closed[at + 1] is not None:
                rows = rows.join(closed[at + 1].select(F.col("node").alias("dst"), F.lit(True).alias("_closed")), "dst", "left")
                room = F.when(F.col("_closed"), 0).otherwise(room)
            rows = rows.withColumn("_room", room)
            if at == 0:
                rows = rows.withColumn("_push", F.col("_room"))
            else:
                rows = rows.join(spare[at].withColumnRenamed("node", "src"), "src", "left")
                rows = rows.withColumn("_push", F.greatest(F.lit(0), F.least("_room", F.coalesce("spare", F.lit(0)) - F.coalesce(F.sum("_room").over(before("src", "dst")), F.lit(0)))))
            moved = saved(rows.select("src", "dst", "cap", (F.col("flow") + F.col("_push")).alias("flow"), F.col("_push").alias("moved")))
            arcs[at] = moved.drop("moved")
            if at:
                add(at, moved.groupBy(F.col("src").alias("node")).agg((-F.sum("moved")).alias("spare")))
            if at + 1 < depth:
                add(at + 1, moved.where("moved > 0").groupBy(F.col("dst").alias("node")).agg(F.sum("moved").alias("spare")))
        for at in range(1, depth):
            if spare[at] is not None:
                shut = spare[at].select("node")
                closed[at] = saved(shut if closed[at] is None else closed[at].unionByName(shut).distinct())
        if all(s is None for s in spare):
            every = arcs[0]
            for a in arcs[1:]:
                every = every.unionByName(a)
            return every.where("flow > 0").select("src", "dst", "flow")
        for at in reversed(range(1, depth)):
            if spare[at] is None or closed[at] is None:
                continue
            back = spare[at].join(closed[at], "node", "left_semi")
            rows = arcs[at - 1].join(back.withColumnRenamed("node", "dst"), "dst", "left")
            give = F.greatest(F.lit(0), F.least("flow", F.coalesce("spare", F.lit(0)) - F.coalesce(F.sum("flow").over(before("dst", "src")), F.lit(0))))
            given = saved(rows.withColumn("_give", give).select("src", "dst", "cap", (F.col("flow") - F.col("_give")).alias("flow"), F.col("_give").alias("given")))
            arcs[at - 1] = given.drop("given")
            rest = saved(spare[at].join(closed[at], "node", "left_anti"))
            spare[at] = None if rest.isEmpty() else rest
            if at > 1:
                add(at - 1, given.where("given > 0").groupBy(F.col("src").alias("node")).agg(F.sum("given").alias("spare")))
    raise RuntimeError("a flow did not settle")


def _levels(residual: DataFrame, sources: DataFrame, sinks: DataFrame) -> list[DataFrame]:
    """The arcs (src, dst, cap) of the shortest ways from sources to sinks, level by level; none if there is no way."""
    arcs = saved(residual.where("cap > 0").select("src", "dst", "cap"))
    seen = frontier = saved(sources.select("node").distinct())
    down: list[DataFrame] = []
    while True:
        step = arcs.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi")
        step = saved(step.join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "cap"))
        frontier = saved(step.select(F.col("dst").alias("node")).distinct())
        if frontier.isEmpty():
            return []
        down.append(step)
        ends = frontier.join(sinks.select("node"), "node", "left_semi")
        if not ends.isEmpty():
            break
        seen = saved(seen.unionByName(frontier))
    for at in reversed(range(len(down))):  # what does not lead to a sink falls out
        down[at] = saved(down[at].join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "cap"))
        ends = down[at].select(F.col("src").alias("node")).distinct()
    return down


def min_cut(edges: DataFrame, sources: DataFrame, sinks: DataFrame, protected: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """((src, dst) of the least cut nearest the sinks, whether no cut exists).

    Parallel edges add capacity; protected edges have no bound; sinks that are sources fall out. The residual graph is cut into levels and a flow
    that blocks all shortest ways is pushed at once, until no way is left: each turn makes the shortest way longer, so there are as many turns as
    lengths of ways, however large the cut. The cut lies before what can still reach a sink.
    """
    sinks = saved(sinks.select("node").join(sources.select("node"), "node", "left_anti").distinct())
    inside = reach_set(edges, sources).select("node")
    caps = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cap"))
    if protected is not None:
        caps = caps.join(protected.select("src", "dst", F.lit(True).alias("_p")).distinct(), ["src", "dst"], "left")
        caps = saved(caps)
        bound = caps.where("_p IS NULL").agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0]
        # there is no cut just when protected edges alone lead to a sink; else no flow passes what the others let through
        walls = caps.where("_p")
        caps = caps.select("src", "dst", F.when(F.col("_p"), F.lit(bound + 1)).otherwise(F.col("cap")).alias("cap"))
        if reach_set(walls, sources).join(sinks, "node", "left_semi").limit(1).count():
            return caps.limit(0).select("src", "dst"), True
    residual = caps = saved(caps)
    for _ in range(MOST_ROUNDS):
        levels = _levels(residual, sources, sinks)
        if not levels:
            break
        flow = blocking_flow(levels)
        change = flow.select("src", "dst", (-F.col("flow")).alias("cap")).unionByName(flow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flow").alias("cap")))
        residual = saved(residual.select("src", "dst", "cap").unionByName(change).groupBy("src", "dst").agg(F.sum("cap").alias("cap")))
    back = residual.where("cap > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = saved(reach_set(back, sinks).select("node"))
    cut = caps.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").join(near.withColumnRenamed("node", "src"), "src", "left_anti")
    return saved(cut.select("src", "dst")), False
