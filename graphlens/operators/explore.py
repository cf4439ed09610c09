"""Tables of nodes for exploration: views of metrics as columns, targets, arrows, sorting and pages, for one graph or a comparison of two."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.plans.config import MetricView

from . import metrics, twin
from .fixpoint import saved
from .messages import rendered
from .selection import NodeSelection, select_nodes
from .traverse import Prepared


def view_values(p: Prepared, nodes: DataFrame, view: MetricView) -> DataFrame:
    """(node, value) of a view for some nodes. Unknown metrics and tiers, and what is not reachable, read 0."""
    rows = nodes.select("node").distinct()
    if view.kind == "self":
        return metrics.values_of(rows, p.node_metrics, view.metric)
    if view.kind == "tier":
        got = p.state.select("node", F.coalesce("tier", F.lit(0)).cast("double").alias("value"))
    elif view.kind == "parents":
        got = p.parents.select("node", F.col("parents").cast("double").alias("value"))
    elif view.kind == "tiered_dominated":
        at = p.tiers.index(view.tier) if view.tier in p.tiers else -1
        got = metrics.dominated_tiered(p, view.metric).where(F.col("tier") == at).select("node", F.col("sum").alias("value"))
    elif "dominated" in view.kind:
        got = metrics.dominated(p, view.metric).select("node", F.col("count" if view.kind.startswith("count") else "sum").cast("double").alias("value"))
    else:
        pairs = p.reached_by(nodes)
        if view.kind.startswith("count"):
            got = pairs.groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        elif view.kind.startswith("tiered"):
            at = p.tiers.index(view.tier) if view.tier in p.tiers else -1
            got = metrics.tiered(p, pairs, view.metric).where(F.col("tier") == at).select(F.col("root").alias("node"), F.col("sum").alias("value"))
        else:
            one = p.node_metrics.where(F.col("metric") == view.metric).select("node", "value")
            got = pairs.join(one, "node").groupBy(F.col("root").alias("node")).agg(F.sum("value").alias("value"))
    return rows.join(got, "node", "left").fillna(0.0, ["value"])


def available_views(p: Prepared) -> list[MetricView]:
    """Every view of every metric, the metrics by name. Names of metrics are few: the schema of the graph, not its data."""
    names = sorted(r[0] for r in p.node_metrics.select("metric").distinct().collect())
    of = [MetricView(n, k) for n in names for k in ("self", "transitive", "dominated")]
    of += [MetricView(n, k, t) for n in names for t in p.tiers for k in ("tiered", "tiered_dominated")]
    return of + [MetricView("", k) for k in ("parents", "count_transitive", "count_dominated")] + ([MetricView("", "tier")] if p.tiers else [])


def arrows(p: Prepared, node: str, structure: str = "forward") -> DataFrame:
    """(node, ord, tag, type_key, edge_name, branch, excluded, message): the edges of a node, to its children (forward), parents (reverse) or what it dominates at once (dominator)."""
    columns = ["tag", "type_key", "edge_name", "branch"]
    if structure == "dominator":
        none = [F.lit(None).cast("string").alias(c) for c in (*columns, "message")]
        of = p.tree.where(F.col("idom") == node)
        return of.select("node", F.lit(None).cast("long").alias("ord"), *none[:-1], F.lit(False).alias("excluded"), none[-1])
    near, far = ("src", "dst") if structure == "forward" else ("dst", "src")
    return p.edges.where(F.col(near) == node).select(F.col(far).alias("node"), F.col("edge_ord").alias("ord"), *columns, "excluded", rendered().alias("message"))


def targets(p: Prepared, target: str | NodeSelection = "entry_points", structure: str = "forward", excluded: bool = False) -> DataFrame:
    """Rows with a node each: the reachable entry points, all reachable nodes (``all``), what a selection matches, or the arrows of a node (``node:`` and its name)."""
    if isinstance(target, NodeSelection):
        if target.fuzzy:
            raise ValueError("a search for the best few has no total; use a substring or a pattern")
        return select_nodes(p.state.where("reachable").join(p.nodes, "node", "left"), target, p.node_metrics, p.edges)
    if target == "entry_points":
        return p.state.where("entry AND reachable").select("node")
    if target == "all":
        return p.reached.select("node")
    name = target.removeprefix("node:")
    if p.state.where(F.col("node") == name).isEmpty():
        raise ValueError(f"unknown node: {name}")
    of = arrows(p, name, structure)
    of = of if excluded else of.where("NOT excluded")
    return of.join(p.state.select("node", (~F.col("reachable")).alias("unreachable")), "node")


def with_views(p: Prepared, rows: DataFrame, views: list[MetricView]) -> DataFrame:
    """A column for each view, named as it is written."""
    nodes = saved(rows.select("node").distinct()) if views else rows
    for view in views:
        rows = rows.join(view_values(p, nodes, view).withColumnRenamed("value", str(view)), "node", "left")
    return rows


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: DataFrame


def placed(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in an order, saved, with the position of each (from 1, rows before the page counted), which outlasts joins."""
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return saved(page.withColumn("position", F.row_number().over(Window.orderBy(*order)) + offset))  # a page is as small as its limit


def explore(p: Prepared, target: str | NodeSelection = "entry_points", views: list[MetricView] | None = None, sort: str | None = None, descending: bool = True, offset: int = 0, limit: int = 50, structure: str = "forward", excluded: bool = False) -> Page:
    """A page of a target's rows with columns of views, and how many rows there are in all.

    Rows stand in order, and ``position`` says where. ``sort`` is ``name`` or a view; ties, and rows without a sort, stand in the order of the edges, then of names. The value
    that is sorted by is made for all rows, the other columns for the page only.
    """
    rows = saved(targets(p, target, structure, excluded))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    views = available_views(p) if views is None else views
    natural = ["ord", "node"] if "ord" in rows.columns and structure == "forward" else ["node"]
    order, made = [], None
    if sort == "name":
        order = [F.col("node").desc() if descending else F.col("node").asc()]
    elif sort:
        made = MetricView.parse(sort)
        rows = with_views(p, rows, [made])
        order = [F.col(f"`{made}`").desc() if descending else F.col(f"`{made}`").asc()]
    page = placed(rows, [*order, *natural], offset, limit)
    rest = [v for v in views if made is None or str(v) != str(made)]
    return Page(with_views(p, page, rest).orderBy("position"), total)


def changed(diff: DataFrame, left_state: DataFrame, right_state: DataFrame) -> DataFrame:
    """(node, diff, changed): changed edges, metrics or existence, or reachability where both sides have the node."""
    reach = lambda s, c: s.select("node", F.col("reachable").alias(c))
    rows = diff.join(reach(left_state, "_l"), "node", "left").join(reach(right_state, "_r"), "node", "left")
    return rows.select("node", "diff", ((F.col("diff") != 0) | F.coalesce(F.col("_l") != F.col("_r"), F.lit(False))).alias("changed"))


def compared(left: Prepared, right: Prepared) -> DataFrame:
    """(node, diff, changed) of two graphs (see changed). Of one graph under two configurations only the nodes that either reaches: the others are unchanged, and edges and metrics need no comparison."""
    if not left.same_graph(right):
        return changed(twin.node_diff((left.nodes, left.node_metrics, left.edges), (right.nodes, right.node_metrics, right.edges)), left.state, right.state)
    sides = [p.reached.select("node", F.lit(True).alias(c)) for p, c in ((left, "_l"), (right, "_r"))]
    return sides[0].join(sides[1], "node", "full_outer").select("node", F.lit(0).alias("diff"), (F.col("_l").isNull() | F.col("_r").isNull()).alias("changed"))


def delta_values(left: Prepared, right: Prepared, nodes: DataFrame, view: MetricView, diff: DataFrame | None = None) -> DataFrame:
    """(node, value) of a view with a side: the right graph's (no side), the left's, or the difference.

    Sums by tier and counts of what is reached differ by what changed only (exclusive); other views by plain subtraction. A missing side is 0.
    """
    base = replace(view, side=None)
    if view.side != "delta":
        return view_values(left if view.side == "left" else right, nodes, base)
    if base.kind in ("tiered", "count_transitive"):
        pairs = [p.reached_by(nodes) for p in (left, right)]
        if base.kind == "count_transitive":
            got = twin.exclusive_delta(*pairs, left.state, right.state)
        else:
            at = right.tiers.index(base.tier) if base.tier in right.tiers else -1
            got = twin.exclusive_tiered(pairs, left, right, base.metric, diff).where(F.col("tier") == at).select("root", "delta")
        return nodes.select("node").distinct().join(got.select(F.col("root").alias("node"), F.col("delta").alias("value")), "node", "left").fillna(0.0, ["value"])
    a, b = (view_values(p, nodes, base) for p in (left, right))
    return b.join(a.withColumnRenamed("value", "_left"), "node").select("node", (F.col("value") - F.col("_left")).alias("value"))


def has_delta(view: MetricView) -> bool:
    """Whether a difference of the view means something: tier numbers are names."""
    return view.kind != "tier"


def default_columns(views: list[MetricView]) -> list[MetricView]:
    """Each view of the right graph, followed by its difference where that means something."""
    return [c for v in views for c in (v, replace(v, side="delta")) if c.side is None or has_delta(v)]


def explore_delta(left: Prepared, right: Prepared, target: str | NodeSelection = "all", columns: list[MetricView] | None = None, sort: str | None = None, descending: bool = True, magnitude: bool = True, changed_only: bool = False, offset: int = 0, limit: int = 50) -> Page:
    """A page of the rows of a comparison (node, diff, changed, and a column for each view), and their number: total, and hidden as unchanged.

    Entry points of both sides, what either side reaches (``all``) and what a selection matches on either side are put together. Differences are sorted by their size,
    unless ``magnitude`` is off. Rows of ``node:`` and a name are the targets of its edges that are followed on one side at least, with in_left and in_right.
    """
    if isinstance(target, str) and target.startswith("node:"):
        ends = [p.edges.where(F.col("src") == target.removeprefix("node:")).where("NOT excluded").select(F.col("dst").alias("node"), F.lit(True).alias(s)).distinct() for p, s in ((left, "in_left"), (right, "in_right"))]
        found = ends[0].join(ends[1], "node", "full_outer").fillna(False, ["in_left", "in_right"])
    else:
        found = targets(left, target).select("node").unionByName(targets(right, target).select("node")).distinct()
    diff = saved(compared(left, right))
    rows = saved(found.join(diff, "node", "left").fillna(0, ["diff"]).fillna(False, ["changed"]))
    shown = rows.where("changed") if changed_only else rows
    total = rows.agg(F.count_if("changed").alias("_c"), F.count(F.lit(1)).alias("_n")).select(F.col("_c" if changed_only else "_n").alias("total"), (F.col("_n") - F.col("_c") if changed_only else F.lit(0).cast("long")).alias("hidden"))
    columns = default_columns([MetricView("", "parents")]) if columns is None else columns
    order = []
    if sort == "name":
        order = [F.col("node").desc() if descending else F.col("node").asc()]
    elif sort:
        by = MetricView.parse(sort)
        shown = shown.join(delta_values(left, right, shown, by, diff).withColumnRenamed("value", "_by"), "node")
        key = F.abs("_by") if magnitude and by.side == "delta" else F.col("_by")
        order = [key.desc() if descending else key.asc()]
    page = placed(shown, [*order, "node"], offset, limit).drop("_by")
    nodes = saved(page.select("node")) if columns else page
    for view in columns:
        page = page.join(delta_values(left, right, nodes, view, diff).withColumnRenamed("value", str(view)), "node")
    return Page(page.orderBy("position"), total)
