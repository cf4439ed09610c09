"""Contraction of nodes into groups, and routes: named sets of entry points with what they load at once and later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import dealt, saved, saved_by
from .traverse import tiers_of

FORM = ["kind", "tag", "type_key", "edge_name", "branch"]


def contract(nodes: DataFrame, node_metrics: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, members), metrics summed and edges of a graph whose nodes are the groups (node, group); a node without one stays alone.

    Edges within a group fall out; parallel ones of the same form become one. Pairs are made different before each
    shuffle, so that a group with many members is met by few rows.
    """
    of = groups.select("node", F.col("group").alias("_group")).where("_group IS NOT NULL")
    known = nodes.select("node").distinct().join(of, "node", "left").withColumn("_group", F.coalesce("_group", "node"))
    members = known.groupBy(F.col("_group").alias("node")).agg(F.count(F.lit(1)).alias("members"))
    end = lambda df, c: df.join(of.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("_group", c)).drop("_group")
    sums = end(node_metrics, "node").groupBy("node", "metric").agg(F.sum("value").alias("value"))
    form = [c for c in FORM if c in edges.columns]
    rest = saved(edges.select("src", "dst", *form))
    rows = rest.count()
    made = end(dealt(rest, rows, "src").distinct(), "src")
    made = end(dealt(made, rows, "dst").distinct(), "dst").where("src <> dst").distinct()
    return members, sums, made


def route_entries(edges: DataFrame, nodes: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(route, node) of the entry points (nodes that no edge enters) of each route, and the entry points (node) of none. ``membership``: (node, route).

    An entry point belongs to its own routes. One that has none belongs to the routes that all of its targets with any route share: those that as many of
    its targets have as have a route at all.
    """
    entries = saved(nodes.select("node").distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti"))
    of = membership.select("node", "route").distinct()
    direct = saved(entries.join(of, "node").select("route", "node"))
    open_ = entries.join(direct.select("node"), "node", "left_anti")
    targets = edges.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst").distinct()
    said = targets.join(of.withColumnRenamed("node", "dst"), "dst")
    votes = said.groupBy("src", "route").agg(F.count(F.lit(1)).alias("_votes"))
    voters = said.groupBy("src").agg(F.count_distinct("dst").alias("_all"))
    shared = votes.join(voters, "src").where("_votes = _all").select("route", F.col("src").alias("node"))
    found = saved(direct.unionByName(shared))
    return found, entries.join(found.select("node"), "node", "left_anti")


def route_sizes(routes: DataFrame, edges: DataFrame, node_metrics: DataFrame, metric: str, by_src: bool = False) -> DataFrame:
    """(route, eager, lazy): sums of a metric over what a route reaches by edges that are not lazy, and over what it reaches besides.

    ``routes``: (route, node); ``edges``: (src, dst, lazy), saved; ``by_src``: they are from ``traverse.laid``. All routes are searched together in one loop, each from its own
    entry points: what is lazy is a second tier.
    """
    rows = edges.count()
    stamped = edges.select("src", "dst", F.when(~F.col("lazy"), 0).otherwise(1).alias("stamp"))
    steps = saved_by((stamped if by_src else dealt(stamped, rows, "src")).groupBy("src", "dst").agg(F.min("stamp").alias("stamp")), rows, "src")
    value = node_metrics.where(F.col("metric") == metric).select("node", "value")
    found = tiers_of(steps, routes, ("route",)).join(value, "node")
    sums = found.groupBy("route").agg(F.sum(F.when(F.col("tier") == 0, F.col("value")).otherwise(0.0)).alias("eager"), F.sum(F.when(F.col("tier") > 0, F.col("value")).otherwise(0.0)).alias("lazy"))
    return routes.select("route").distinct().join(sums, "route", "left").fillna(0.0, ["eager", "lazy"])
