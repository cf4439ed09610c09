"""What a graph holds at a glance, and search for nodes with their documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.plans.config import MetricView
from graphlens.sources.documents import to_specs
from graphlens.sources.tables import Graph

from .fixpoint import saved
from .selection import NodeSelection, select_nodes
from .traverse import Prepared


def stats(p: Prepared) -> DataFrame:
    """One row: nodes, those not reached, edges, those of each kind and those excluded; an excluded edge counts in its kind too."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_edges") for k in ("directed", "tagged", "dynamic")]
    edges = p.edges.agg(F.count(F.lit(1)).alias("edges"), *kinds, F.count_if("excluded").alias("excluded_edges"))
    nodes = p.state.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("reachable")).alias("unreachable_nodes"))
    return nodes.crossJoin(F.broadcast(edges))  # one row each


def metric_views(node_metrics: DataFrame, tiers: list[str], dominated: bool = True) -> DataFrame:
    """(metric, nodes, views): each metric with the number of nodes that hold it and what it can be shown as.

    The views of no metric (counts, and the tier if there are tiers) stand under null. Without ``dominated``, views of what a node dominates are left out, as where no dominators are shown.
    """
    kinds = [("self", None), ("transitive", None), ("dominated", None), *[(k, t) for t in tiers for k in ("tiered", "tiered_dominated")]]
    tail = [str(MetricView("", kind, tier)) for kind, tier in kinds if dominated or "dominated" not in kind]
    none = [k for k in ("parents", "count_transitive", "count_dominated", *(["tier"] if tiers else [])) if dominated or "dominated" not in k]
    of = node_metrics.groupBy("metric").agg(F.count_distinct("node").alias("nodes"))
    of = of.select("metric", "nodes", F.transform(F.array(*map(F.lit, tail)), lambda t: F.concat("metric", t)).alias("views"))
    rest = node_metrics.sparkSession.range(1).select(F.lit(None).cast("string").alias("metric"), F.lit(0).cast("long").alias("nodes"), F.array(*[F.lit(str(MetricView("", k))) for k in none]).alias("views"))
    return of.unionByName(rest)


def search(g: Graph, selection: NodeSelection, limit: int = 30) -> DataFrame:
    """(node, spec): the first ``limit`` matches by name, or the best of a fuzzy search, with their documents; no configuration applies, so nodes that one would leave out are found too."""
    found = select_nodes(g.nodes, replace(selection, limit=limit, reachable_only=False), g.node_metrics, g.edges)
    found = F.broadcast(saved(found if selection.fuzzy else found.orderBy("node").limit(limit)))  # at most limit rows
    out = g.edges.join(found.withColumnRenamed("node", "src"), "src", "left_semi")
    return to_specs(Graph(g.nodes.join(found, "node", "left_semi"), g.node_metrics.join(found, "node", "left_semi"), out))
