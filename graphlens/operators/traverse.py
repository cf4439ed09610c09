"""Configured traversal: entry points, super root, reachability and ascending tiers."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.plans.config import TraversalConfig

from .dominators import dominator_tree, jump_table
from .fixpoint import LARGE, Near, dealt, reach, reach_set, saved, saved_by
from .rules import apply_rules, may_follow
from .scc import source_entry_points

SUPER_ROOT = "~root~"


@dataclass
class Prepared:
    """Edges with their verdicts, and what is reached over them."""

    nodes: DataFrame
    node_metrics: DataFrame
    edges: DataFrame
    entry: DataFrame  # (node), saved
    reached: DataFrame  # (node, tier), saved
    tiers: list[str]
    open_steps: DataFrame  # (src, dst, stamp, parallel) of all edges that are not excluded, each pair once; no parallel where only pairs are held
    graph: tuple  # the frames that were given: nodes, metrics and edges, and these again with the super root, if there is one

    def same_graph(self, other: Prepared) -> bool:
        """Whether both are made of the very same nodes, metrics and edges, so that they differ in what is followed only."""
        return all(a is b for a, b in zip(self.graph, other.graph))

    @cached_property
    def state(self) -> DataFrame:
        """(node, reachable, tier, entry) of every node."""
        found = all_nodes(self.nodes, self.edges).join(self.reached, "node", "left").join(self.entry.withColumn("_entry", F.lit(True)), "node", "left")
        tier = F.col("tier") if self.tiers else F.lit(None).cast("int")
        return saved(found.select("node", F.col("tier").isNotNull().alias("reachable"), tier.alias("tier"), F.coalesce("_entry", F.lit(False)).alias("entry")))

    @cached_property
    def followed(self) -> DataFrame:
        """Edges that are followed from reachable nodes."""
        return saved(self.edges.where("NOT excluded").join(self.reached.select(F.col("node").alias("src")), "src", "left_semi"))

    @cached_property
    def live(self) -> DataFrame:
        """(src, dst, parallel): the pairs of edges that are followed from reachable nodes, not saved; without parallel where only pairs are held."""
        return self.open_steps.join(self.reached.select(F.col("node").alias("src")), "src", "left_semi").drop("stamp")

    @cached_property
    def steps(self) -> DataFrame:
        """(src, dst, parallel) of them, each pair once, with how many there are."""
        return saved_by(self.live, self.open_steps.count(), "src")

    @cached_property
    def parents(self) -> DataFrame:
        """(node, parents) of nodes with followed edges into them, parallel ones counted. All of these nodes are reachable."""
        steps = self.__dict__.get("steps", self.live)
        return saved(steps.groupBy(F.col("dst").alias("node")).agg(F.sum("parallel").alias("parents")))

    def reached_by(self, nodes: DataFrame) -> DataFrame:
        """(root, node) of some nodes and what they reach over followed edges, made once for the same frame of nodes."""
        held = self.__dict__.setdefault("_reached", [])
        for of, pairs in held:
            if of is nodes:
                return pairs
        live = nodes.select("node").distinct().join(self.reached.select("node"), "node", "left_semi")
        pairs = saved(reach(self.steps, live.select(F.col("node").alias("root"), "node"), self.steps).select("root", "node"))
        held.append((nodes, pairs))
        return pairs

    @cached_property
    def tree(self) -> DataFrame:
        """(node, idom): the dominators from the only entry point; graphs with several need a root over them (see with_super_root)."""
        return saved(dominator_tree(self.__dict__.get("steps", self.live), self.entry, self.reached))

    @cached_property
    def jumps(self) -> DataFrame:
        """The jump table of the dominators."""
        return jump_table(self.tree)


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared nodes and targets that are not declared."""
    return nodes.select("node").unionByName(edges.select(F.col("dst").alias("node"))).unionByName(edges.select(F.col("src").alias("node"))).distinct()


def with_super_root(edges: DataFrame, entry: DataFrame, forced: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges and entry points with one root over all of two or more entry points."""
    if not forced and entry.limit(2).count() < 2:
        return edges, entry
    name = SUPER_ROOT
    while edges.where((F.col("src") == name) | (F.col("dst") == name)).limit(1).count():
        name = f"~{name}~"
    none = F.lit(None).cast("string")
    at = {"src": F.lit(name), "dst": F.col("node"), "kind": F.lit("directed"), "edge_ord": F.xxhash64("node")}
    more = entry.select(*[at.get(c, none).cast(edges.schema[c].dataType).alias(c) for c in edges.columns])
    return edges.unionByName(more), edges.sparkSession.range(1).select(F.lit(name).alias("node"))


def open_steps(edges: DataFrame, count: int, rows: int | None = None, by_src: bool = False, counted: bool = True) -> DataFrame:
    """(src, dst, stamp, parallel): the pairs of edges that are followed, with their least stamp below a number of tiers, and how many edges they have.

    ``rows``: about how many edges there are, if the edges are not saved; ``by_src``: they are dealt by src already, so that pairs are met without a shuffle;
    ``counted``: without it there is no ``parallel``.
    """
    live = edges.where(~F.col("excluded") & (F.coalesce("to_tier", F.lit(0)) < max(1, count))).select("src", "dst", F.coalesce("to_tier", F.lit(0)).alias("stamp"))
    rows = edges.count() if rows is None else rows
    return saved_by((live if by_src else dealt(live, rows, "src")).groupBy("src", "dst").agg(F.min("stamp").alias("stamp"), *([F.count(F.lit(1)).alias("parallel")] if counted else [])), rows, "src")


def tiers_of(steps: DataFrame, entry: DataFrame, keys: tuple[str, ...] = (), stamp: Column | None = None) -> DataFrame:
    """(*keys, node, tier), for each of the keys of the entry points by itself: the least tier in which a node is reached by steps (see open_steps), where a tier rises along a path to the greatest stamp.

    One loop: a round carries on only the nodes that it reached first or at a lower tier than before. ``stamp``: the stamp of a step, if it depends on the keys; null where they do not follow it.
    """
    stamp = F.col("stamp") if stamp is None else stamp
    frontier = saved(entry.select(*keys, "node", F.lit(0).alias("tier")).distinct())
    best, near = frontier, Near(steps)
    for turn in itertools.count(1):
        at_hand = near(frontier)
        if at_hand is None:
            return best.groupBy(*keys, "node").agg(F.min("tier").alias("tier"))
        reached = frontier.join(at_hand, F.col("node") == F.col("src")).where(stamp.isNotNull()).groupBy(*keys, F.col("dst").alias("node")).agg(F.min(F.greatest(F.col("tier"), stamp)).alias("tier"))
        known = best.groupBy(*keys, "node").agg(F.min("tier").alias("_known"))
        frontier = saved(reached.join(known, [*keys, "node"], "left").where("_known IS NULL OR tier < _known").select(*keys, "node", "tier"))
        best = best.unionByName(frontier)
        if turn % 8 == 0:
            best = saved(best.groupBy(*keys, "node").agg(F.min("tier").alias("tier")))


def _known(entry: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The entry points (saved; node) that the graph has."""
    strange = saved(entry.join(nodes.select("node"), "node", "left_anti"))
    if strange.isEmpty():
        return entry
    named = edges.select(F.explode(F.array("src", "dst")).alias("node")).join(strange, "node", "left_semi").distinct()
    return saved(entry.join(strange, "node", "left_anti").unionByName(named))


def laid(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """The edges as a table, bucketed by src if they are many, for several configurations. ``rows``: about how many there are, if that is known."""
    if rows is None:
        edges = saved(edges)
        rows = edges.count()
        if rows <= LARGE:
            return edges
    return saved_by(dealt(edges, rows, "src"), rows, "src")


def prepare(nodes: DataFrame, node_metrics: DataFrame, edges: DataFrame, config: TraversalConfig | None = None, entry: DataFrame | None = None, super_root: bool = False, rows: int | None = None, held: str = "judged") -> Prepared:
    """Apply a configuration. Entry points are settled before it is applied: those given, or the sources of the graph.

    ``rows``: about how many edges there are, if that is known before they are made. ``held``: what of the edges lies in a table: ``judged`` (they are saved with
    their verdicts), ``laid`` (they are from ``laid`` already; verdicts are made as they are read), ``steps`` (only the pairs that are followed are saved; for what asks for nothing else)
    or ``pairs`` (the same, but parallel edges are not counted, so that the same edge may be given several times).
    """
    config = config or TraversalConfig()
    given = edges
    if entry is None:
        entry = source_entry_points(all_nodes(nodes, edges), edges)
    entry = saved(entry.select("node").distinct())
    edges, entry = with_super_root(edges, entry, super_root)
    rooted = edges is not given
    judged = apply_rules(edges, nodes, config)
    if held == "judged" or rooted:
        judged = laid(judged, rows) if rows else saved(judged)
    by_src = held == "laid" and not rooted or held == "judged" and rows is not None and rows > LARGE
    few = held in ("steps", "pairs") and not rooted
    steps = open_steps(apply_rules(edges.where(may_follow(config)), nodes, config) if few else judged, len(config.tiers), rows, by_src, held != "pairs")
    entry = _known(saved(entry), nodes, judged)
    reached = saved(tiers_of(steps, entry))
    return Prepared(nodes, node_metrics, judged, entry, reached, [t[0] for t in config.tiers], steps, (nodes, node_metrics, given, edges))


def prepare_all(nodes: DataFrame, node_metrics: DataFrame, edges: DataFrame, configs: list[TraversalConfig], entry: DataFrame, rows: int | None = None, by_src: bool = False, counted: bool = True) -> list[Prepared]:
    """One graph under several configurations, from the same entry points: the pairs that one of them follows lie in one table, with a stamp for each, and one loop reaches for all.

    ``rows``, ``by_src``, ``counted``: see open_steps. The edges with their verdicts are not saved; they are made as they are read, best from edges that are ``laid``.
    """
    given, entry = edges, saved(entry.select("node").distinct())
    edges, entry = with_super_root(edges, entry)
    if rows is None:
        edges = saved(edges)
        rows = edges.count()
    stamp = F.coalesce("to_tier", F.lit(0))
    live = edges.where(reduce(Column.__or__, map(may_follow, configs)))
    for k, c in enumerate(configs):
        followed = ~F.col("excluded") & (stamp < max(1, len(c.tiers)))
        live = apply_rules(live, nodes, c).withColumn(f"stamp{k}", F.when(followed, stamp)).drop("excluded", "to_tier", "rule")
    stamps = [F.col(f"stamp{k}") for k in range(len(configs))]
    live = live.where(F.coalesce(*stamps).isNotNull()).select("src", "dst", *stamps)
    pairs = (live if by_src and edges is given else dealt(live, rows, "src")).groupBy("src", "dst").agg(*[F.min(s).alias(f"stamp{k}") for k, s in enumerate(stamps)], *[F.count(s).alias(f"parallel{k}") for k, s in enumerate(stamps) if counted])
    pairs = saved_by(pairs, rows, "src")
    entry = _known(saved(entry), nodes, edges)
    own = F.element_at(F.array(*stamps), F.col("side") + 1)
    reached = saved(tiers_of(pairs, entry.select("node", F.explode(F.array(*map(F.lit, range(len(configs))))).alias("side")), ("side",), own))
    sides = []
    for k, c in enumerate(configs):
        steps = pairs.where(stamps[k].isNotNull()).select("src", "dst", stamps[k].alias("stamp"), *([F.col(f"parallel{k}").alias("parallel")] if counted else []))
        sides.append(Prepared(nodes, node_metrics, apply_rules(edges, nodes, c), entry, reached.where(F.col("side") == k).select("node", "tier"), [t[0] for t in c.tiers], steps, (nodes, node_metrics, given, edges)))
    return sides


def restrict(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a graph that roots reach over all edges: its nodes and edges. Unknown roots fall out."""
    edges = saved(edges)
    known = edges.select(F.explode(F.array("src", "dst")).alias("node")).join(F.broadcast(roots.select("node").distinct()), "node").distinct()  # the names asked for at most
    inside = saved(reach_set(edges, known).select("node"))
    return inside, edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi")
