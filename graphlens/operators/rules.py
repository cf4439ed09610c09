"""Edge rules: which edges are followed, and which tier they move to, as columns of one projection.

Rules apply in a fixed order and later ones overwrite earlier ones: dynamic edges, tags, labels of
the target, single edges, nodes (by the edges into them). An edge whose tag or type key moves above the
greatest tier is excluded and not stamped; the last three rules may still include it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.plans.config import TraversalConfig

#: Decisions for names are literal conditions up to this many, and joins beyond.
LITERALS = 200
#: Nodes that labels decide are broadcast up to this many.
FEW = 500_000


def _tiers(config: TraversalConfig) -> tuple[dict[str, int], dict[str, int]]:
    """Tags and type keys to tiers; the last tier that lists one wins."""
    tags, keys = {}, {}
    for k, (_, of_tags, of_keys) in enumerate(config.tiers):
        tags |= dict.fromkeys(of_tags, k)
        keys |= dict.fromkeys(of_keys, k)
    return tags, keys


def _lookup(column: Column, table: dict) -> Column:
    if not table:
        return F.lit(None)
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), column)


def _branch(branches: tuple[str, list[str]]) -> Column:
    listed = F.col("branch").isin(branches[1]) if branches[1] else F.lit(False)
    return listed if branches[0] == "include" else ~listed


def _dynamic(config: TraversalConfig) -> Column:
    """The decision of the dynamic rules, null where none speaks."""
    out = F.lit(None).cast("boolean")
    for key, of in config.force_dynamic.items():
        verdict = _branch(of["default"]) if of.get("default") else F.lit(None).cast("boolean")
        for name, o in (of.get("overrides") or {}).items():
            branches, decision = o.get("branches"), o.get("decision")
            own = verdict if decision is None else F.lit(decision)
            if branches:
                listed = F.col("branch").isin(branches[1]) if branches[1] else F.lit(False)
                own = _branch(branches) if decision is None else F.when(listed, _branch(branches)).otherwise(F.lit(decision))
            verdict = F.when(F.col("edge_name") == name, own).otherwise(verdict)
        out = F.when(F.col("type_key") == key, verdict).otherwise(out)
    return F.when(F.col("kind") == "dynamic", out)


def _of_edges(config: TraversalConfig) -> tuple[Column, Column, list[tuple[str, Column]]]:
    """The tier of an edge, whether that is above the greatest one, and the rules that ask for nothing but the edge's kind, tag, key and branch."""
    tag_tier, key_tier = _tiers(config)
    tier = F.when(F.col("kind") == "tagged", _lookup(F.col("tag"), tag_tier)).when(F.col("kind") == "dynamic", _lookup(F.col("type_key"), key_tier)).cast("int")
    above = tier > config.max_tier if config.max_tier is not None else F.lit(False)
    above = F.coalesce(above, F.lit(False))
    return tier, above, [
        ("force_dynamic", F.when(~above, _dynamic(config))),
        ("force_tagged", F.when(~above & (F.col("kind") == "tagged"), _lookup(F.col("tag"), config.force_tagged)).cast("boolean")),
        ("max_tier", F.when(above, F.lit(False))),
    ]


def _of_names(config: TraversalConfig) -> list[tuple[str, Column]]:
    """The rules for single edges and nodes, where these are few."""
    one = reduce(lambda acc, e: F.when((F.col("src") == e[0][0]) & (F.col("dst") == e[0][1]), F.lit(e[1])).otherwise(acc), config.force_edges.items(), F.lit(None).cast("boolean"))
    return [("force_edge", one), ("force_node", _lookup(F.col("dst"), config.force_nodes).cast("boolean"))]


def may_follow(config: TraversalConfig) -> Column:
    """Whether an edge is followed, whatever the labels of its target say: false only where it is excluded for certain. Asks for nothing but the edge, so that it can be settled before edges are made different and dealt."""
    if len(config.force_edges) > LITERALS or len(config.force_nodes) > LITERALS:
        return F.lit(True)
    rules = [c for _, c in _of_edges(config)[2]]
    rules += [F.lit(True)] if any(decision for *_, decision in config.label_predicates) else []
    return F.coalesce(*[c for _, c in reversed(_of_names(config))], *reversed(rules), F.lit(True))


def apply_rules(edges: DataFrame, nodes: DataFrame, config: TraversalConfig) -> DataFrame:
    """The edges with excluded, to_tier and rule (the one that decided, null if none did)."""
    tier, above, rules = _of_edges(config)
    out = edges
    if config.label_predicates:
        held = lambda name: F.element_at("labels", name)
        of = [F.when(held(name).isNotNull() & (F.array_contains(held(name), value) == F.lit(contains)), F.lit(decision)) for name, value, contains, decision in config.label_predicates]
        said = nodes.select(F.col("node").alias("dst"), F.coalesce(*reversed(of)).alias("_label")).where("_label IS NOT NULL")  # only what a predicate decides
        out = out.join(F.broadcast(said) if said.count() <= FEW else said, "dst", "left")
        rules.append(("label", F.col("_label")))
    if len(config.force_edges) > LITERALS or len(config.force_nodes) > LITERALS:
        spark = edges.sparkSession
        pairs = spark.createDataFrame([(a, b, d) for (a, b), d in config.force_edges.items()], "src string, dst string, _edge boolean")
        names = spark.createDataFrame(list(config.force_nodes.items()), "dst string, _node boolean")
        out = out.join(pairs, ["src", "dst"], "left").join(names, "dst", "left")
        rules += [("force_edge", F.col("_edge")), ("force_node", F.col("_node"))]
    else:
        rules += _of_names(config)
    verdict = F.coalesce(*[c for _, c in reversed(rules)], F.lit(True))
    spoke = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in reversed(rules)])
    extra = [c for c in ("_label", "_edge", "_node") if c in out.columns]
    return out.select("*", (~verdict).alias("excluded"), F.when(~above, tier).alias("to_tier"), spoke.alias("rule")).drop(*extra)


def overlay(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """What-if: (src, dst, ord, follow) wins over exclusion, the greatest ord of a pair over the others."""
    last = overrides.groupBy("src", "dst").agg(F.max_by("follow", "ord").alias("_follow"))
    return edges.join(last, ["src", "dst"], "left").withColumn("excluded", F.coalesce(~F.col("_follow"), F.col("excluded"))).drop("_follow")
