"""Selecting nodes by declarative conditions, all of which must hold."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import saved


@dataclass(frozen=True)
class NodeSelection:
    name: str | None = None
    substring: str | None = None
    regex: str | None = None
    fuzzy: str | None = None
    properties: dict[str, str | None] = field(default_factory=dict)
    metrics: dict[str, int] = field(default_factory=dict)
    incoming_tags: tuple[str, ...] = ()
    outgoing_tags: tuple[str, ...] = ()
    incoming_keys: tuple[str, ...] = ()
    outgoing_keys: tuple[str, ...] = ()
    reachable_only: bool = False
    limit: int = 1000


def select_nodes(nodes: DataFrame, s: NodeSelection, node_metrics: DataFrame | None = None, edges: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """(node). Blank substrings are no condition; a bad pattern is an error; unknown properties and metrics select nothing."""
    out = nodes
    for key, value in s.properties.items():
        held = F.element_at("props", key)
        out = out.where(held.isNotNull() if value is None else held == value)
    if s.name is not None:
        out = out.where(F.col("node") == s.name)
    if s.substring and s.substring.strip():
        out = out.where(F.lower("node").contains(s.substring.lower()))
    if s.regex is not None:
        re.compile(s.regex)
        out = out.where(F.col("node").rlike(s.regex))
    if s.fuzzy:
        out = out.where(F.lower("node").rlike(".*".join(map(re.escape, s.fuzzy.lower()))))
    out = out.select("node")
    if s.reachable_only:
        out = out.join(state.where("reachable").select("node"), "node", "left_semi")
    for metric, value in s.metrics.items():
        of = node_metrics.where(F.col("metric") == metric)
        if value == 0:  # a missing value is 0, but a metric that no node has selects nothing
            out = out.where(F.lit(not of.isEmpty())).join(of.where(F.round("value").cast("long") != 0).select("node"), "node", "left_anti")
        else:
            out = out.join(of.where(F.round("value").cast("long") == value).select("node"), "node", "left_semi")
    live = edges.where("NOT excluded") if edges is not None and "excluded" in edges.columns else edges
    ends = None
    for column, end, wanted in (("tag", "dst", s.incoming_tags), ("tag", "src", s.outgoing_tags), ("type_key", "dst", s.incoming_keys), ("type_key", "src", s.outgoing_keys)):
        for value in wanted:
            part = live.where(F.col(column) == value).select(F.col(end).alias("node"))
            ends = part if ends is None else ends.join(part, "node", "left_semi")
    if ends is not None:  # what edges say is settled once, before the tables of nodes are read
        out = out.join(saved(ends.distinct()), "node", "left_semi")
    return out.orderBy(F.octet_length("node"), "node").limit(s.limit) if s.fuzzy else out


def filter_candidates(nodes: DataFrame, edges: DataFrame, most: int = 256) -> DataFrame:
    """(kind, name, n_values, values): property values (none listed if more than ``most``), tags and type keys."""
    pairs = nodes.select(F.explode("props").alias("name", "value")).distinct()
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n_values"))
    few = pairs.join(counts.where(F.col("n_values") <= most), "name", "left_semi").groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("values"))
    none = F.array().cast("array<string>")
    props = counts.join(few, "name", "left").select(F.lit("property").alias("kind"), "name", "n_values", F.coalesce("values", none).alias("values"))
    for column, kind in (("tag", "tag"), ("type_key", "type_key")):
        props = props.unionByName(edges.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().select(F.lit(kind).alias("kind"), "name", F.lit(1).cast("long").alias("n_values"), none.alias("values")))
    return props
