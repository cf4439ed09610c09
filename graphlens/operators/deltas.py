"""Changes between versions of a whole graph: one table of changes for each of its tables.

Parts: nodes (by name), metrics (value by node and metric), properties (value by node and key), labels (a set of values by node and
label) and edges (by all their columns). A change is a row (op, key..., value) as in ``versions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.sources.tables import Graph

from . import versions

EDGE = ["src", "dst", "kind", "tag", "type_key", "edge_name", "branch", "metadata"]
#: Keys and value of each part.
PARTS = {
    "nodes": (["node"], "held"),
    "metrics": (["node", "metric"], "value"),
    "properties": (["node", "name"], "value"),
    "labels": (["node", "name", "label"], "held"),
    "edges": (EDGE, "held"),
}
#: Stands for null in the keys of changes, which are joined by equality.
NONE = "\x00"


def parts_of(g: Graph) -> dict[str, DataFrame]:
    held = F.lit(1).alias("held")
    edges = g.edges if "metadata" in g.edges.columns else g.edges.withColumn("metadata", F.lit(None).cast("string"))
    return {
        "nodes": g.nodes.select("node", held),
        "metrics": g.node_metrics.select("node", "metric", "value"),
        "properties": g.nodes.select("node", F.explode("props").alias("name", "value")),
        "labels": g.nodes.select("node", F.explode("labels").alias("name", "of")).select("node", "name", F.explode(F.array_distinct("of")).alias("label"), held),
        "edges": edges.select(*[F.coalesce(c, F.lit(NONE)).alias(c) for c in EDGE]).distinct().withColumn("held", F.lit(1)),
    }


def graph_of(parts: dict[str, DataFrame]) -> Graph:
    """The graph of its parts, again; edges without an order."""
    props = parts["properties"].groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("props"))
    sets = parts["labels"].groupBy("node", "name").agg(F.sort_array(F.collect_set("label")).alias("of"))
    labels = sets.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("name", "of"))).alias("labels"))
    nodes = parts["nodes"].select("node").join(props, "node", "left").join(labels, "node", "left")
    empty = {"props": F.create_map().cast("map<string,string>"), "labels": F.create_map().cast("map<string,array<string>>")}
    nodes = nodes.select("node", *[F.coalesce(c, v).alias(c) for c, v in empty.items()])
    edges = parts["edges"].select(*[F.when(F.col(c) != NONE, F.col(c)).alias(c) for c in EDGE]).withColumn("edge_ord", F.lit(None).cast("long"))
    return Graph(nodes, parts["metrics"].select("node", "metric", "value"), edges)


def derive(old: Graph, new: Graph) -> dict[str, DataFrame]:
    """The changes of each part; values count as equal if they are the same or both null."""
    a, b = parts_of(old), parts_of(new)
    return {part: versions.derive(a[part], b[part], keys, value) for part, (keys, value) in PARTS.items()}


def merge(deltas: dict[str, DataFrame], order: str = "graph_id") -> dict[str, DataFrame]:
    """Changes of several steps, numbered by ``order``, as those of one."""
    return {part: versions.merge(deltas[part], keys, value, order) for part, (keys, value) in PARTS.items()}


def apply(base: Graph, deltas: dict[str, DataFrame], order: str = "graph_id") -> Graph:
    """The base with changes applied in order. A change of a key that is not there is a violation (see ``violations``), not an addition."""
    of = parts_of(base)
    numbered = {p: d if order in d.columns else d.withColumn(order, F.lit(0)) for p, d in deltas.items()}
    return graph_of({part: versions.apply(of[part], numbered[part], keys, value, order) for part, (keys, value) in PARTS.items()})


def violations(base: Graph, deltas: dict[str, DataFrame]) -> DataFrame:
    """(part, op, key): changes of one step that do not fit the base: keys added that are there, changed or removed that are not."""
    of, out = parts_of(base), None
    for part, (keys, _) in PARTS.items():
        rows = deltas[part].join(of[part].select(*keys, F.lit(True).alias("_there")), keys, "left")
        bad = rows.where((F.col("op") == "add") == F.coalesce("_there", F.lit(False))).select(F.lit(part).alias("part"), "op", F.concat_ws(" ", *keys).alias("key"))
        out = bad if out is None else out.unionByName(bad)
    return out
