"""Graphs as JSON documents: read, made from tables, and written.

A document names its nodes in one map. It is also kept as lines, one node each
({"node": name, "spec": {...}}), which is the form that scales: no task sees a whole graph.
A whole document is written as sorted lines too; its part files in order are the document.
Sections that are absent or null are empty; a target that is not a node of its own becomes one without values.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Graph, with_order

#: Fixed format: the sections of a node.
SPEC = (
    "properties map<string,string>, labels map<string,array<string>>, metrics map<string,double>, edges_directed array<string>, "
    "edges_tagged map<string,array<string>>, edges_dynamic map<string,map<string,struct<branches:map<string,array<string>>,metadata:map<string,string>>>>"
)
SPEC_TYPE = "struct<" + SPEC.replace(" map", ":map").replace(" array", ":array") + ">"


def metadata_text(column: Column) -> Column:
    """The metadata of an edge as text, its keys in order; null if there is none. Text can be compared and grouped, maps cannot."""
    return F.when(F.size(column) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column)))))


def from_specs(specs: DataFrame) -> Graph:
    """The tables of (node, spec)."""
    again = specs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"node {again[0]['node']} is given twice")
    held = specs.select("node", "spec")
    none = F.lit(None).cast("string")
    columns = lambda kind, tag=none, key=none, name=none, branch=none, metadata=none: [F.col("node").alias("src"), F.col("dst"), F.lit(kind).alias("kind"), tag.alias("tag"), key.alias("type_key"), name.alias("edge_name"), branch.alias("branch"), metadata.alias("metadata")]
    directed = held.select("node", F.explode("spec.edges_directed").alias("dst")).select(*columns("directed"))
    tagged = held.select("node", F.explode("spec.edges_tagged").alias("tag", "to")).select("node", "tag", F.explode("to").alias("dst")).select(*columns("tagged", F.col("tag")))
    dynamic = held.select("node", F.explode("spec.edges_dynamic").alias("type_key", "named")).select("node", "type_key", F.explode("named").alias("edge_name", "edge"))
    dynamic = dynamic.select("node", "type_key", "edge_name", metadata_text(F.col("edge.metadata")).alias("metadata"), F.explode("edge.branches").alias("branch", "to"))
    dynamic = dynamic.select("node", "type_key", "edge_name", "branch", "metadata", F.explode("to").alias("dst"))
    edges = directed.unionByName(tagged).unionByName(dynamic.select(*columns("dynamic", none, F.col("type_key"), F.col("edge_name"), F.col("branch"), F.col("metadata")))).distinct()
    props, labels = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<string>>")
    nodes = held.select("node", F.coalesce("spec.properties", props).alias("props"), F.coalesce("spec.labels", labels).alias("labels"))
    targets = edges.select(F.col("dst").alias("node")).distinct().join(held, "node", "left_anti")
    nodes = nodes.unionByName(targets.select("node", props.alias("props"), labels.alias("labels")))
    metrics = held.select("node", F.explode("spec.metrics").alias("metric", "value"))
    return Graph(nodes, metrics, with_order(edges))


def to_specs(g: Graph) -> DataFrame:
    """(node, spec) of the tables; sections without values are null, sets are sorted."""
    sets = lambda df, by: df.groupBy("src", *by).agg(F.sort_array(F.collect_set("dst")).alias("to"))
    entries = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
    directed = sets(g.edges.where("kind = 'directed'"), []).select(F.col("src").alias("node"), F.col("to").alias("edges_directed"))
    tagged = sets(g.edges.where("kind = 'tagged'"), ["tag"]).groupBy(F.col("src").alias("node")).agg(entries("tag", "to").alias("edges_tagged"))
    # maps cannot be sorted by: branches stay entries until their edge is made
    branches = sets(g.edges.where("kind = 'dynamic'"), ["type_key", "edge_name", "branch"]).groupBy("src", "type_key", "edge_name").agg(F.sort_array(F.collect_list(F.struct("branch", "to"))).alias("of"))
    # one metadata for each named edge: of several the greatest text
    said = g.edges.where("kind = 'dynamic'").groupBy("src", "type_key", "edge_name").agg(F.max("metadata").alias("metadata"))
    named = branches.join(said, ["src", "type_key", "edge_name"]).groupBy("src", "type_key").agg(F.sort_array(F.collect_list(F.struct("edge_name", "of", "metadata"))).alias("edges"))
    edge = lambda e: F.struct(e["edge_name"], F.struct(F.map_from_entries(e["of"]).alias("branches"), F.from_json(e["metadata"], "map<string,string>").alias("metadata")))
    dynamic = named.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("type_key", "edges"))).alias("all"))
    dynamic = dynamic.select("node", F.map_from_entries(F.transform("all", lambda t: F.struct(t["type_key"], F.map_from_entries(F.transform(t["edges"], edge))))).alias("edges_dynamic"))
    metrics = g.node_metrics.groupBy("node").agg(entries("metric", "value").alias("metrics"))
    out = g.nodes
    for part in (metrics, directed, tagged, dynamic):
        out = out.join(part, "node", "left")
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    spec = F.struct(filled("props").alias("properties"), filled("labels").alias("labels"), "metrics", "edges_directed", "edges_tagged", "edges_dynamic")
    return out.select("node", spec.cast(SPEC_TYPE).alias("spec"))


def with_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and, without values, those that only edges name."""
    return with_names(nodes, edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())


def with_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The nodes and, without values, those of the names (node), each once, that are none of them."""
    named = names.join(nodes.select("node"), "node", "left_anti")
    none = {"props": F.create_map().cast("map<string,string>"), "labels": F.create_map().cast("map<string,array<string>>")}
    return nodes.select("node", *none).unionByName(named.select("node", *[v.alias(c) for c, v in none.items()]))


def configured(g: Graph, judged: DataFrame, reachable: DataFrame) -> Graph:
    """What a configuration leaves: reachable nodes (node), and of the judged edges those that it follows between them."""
    edges = judged.where("NOT excluded").join(reachable.select(F.col("node").alias("src")), "src", "left_semi").select(*g.edges.columns)
    return Graph(g.nodes.join(reachable, "node", "left_semi"), g.node_metrics.join(reachable, "node", "left_semi"), edges)


def write_lines(g: Graph, path: str) -> None:
    to_specs(g).write.json(path, mode="errorifexists")


def read_lines(spark: SparkSession, path: str) -> Graph:
    return from_specs(spark.read.schema(f"node string, spec {SPEC_TYPE}").json(path, mode="FAILFAST"))


def read_document(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The tables of whole documents, and their entry points (node). A document is one row, so it must fit a task."""
    schema = f"nodes map<string,{SPEC_TYPE}>, entry_points array<string>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))
    return from_specs(doc.select(F.explode("d.nodes").alias("node", "spec"))), doc.select(F.explode("d.entry_points").alias("node"))


def document_lines(g: Graph, entry_points: list[str] = ()) -> DataFrame:
    """(section, key, line): in this order the lines are one document."""
    specs = to_specs(g)
    first = specs.agg(F.min("node").alias("_first"))  # one row
    name = F.get_json_object(F.to_json(F.struct("node")), "$").substr(F.lit(9), F.length(F.to_json(F.struct("node"))) - 9)
    lines = specs.crossJoin(F.broadcast(first)).select(F.lit(1).alias("section"), F.col("node").alias("key"), F.concat(F.when(F.col("node") == F.col("_first"), "").otherwise(","), name, F.lit(":"), F.to_json("spec")).alias("line"))
    ends = [(0, "", '{"nodes":{'), (2, "", "}," + '"entry_points":' + json.dumps(list(entry_points)) + "}")]
    return lines.unionByName(g.nodes.sparkSession.createDataFrame(ends, "section int, key string, line string"))


def write_document(g: Graph, path: str, entry_points: list[str] = ()) -> None:
    document_lines(g, entry_points).sort("section", "key").select("line").write.text(path)
