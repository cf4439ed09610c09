"""Graphs as GEXF 1.3: a line for each element, numbered in parallel, written sorted.

Nodes are numbered by name, edges by source, then directed, tagged and dynamic ones by their
keys; metrics are attributes of type float, labels and properties of type string.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.formats import xml
from graphlens.operators.fixpoint import numbered, saved

from .tables import Graph

#: Lines of nodes or edges in a file.
LINES = 200_000


def _decimal(value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def elements(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """attributes(id, title, type), nodes(id, node, values) and edges(id, source, target, label)."""
    of = lambda df, rank, kind: df.distinct().select(F.lit(rank).alias("rank"), "title", F.lit(kind).alias("type"))
    titles = of(g.node_metrics.select(F.col("metric").alias("title")), 0, "float").unionByName(of(g.nodes.select(F.explode(F.map_keys("labels")).alias("title")), 1, "string"))
    titles = numbered(titles.unionByName(of(g.nodes.select(F.explode(F.map_keys("props")).alias("title")), 2, "string")), ["rank", "title"], "id")
    held = g.node_metrics.select("node", F.lit(0).alias("rank"), F.col("metric").alias("title"), _decimal(F.col("value")).alias("v"))
    held = held.unionByName(g.nodes.select("node", F.lit(1).alias("rank"), F.explode("labels").alias("title", "to")).select("node", "rank", "title", F.concat_ws(",", "to").alias("v")))
    held = held.unionByName(g.nodes.select("node", F.lit(2).alias("rank"), F.explode("props").alias("title", "v")))
    values = held.join(titles, ["rank", "title"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("values"))
    nodes = saved(numbered(g.nodes.select("node"), ["node"], "id"))
    rank = F.when(F.col("kind") == "directed", 0).when(F.col("kind") == "tagged", 1).otherwise(2)
    label = F.when(F.col("kind") == "tagged", F.col("tag")).when(F.col("kind") == "dynamic", F.concat_ws(":", "type_key", "edge_name", "branch"))
    ends = g.edges.join(nodes.select(F.col("node").alias("src"), F.col("id").alias("source")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("target")), "dst")
    edges = numbered(ends.select("src", rank.alias("rank"), "tag", "type_key", "edge_name", "branch", "dst", "source", "target", label.alias("label")), ["src", "rank", "tag", "type_key", "edge_name", "branch", "dst"], "id")
    return titles, nodes.join(values, "node", "left"), edges.select("id", "source", "target", "label")


def lines(g: Graph) -> tuple[DataFrame, int, int]:
    """(section, id, line): in this order the lines are the file; and how many nodes and edges there are."""
    titles, nodes, edges = elements(g)
    text = lambda c: c.cast("string")
    value = lambda v: F.concat(F.lit('<attvalue for="'), text(v["id"]), F.lit('" value="'), xml(v["v"]), F.lit('"/>\n'))
    values = F.when(F.col("values").isNull(), "").otherwise(F.concat(F.lit("<attvalues>\n"), F.array_join(F.transform("values", value), ""), F.lit("</attvalues>\n")))
    of = lambda df, section, *parts: df.select(F.lit(section).alias("section"), "id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))
    body = of(titles, 1, '<attribute id="', text(F.col("id")), '" title="', xml(F.col("title")), '" type="', F.col("type"), '"/>')
    body = body.unionByName(of(nodes, 3, '<node id="', text(F.col("id")), '" label="', xml(F.col("node")), '">\n', values, "</node>"))
    label = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit(' label="'), xml(F.col("label")), F.lit('"')))
    body = body.unionByName(of(edges, 5, '<edge id="', text(F.col("id")), '" source="', text(F.col("source")), '" target="', text(F.col("target")), '"', label, "/>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<meta>\n<creator>graphlens</creator>\n</meta>\n<graph mode="static" defaultedgetype="directed">'
    some = bool(titles.limit(1).count())
    frame = [(0, -1, head), (2, -1, "<nodes>"), (4, -1, "</nodes>\n<edges>"), (6, -1, "</edges>\n</graph>\n</gexf>")]
    frame += [(1, -1, '<attributes class="node">'), (1, 1 << 62, "</attributes>")] if some else []
    return body.unionByName(g.nodes.sparkSession.createDataFrame(frame, "section int, id long, line string")), nodes.count(), edges.count()


def write(g: Graph, path: str) -> None:
    """Nodes and edges are numbered without gaps, so the file of a line follows from its number: LINES of them to a file, and nothing is sampled for the order."""
    body, nodes, edges = lines(g)
    first = 1 + math.ceil(nodes / LINES)  # the file where edges begin
    last = first + max(0, math.ceil(edges / LINES) - 1)
    run = F.floor(F.col("id") / LINES).cast("int")
    file = F.when(F.col("section") <= 2, 0).when(F.col("section") == 3, 1 + run).when(F.col("section") == 4, first).when(F.col("section") == 5, first + run).otherwise(last)
    body.repartitionById(last + 1, file.cast("int")).sortWithinPartitions("section", "id").select("line").write.text(path)
