"""Export of a graph under a configuration: which part of it, and in which form."""

from __future__ import annotations

from graphlens.operators.fixpoint import saved
from graphlens.operators.traverse import Prepared

from . import documents, gexf
from .tables import Graph

#: The names by which scopes and forms are asked for.
SCOPES, FORMS = ("Reachable", "Whole"), ("MapGraphJson", "Gephi")


def part(p: Prepared, scope: str) -> Graph:
    """The graph as it is (``Whole``), or what is reachable with the edges that are followed (``Reachable``); nodes that only edges name are nodes, too."""
    if scope not in SCOPES:
        raise ValueError(f"unknown export scope: {scope}")
    edges = p.edges.drop("excluded", "to_tier", "rule")
    if scope == "Whole":
        return Graph(documents.with_targets(p.nodes, p.edges), p.node_metrics, edges)
    reached = p.reached.select("node")
    g = documents.configured(Graph(p.nodes, p.node_metrics, edges), p.edges, reached)
    return Graph(saved(documents.with_names(g.nodes, reached)), g.node_metrics, g.edges)


def export(p: Prepared, scope: str, form: str, path: str) -> None:
    """Write the part as text files whose lines, in the order of the files, are one document."""
    if form not in FORMS:
        raise ValueError(f"unknown export format: {form}")
    g = part(p, scope)
    if form == "Gephi":
        gexf.write(g, path)
    else:
        entries = [r[0] for r in p.entry.select("node").orderBy("node").collect()]  # entry points are named in the document's last line
        documents.write_document(g, path, entries)
