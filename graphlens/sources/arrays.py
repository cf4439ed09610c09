"""Graphs in the array form of their JSON documents: nodes by number, all names one text cut at offsets, edges one list cut at offsets.

A document is one row and must fit a task, as any whole document; each is turned into lines of nodes in the task that parses it, and
all further work is on those lines. The array form is only read: a text of all names can be written by one task alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import SPEC_TYPE, from_specs
from .tables import Graph

#: Lines are handed on when they hold so many characters.
RUN = 8_000_000


def _edges(doc: dict, names: list[str], node: int) -> dict:
    """The sections of edges of one node."""
    edges, spec = doc["edges"], {"edges_directed": [], "edges_tagged": {}, "edges_dynamic": {}}
    about, which = edges.get("edge_metadata") or [], edges.get("edge_metadata_map") or {}
    for at in range(edges["edge_offsets"][node], edges["edge_offsets"][node + 1]):
        target, kind = names[edges["edges"][at]], which.get(str(at))
        said = {} if kind is None else about[kind]
        if kind is None:
            spec["edges_directed"].append(target)
        elif "Tagged" in said:
            spec["edges_tagged"].setdefault(said["Tagged"]["tag"], []).append(target)
        else:
            of = said["Dynamic"]
            named = spec["edges_dynamic"].setdefault(of["type_key"], {}).setdefault(of["edge_name"], {"branches": {}, "metadata": of.get("metadata")})
            named["branches"].setdefault(of["branch"], []).append(target)
    return spec


def _lines(text: str) -> Iterator[tuple[str, str]]:
    """(node, spec) of a document; zeros of metrics are what nodes without the metric hold in this form, so they are left out."""
    doc = json.loads(text)
    held, at = doc["node_names_ordered"]["node_names"].encode(), doc["node_names_ordered"]["offsets"]
    names = [held[a:b].decode() for a, b in zip(at, at[1:])]
    if len(doc["edges"]["edge_offsets"]) != len(at):
        raise ValueError(f"offsets of {len(doc['edges']['edge_offsets']) - 1} nodes for {len(names)} names")
    about = doc.get("node_metadata") or {}
    for k, name in enumerate(names):
        spec = _edges(doc, names, k)
        spec["metrics"] = {m: values[k] for m, values in (about.get("metrics") or {}).items() if values[k]}
        for section in ("labels", "properties"):
            spec[section] = {n: of[str(k)] for n, of in (about.get(section) or {}).items() if str(k) in of}
        yield name, json.dumps({section: value for section, value in spec.items() if value}, ensure_ascii=False)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            run, size = [], 0
            for line in _lines(text.as_py()):
                run.append(line)
                size += len(line[1])
                if size > RUN:
                    yield pa.RecordBatch.from_pylist([{"node": n, "spec": s} for n, s in run])
                    run, size = [], 0
            if run:
                yield pa.RecordBatch.from_pylist([{"node": n, "spec": s} for n, s in run])


def specs_of(documents: DataFrame) -> DataFrame:
    """(node, spec) of documents of either form (value); a document of neither form, or one that cannot be parsed, is an error."""
    in_arrays = F.get_json_object("value", "$.node_names_ordered").isNotNull()
    lines = documents.where(in_arrays).select("value").mapInArrow(_parsed, "node string, spec string")
    arrays = lines.select("node", F.from_json("spec", SPEC_TYPE, {"mode": "FAILFAST"}).alias("spec"))
    doc = documents.where(~in_arrays).select(F.from_json("value", f"nodes map<string,{SPEC_TYPE}>", {"mode": "FAILFAST"}).alias("d"))
    nodes = F.when(F.col("d.nodes").isNull(), F.raise_error(F.lit("neither form of a graph document"))).otherwise(F.col("d.nodes"))
    return arrays.unionByName(doc.select(F.explode(nodes).alias("node", "spec")))


def from_documents(documents: DataFrame) -> tuple[Graph, DataFrame]:
    """The tables of documents of either form (value) and their entry points (node)."""
    entry = documents.select(F.explode(F.from_json(F.get_json_object("value", "$.entry_points"), "array<string>")).alias("node"))
    return from_specs(specs_of(documents)), entry


def read_any(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The tables of the files of a path, each a whole document of either form, and their entry points (node)."""
    return from_documents(spark.read.text(path, wholetext=True))
