"""Saved configurations, named by what they hold, and the graph that a query means."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.formats import QUERY_PREFIX, handle
from graphlens.operators.fixpoint import saved
from graphlens.operators.traverse import Prepared, prepare, restrict
from graphlens.plans.config import TraversalConfig

from .tables import Graph

#: Fixed value: how the key of a saved traversal configuration begins.
TRAVERSAL_PREFIX = "tvc_"


def content_key(prefix: str, text: Column) -> Column:
    """The prefix and sixteen hexadecimal digits of a hash of the text: equal texts have equal keys."""
    return F.concat(F.lit(prefix), F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def canonical(config: dict) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"))


class ConfigStore:
    """A table (key, text) in a folder, to which only texts that it lacks are added."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], "key string, text string").write.mode("append").parquet(self.folder)

    @property
    def rows(self) -> DataFrame:
        """Writers at the same time may both add a text; it is read once."""
        return self.spark.read.schema("key string, text string").parquet(self.folder).distinct()

    def put(self, texts: DataFrame, prefix: str = TRAVERSAL_PREFIX) -> DataFrame:
        """Save texts (text), each once; return (key, text) of each. Texts that share a key and differ are an error: the hash names them, it does not decide that they are equal."""
        keyed = saved(texts.select(content_key(prefix, F.col("text")).alias("key"), "text").where("text IS NOT NULL").distinct())
        there = self.rows.join(keyed.select("key").distinct(), "key", "left_semi")
        clash = keyed.unionByName(there).groupBy("key").agg((F.min("text") != F.max("text")).alias("differ")).where("differ").first()
        if clash:
            raise ValueError(f"different texts share the key {clash['key']}")
        keyed.join(there.select("key"), "key", "left_anti").write.mode("append").parquet(self.folder)
        return keyed

    def put_one(self, config: dict, prefix: str = TRAVERSAL_PREFIX) -> str:
        return self.put(self.spark.createDataFrame([(canonical(config),)], "text string"), prefix).first()["key"]

    def put_query(self, handle: str, roots: list[str] | None = None, traversal: dict | str | None = None) -> str:
        """Save a query; a traversal configuration in it (a document, or the key of one) is kept apart and named by key."""
        key = self.put_one(traversal) if isinstance(traversal, dict) else traversal
        return self.put_one({"handle": handle, "roots": None if roots is None else sorted(set(roots)), "traversal_config_key": key}, QUERY_PREFIX)

    def get(self, key: str) -> dict:
        row = self.rows.where(F.col("key") == key).first()
        if row is None:
            raise ValueError(f"no configuration {key}")
        return json.loads(row["text"])


@dataclass(frozen=True)
class GraphQuery:
    """A graph by its handle, what part of it (null: as the saved query says, or all), and a traversal configuration (a document, the key of one, or null)."""

    handle: str
    roots: tuple[str, ...] | None = None
    traversal: dict | str | None = None


def settled(store: ConfigStore, query: GraphQuery) -> GraphQuery:
    """The query with what a saved one that it names adds: its own roots and traversal go before those of the saved one. Configurations are documents in it, not keys."""
    roots, traversal, of = query.roots, query.traversal, query.handle
    if of.startswith(QUERY_PREFIX):
        saved = store.get(of)
        of = saved["handle"]
        roots = saved["roots"] if roots is None else roots
        traversal = saved["traversal_config_key"] if traversal is None else traversal
        if of.startswith(QUERY_PREFIX):
            raise ValueError(f"{query.handle} names another saved query, not a graph")
    traversal = store.get(traversal) if isinstance(traversal, str) else traversal
    return GraphQuery(of, None if roots is None else tuple(roots), traversal)


def resolve(store: ConfigStore, query: GraphQuery, graph_of: Callable[[str, int | None], tuple[Graph, dict | None]], super_root: bool = False) -> Prepared:
    """The graph that a query means, traversed.

    ``graph_of`` opens a timeline's frame (null: the latest) and returns its tables and its own traversal configuration, which holds where no query has one.
    Roots cut the graph to what they reach over all edges before it is traversed; unknown ones fall out, no roots mean all of it.
    """
    query = settled(store, query)
    at = store.spark.range(1).select(handle(F.lit(query.handle)).alias("h")).select("h.*").first()
    g, own = graph_of(at["timeline_id"], at["graph_id"])
    nodes, edges, metrics = g.nodes, g.edges, g.node_metrics
    if query.roots:
        inside, edges = restrict(edges, store.spark.createDataFrame([(r,) for r in query.roots], "node string"))
        nodes, metrics = nodes.join(inside, "node", "left_semi"), metrics.join(inside, "node", "left_semi")
    config = TraversalConfig.from_json(own if query.traversal is None else query.traversal)
    return prepare(nodes, metrics, edges, config, super_root=super_root)
