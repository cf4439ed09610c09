"""Registered queries over documents of either form, differences of JSON and saved configurations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.fixpoint import new_folder
from graphlens.operators.json_diff import json_changes as changes
from graphlens.sources.arrays import from_documents
from graphlens.sources.configs import ConfigStore, GraphQuery, resolve
from graphlens.sources.tables import supply, table

from .queries import GRAPH_SQL, REACHED_SQL, query


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document (value) for each customer and the orders: in the form of arrays for odd numbers, else in that of a map."""
    order = F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("tag"), F.col("o_totalprice").alias("price"))
    of = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("os"))
    customer, n = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.size("os")
    names = F.concat(F.array(customer), F.col("os.name"))
    offsets = F.aggregate(names, F.array(F.lit(0)), lambda acc, name: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(name))))
    places = F.sequence(F.lit(0), n - 1)
    edges = F.struct(
        F.sequence(F.lit(1), n).alias("edges"),
        F.concat(F.array(F.lit(0)), F.array_repeat(n, n + 1)).alias("edge_offsets"),
        F.transform("os", lambda o: F.struct(F.struct(o["tag"].alias("tag")).alias("Tagged"))).alias("edge_metadata"),
        F.map_from_arrays(F.transform(places, lambda k: k.cast("string")), places).alias("edge_metadata_map"),
    )
    prices = F.struct(F.create_map(F.lit("price"), F.concat(F.array(F.lit(0.0)), F.col("os.price"))).alias("metrics"), F.create_map().cast("map<string,map<string,array<string>>>").alias("labels"))
    arrays = F.struct(F.struct(F.array_join(names, "").alias("node_names"), offsets.alias("offsets")).alias("node_names_ordered"), edges.alias("edges"), prices.alias("node_metadata"), F.array(customer).alias("entry_points"))
    tagged = F.map_from_entries(F.transform(F.array_distinct("os.tag"), lambda t: F.struct(t, F.transform(F.filter("os", lambda o: o["tag"] == t), lambda o: o["name"]))))
    spec = lambda metrics, to: F.struct(metrics.cast("map<string,double>").alias("metrics"), to.cast("map<string,array<string>>").alias("edges_tagged"))
    node = lambda name, metrics, to: F.struct(name.alias("node"), spec(metrics, to).alias("spec"))
    nodes = F.concat(F.array(node(customer, F.lit(None), tagged)), F.transform("os", lambda o: node(o["name"], F.create_map(F.lit("price"), o["price"]), F.lit(None))))
    whole = F.struct(F.map_from_entries(nodes).alias("nodes"), F.array(customer).alias("entry_points"))
    return of.select(F.when(F.col("o_custkey") % 2 == 1, F.to_json(arrays)).otherwise(F.to_json(whole)).alias("value"))


@query("SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, o_orderpriority AS tag, round(o_totalprice, 2) AS price FROM orders")
def documents_of_both_forms(spark, sf_dir):
    """Edges and prices read back from documents whose form is told from what they hold."""
    g, _ = from_documents(_order_documents(spark, sf_dir))
    price = g.node_metrics.select(F.col("node").alias("dst"), F.round("value", 2).alias("price"))
    return g.edges.join(price, "dst").select("src", "dst", "tag", "price")


def _near(key: Column, *more: int) -> Column:
    return F.array(*[key + F.lit(k) for k in more])


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_size AS s, p_type AS t FROM part)
SELECT k AS p_partkey, '$["near"][1]' AS path, 'removed' AS tone, CAST(k + 1 AS VARCHAR) AS left, CAST(NULL AS VARCHAR) AS right, 1::BIGINT AS lines FROM p UNION ALL SELECT k, '$["near"][2]', 'added', NULL, CAST(k + 3 AS VARCHAR), 1 FROM p
UNION ALL SELECT k, '$["of"]', 'removed', '{"type": "' || t || '"}', NULL, 3 FROM p WHERE s < 5 UNION ALL SELECT k, '$["of"]["type"]', 'changed', '"' || t || '"', '"' || t || '!"', 1 FROM p WHERE s >= 5
UNION ALL SELECT k, '$["size"]', 'added', NULL, CAST(s AS VARCHAR), 1 FROM p WHERE s > 40""")
def json_changes(spark, sf_dir):
    """What differs between two descriptions of each part."""
    key = F.col("p_partkey").cast("long")
    kind = lambda t: F.struct(t.alias("type"))
    left = F.to_json(F.struct("p_brand", _near(key, 0, 1, 2).alias("near"), kind(F.col("p_type")).alias("of")))
    right = F.to_json(F.struct("p_brand", _near(key, 0, 2, 3).alias("near"), F.when(F.col("p_size") >= 5, kind(F.concat("p_type", F.lit("!")))).alias("of"), F.when(F.col("p_size") > 40, F.col("p_size")).alias("size")))
    pairs = table(spark, sf_dir, "part").select(key.alias("p_partkey"), left.alias("left"), right.alias("right"))
    return changes(pairs, "p_partkey", "left", "right").drop("place")


@query("""SELECT DISTINCT '{"force_nodes":{"u' || user_id || '":{"include":false}}}' AS text, true AS named FROM events""")
def saved_configs(spark, sf_dir):
    """A configuration for each event, saved twice over: each text stands once, under the key made of it."""
    text = F.concat(F.lit('{"force_nodes":{"u'), F.col("user_id").cast("string"), F.lit('":{"include":false}}}')).alias("text")
    store = ConfigStore(spark, new_folder(spark, "configs"))
    events = table(spark, sf_dir, "events")
    store.put(events.where("event_type = 'purchase'").select(text))
    keys = store.put(events.select(text))
    stored = spark.read.parquet(store.folder)
    return stored.join(keys.select("key"), "key").select("text", F.col("key").rlike("^tvc_[0-9a-f]{16}$").alias("named"))


#: The configuration of the other queries as a document.
DOCUMENT = {
    "force_tagged": {"N": {"include": False}},
    "force_dynamic": {"stock": {"default_branches": {"Include": ["O"]}, "overrides": {"line": {"branches": {"Exclude": ["F"]}, "decision": None}}}},
    "label_predicates": {"brand": {"label_name": "brand", "label_value": "Brand#12", "contains": True, "decision": {"include": False}}},
    "force_nodes": {"c7": {"include": False}},
    "tiered_traversal": {"AscendingTiers": {"tiers": [{"name": "eager"}, {"name": "lazy", "tags_that_transition_to_this_tier": ["R"]}, {"name": "late", "dynamic_type_keys_that_transition_to_this_tier": ["stock"]}]}},
}


@query(f"WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL} SELECT node FROM reached")
def resolved_query(spark, sf_dir):
    """A saved query for one region, asked with another region as its root: the root is the asker's, the configuration the saved one's."""
    store = ConfigStore(spark, new_folder(spark, "configs"))
    key = store.put_query("supply", ["r1"], DOCUMENT)
    p = resolve(store, GraphQuery(key, ("r0", "unknown")), lambda timeline, frame: (supply(spark, sf_dir), None))
    return p.state.where("reachable").select("node")
