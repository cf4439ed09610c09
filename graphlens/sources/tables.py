"""Graphs in the tables of a supply chain and of an event log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlens.operators.fixpoint import LARGE, dealt, numbered


@dataclass
class Graph:
    nodes: DataFrame
    node_metrics: DataFrame
    edges: DataFrame


class LazyGraph:
    """A graph whose tables are opened when they are asked for."""

    def __init__(self, nodes: Callable[[], DataFrame], node_metrics: Callable[[], DataFrame], edges: Callable[[], DataFrame], rows: Callable[[], int]):
        self._makers = nodes, node_metrics, edges, rows

    @cached_property
    def nodes(self) -> DataFrame:
        return self._makers[0]()

    @cached_property
    def node_metrics(self) -> DataFrame:
        return self._makers[1]()

    @cached_property
    def edges(self) -> DataFrame:
        return self._makers[2]()

    @cached_property
    def rows(self) -> int:
        """About how many edges there are, and no fewer, without making them."""
        return self._makers[3]()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _edge(src: Column, dst: Column, kind: str = "directed", tag: Column | None = None, key: str | None = None, name: str | None = None, branch: Column | None = None, metadata: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), (none if tag is None else tag).alias("tag"), F.lit(key).cast("string").alias("type_key"), F.lit(name).cast("string").alias("edge_name"), (none if branch is None else branch).alias("branch"), (none if metadata is None else metadata).alias("metadata")]


def with_order(edges: DataFrame) -> DataFrame:
    """Number the edges of each node: directed, tagged by (tag, target), dynamic by (type key, name, branch, target)."""
    kind = F.when(F.col("kind") == "directed", 0).when(F.col("kind") == "tagged", 1).otherwise(2)
    w = Window.partitionBy("src").orderBy(kind, "tag", "type_key", "edge_name", "branch", "dst")
    return edges.withColumn("edge_ord", F.row_number().over(w).cast("long"))


def supply(spark: SparkSession, sf_dir: str, before: str | None = None, ordered: bool = False, only: str = "rncop", by_src: bool = False, once: bool = True) -> LazyGraph:
    """region, nation, customer, order, part, supplier as one graph; lines shipped before a day only, if one is given.

    Orders are tagged by priority, parts of an order by return flag; the suppliers of a part are dynamic edges
    of type stock, name line, with the line status as branch and the part's lot (its number modulo 7) as metadata.
    ``only``: the edges from these kinds of nodes, by the first letters of their names; others are not made. ``by_src``: many edges of all kinds are made in parts dealt
    by src, into as many as ``rows`` says, so that what deals them so again (``dealt``) finds it done. ``once``: lines that are the same edge are one; else they may be
    several, which is enough for what asks for pairs of nodes only.
    """
    of = cache(lambda name: table(spark, sf_dir, name))
    about = cache(lambda: sum(of(t).count() for t in (dict(r="nation", n="customer", c="orders", o="lineitem", p="lineitem")[letter] for letter in only)))
    union = lambda parts: reduce(DataFrame.unionByName, parts)

    def all_nodes() -> DataFrame:
        empty, labels = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<string>>")
        nodes = lambda name, letter, key, props=empty, held=labels: of(name).select(_name(letter, key).alias("node"), props.alias("props"), held.alias("labels"))
        part_props = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
        return union(
            [
                nodes("region", "r", "r_regionkey"),
                nodes("nation", "n", "n_nationkey"),
                nodes("customer", "c", "c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"))),
                nodes("orders", "o", "o_orderkey"),
                nodes("part", "p", "p_partkey", part_props, F.create_map(F.lit("brand"), F.array("p_brand"))),
                nodes("supplier", "s", "s_suppkey"),
            ]
        )

    def metrics() -> DataFrame:
        metric = lambda n, letter, key, name, value: of(n).select(_name(letter, key).alias("node"), F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"))
        return union([metric("orders", "o", "o_orderkey", "price", "o_totalprice"), metric("part", "p", "p_partkey", "price", "p_retailprice"), metric("part", "p", "p_partkey", "size", "p_size"), metric("customer", "c", "c_custkey", "balance", "c_acctbal")])

    def edges() -> DataFrame:
        held = of("lineitem") if before is None else of("lineitem").where(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz"))
        lot = F.concat(F.lit('{"lot":"'), (F.substring("src", 2, 20).cast("long") % 7).cast("string"), F.lit('"}'))

        def of_orders(lines: DataFrame, key: str, order: Column) -> DataFrame:
            """Lines of the orders there are, dealt by the order, as the orders are, so that each is shuffled once. A semi join would be planned below the dealing, in the session's number of parts."""
            there = dealt(of("orders").select(order.alias(key)), about(), key).distinct()
            return dealt(lines, about(), key).join(there.hint("shuffle_hash") if about() > LARGE else there, key)  # a part's orders are few, and lines need not be sorted

        different = lambda lines: lines.distinct() if once else lines

        def tagged_lines() -> DataFrame:
            """(src, l_partkey, l_returnflag), dealt by src if they are many."""
            lines = held.select(_name("o", "l_orderkey").alias("src"), "l_partkey", "l_returnflag")
            return different(of_orders(lines, "src", _name("o", "o_orderkey")) if before is None else dealt(lines, about(), "src"))

        def stock_lines() -> DataFrame:
            """(src, l_suppkey, l_linestatus), dealt by src if they are many."""
            lines = held.select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus")
            lines = of_orders(lines, "l_orderkey", F.col("o_orderkey")) if before is None else lines
            return different(dealt(lines.select(_name("p", "l_partkey").alias("src"), "l_suppkey", "l_linestatus"), about(), "src"))

        makers = {
            "r": lambda: of("nation").select(*_edge(_name("r", "n_regionkey"), _name("n", "n_nationkey"))),
            "n": lambda: of("customer").select(*_edge(_name("n", "c_nationkey"), _name("c", "c_custkey"))),
            "c": lambda: of("orders").select(*_edge(_name("c", "o_custkey"), _name("o", "o_orderkey"), "tagged", F.col("o_orderpriority"))),
            # targets are made different while they are numbers, where the edges of a node are
            "o": lambda: tagged_lines().select(*_edge(F.col("src"), _name("p", "l_partkey"), "tagged", F.col("l_returnflag"))),
            "p": lambda: stock_lines().select(*_edge(F.col("src"), _name("s", "l_suppkey"), "dynamic", None, "stock", "line", F.col("l_linestatus"), lot)),
        }
        every = union([dealt(makers[letter](), about(), "src") if by_src and letter in "rnc" else makers[letter]() for letter in only])  # lines are dealt already
        return with_order(dealt(every, about(), "src")) if ordered else every.withColumn("edge_ord", F.lit(None).cast("long"))

    return LazyGraph(all_nodes, metrics, edges, about)


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Users as nodes, an edge from each to the next one seen on the same day; cyclic. Metric: events. Events are numbered in ranges, so that a full day is not one task."""
    events = table(spark, sf_dir, "events")
    placed = numbered(events.select(F.to_date("ts").alias("day"), "ts", "event_id", _name("u", "user_id").alias("src")), ["day", "ts", "event_id"], "place")
    after = placed.select("day", (F.col("place") - 1).alias("place"), F.col("src").alias("dst"))
    pairs = placed.join(after, ["day", "place"]).where("src <> dst").select("src", "dst").distinct()
    edges = pairs.select(*_edge(F.col("src"), F.col("dst"))).withColumn("edge_ord", F.lit(None).cast("long"))
    users = events.groupBy(_name("u", "user_id").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    nodes = users.select("node", F.create_map().cast("map<string,string>").alias("props"), F.create_map().cast("map<string,array<string>>").alias("labels"))
    return Graph(nodes, users.select("node", F.lit("events").alias("metric"), "value"), edges)
