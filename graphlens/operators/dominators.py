"""Dominator trees by contraction and meets over a jump table.

A node whose edges come from one class only (at first each node is a class) has its immediate dominator in that
class: the lowest common dominator of the nodes that its edges come from. So it joins the class, and all that can do so
join in one round; chains of classes are followed by doubling, so a path of n nodes takes log(n) rounds. What is left of a graph with
loops that are entered at several places is settled by meets alone: from a search tree on, each node's dominator becomes the
meet of those of its parents until none changes.

A tree is (node, idom): one row for each node, whatever its depth. Its jump table has, for each node, what lies 1, 2, 4, ...
steps up. A meet of any number of nodes lifts them to one depth and then together, largest steps first, in as many joins as
the depth has digits. Where no node lies as deep as SHALLOW, the table also has the way from the root to each node, and a meet is one
join: what all ways have in common is what the first and the last of them in their order have.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .fixpoint import MOST_ROUNDS, reach_set, saved

#: Joins of a meet that are planned together.
TOGETHER = 6
#: Ways are held in trees less deep than this (a power of two), so that a row has at most so many names.
SHALLOW = 32


def jump_table(tree: DataFrame) -> DataFrame:
    """(node, depth, jump, way) of a saved ``tree`` (node, idom), no idom at roots.

    depth: the number of steps to the root; jump: what lies 1, 2, 4, ... steps up; way: the nodes from the root to this one, null for all nodes if one lies at depth SHALLOW or below.
    """
    nodes = ArrayType(tree.schema["node"].dataType)
    at = tree.select("node", F.col("idom").alias("far"), F.when(F.col("idom").isNull(), 0).otherwise(1).alias("depth"), F.array().cast(nodes).alias("jump"), F.array("node").alias("way"))
    for turn in range(MOST_ROUNDS):
        if at.where("far IS NOT NULL").isEmpty():
            return at.select("node", "depth", "jump", "way")
        up = at.select(F.col("node").alias("far"), F.col("far").alias("_far"), F.col("depth").alias("_steps"), F.col("way").alias("_way"))
        nxt = at.join(up, "far", "left")
        jump = F.when(F.col("far").isNull(), F.col("jump")).otherwise(F.concat("jump", F.array("far")))
        way = F.coalesce(F.concat("_way", "way"), F.col("way")) if 2 << turn <= SHALLOW else F.lit(None).cast(nodes)
        at = saved(nxt.select("node", F.col("_far").alias("far"), (F.col("depth") + F.coalesce("_steps", F.lit(0))).alias("depth"), jump.alias("jump"), way.alias("way")))
    raise RuntimeError("a tree has no end")


def _deepest(jumps: DataFrame) -> int:
    return jumps.agg(F.max("depth")).first()[0] or 0


def meets(items: DataFrame, jumps: DataFrame) -> DataFrame:
    """(key, node): for each key the lowest node that all of its nodes (key, node) have above them or are."""
    deepest = _deepest(jumps)
    if deepest < SHALLOW:
        ends = items.join(jumps.select("node", "way"), "node").groupBy("key").agg(F.min("way").alias("_first"), F.max("way").alias("_last"))
        return ends.select("key", F.try_element_at(F.array_intersect("_first", "_last"), F.lit(-1)).alias("node"))
    items = items.select("key", "node").distinct()
    known = items.join(jumps.select("node", "depth"), "node")
    levels = math.ceil(math.log2(1 + deepest))
    goal = known.groupBy("key").agg(F.min("depth").alias("goal"))
    now = known.join(goal, "key").select("key", "node", (F.col("depth") - F.col("goal")).alias("above"))
    up = lambda k: jumps.where(F.size("jump") > k).select("node", F.col("jump")[k].alias("_up"))
    joins = 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal joins
        joins += 1
        return saved(df) if joins % TOGETHER == 0 else df

    for k in reversed(range(levels)):
        far = F.col("above") >= (1 << k)
        now = now.join(up(k), "node", "left").select("key", F.when(far, F.col("_up")).otherwise(F.col("node")).alias("node"), F.when(far, F.col("above") - (1 << k)).otherwise(F.col("above")).alias("above"))
        now = kept(now.distinct())
    now = saved(now.select("key", "node").distinct())
    for k in reversed(range(levels)):
        # all nodes of a key are at one depth, so a step leads beyond the root for all of them or for none
        tried = now.join(up(k), "node", "left")
        apart = tried.groupBy("key").agg((F.min("_up") != F.max("_up")).alias("_apart"))
        now = kept(tried.join(apart, "key").select("key", F.when(F.col("_apart"), F.col("_up")).otherwise(F.col("node")).alias("node")).distinct())
    last = now.groupBy("key").agg(F.min("node").alias("node"), (F.min("node") != F.max("node")).alias("_apart"))
    last = last.join(up(0), "node", "left") if levels else last.withColumn("_up", F.lit(None).cast(jumps.schema["node"].dataType))
    return last.select("key", F.when(F.col("_apart"), F.col("_up")).otherwise(F.col("node")).alias("node"))


def _joined(single: DataFrame, limit: int) -> DataFrame:
    """(dst, into): where chains of (dst, into) end; those that go round never end and are left out."""
    at = single
    for _ in range(limit):
        nxt = at.join(at.select(F.col("dst").alias("into"), F.col("into").alias("_into")), "into", "left")
        if nxt.where("_into IS NOT NULL").isEmpty():
            return at
        at = saved(nxt.select("dst", F.coalesce("_into", "into").alias("into")))
    return at.join(single.select(F.col("dst").alias("into")), "into", "left_anti")


def dominator_tree(edges: DataFrame, root: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, idom) of the nodes that the root (one row, node) reaches; the root has no idom.

    Nodes are numbered for the work: numbers are met and grouped by hash, names only by sorting them. ``nodes`` may be given if they are known: (node), each once, all that the root
    reaches; then ``edges`` has each pair once, and all of them lead from one of the nodes to one of them.
    """
    if nodes is None:
        edges = saved(edges.select("src", "dst").where("src <> dst").distinct())
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(root.select("node")).distinct()
    numbers = saved(nodes.select("node", F.monotonically_increasing_id().alias("_id")))
    end = lambda c: numbers.select(F.col("node").alias(c), F.col("_id").alias(f"_{c}"))
    pairs = edges.where("src <> dst").select("src", "dst").join(end("src"), "src").select("_src", "dst").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    tree = _numbered_tree(pairs, numbers.join(root.select("node"), "node").select(F.col("_id").alias("node")))
    named = numbers.join(tree.withColumnRenamed("node", "_id"), "_id").select("node", F.col("idom").alias("_up"))
    return named.join(numbers.select(F.col("_id").alias("_up"), F.col("node").alias("idom")), "_up", "left").select("node", "idom")


def _numbered_tree(edges: DataFrame, root: DataFrame) -> DataFrame:
    """The tree of pairs (src, dst) without loops of one node, each once."""
    first = saved(root.select("node"))
    start = first.first()[0]
    kind = first.schema["node"].dataType
    tree = first.select("node", F.lit(None).cast(kind).alias("idom"))
    # src: a node, top: its class, dst: a node that no class has taken up yet
    links = saved(edges.select("src", F.col("src").alias("top"), "dst").where(F.col("dst") != start))
    checked = False
    for _ in range(MOST_ROUNDS):
        ends = links.groupBy("dst").agg(F.min("top").alias("into"), F.max("top").alias("_other"), F.min("src").alias("_a"), F.max("src").alias("_b"))
        single = saved(ends.where("into = _other").select("dst", "into", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("idom")))
        count = single.count()
        if not count:
            if links.isEmpty():
                break
            if checked:
                return _settled(links, tree, start)
            # what the root does not reach holds up others; a class stands for its nodes
            live = reach_set(links.select(F.col("top").alias("src"), "dst"), first).select(F.col("node").alias("top"))
            links, checked = saved(links.join(live, "top", "left_semi")), True
            continue
        checked = False
        several = links.join(single.where("idom IS NULL").select("dst"), "dst", "left_semi").select(F.col("dst").alias("key"), "src")
        found = single.where("idom IS NOT NULL").select(F.col("dst").alias("node"), "idom")
        if not several.isEmpty():
            # a meet lies in the class that all the nodes are of, whose tree is known; tops of other classes have no way up yet
            tops = links.select(F.col("top").alias("node")).distinct().join(tree.select("node"), "node", "left_anti")
            jumps = jump_table(saved(tree.unionByName(tops.select("node", F.lit(None).cast(kind).alias("idom")))))
            met = meets(several.withColumnRenamed("src", "node"), jumps)
            found = found.unionByName(met.select(F.col("key").alias("node"), F.col("node").alias("idom")))
        joined = _joined(single.select("dst", "into"), 2 + count.bit_length())
        tree = saved(tree.unionByName(found))
        rest = links.join(single.select("dst"), "dst", "left_anti")
        rest = rest.join(joined.select(F.col("dst").alias("top"), "into"), "top", "left").select("src", F.coalesce("into", "top").alias("top"), "dst")
        links = saved(rest.where("top <> dst"))
    return _reached(tree, start)


def _reached(tree: DataFrame, start: int) -> DataFrame:
    """The part of a forest (in which some may go round) that hangs at a root."""
    at = saved(tree.select("node", F.when(F.col("node") == start, F.col("node")).otherwise(F.col("idom")).alias("far")))
    for _ in range(2 + at.count().bit_length()):
        if at.where(F.col("far") != start).isEmpty():
            break
        up = at.select(F.col("node").alias("far"), F.col("far").alias("_far"))
        at = saved(at.join(up, "far", "left").select("node", F.coalesce("_far", "far").alias("far")))
    return tree.join(at.where(F.col("far") == start).select("node"), "node", "left_semi")


def _settled(links: DataFrame, tree: DataFrame, start: int) -> DataFrame:
    """The tree with what contraction leaves: (src, top, dst) whose dst is in no class but its own."""
    # a search over classes; each node hangs at a node of the class that found it
    seen = frontier = saved(tree.where(F.col("node") == start).select("node"))
    hung = None
    for _ in range(MOST_ROUNDS):
        step = links.join(frontier.withColumnRenamed("node", "top"), "top").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("idom"))
        step = saved(step.join(seen, "node", "left_anti"))
        if step.isEmpty():
            break
        hung = step if hung is None else saved(hung.unionByName(step))
        frontier = step.select("node")
        seen = saved(seen.unionByName(frontier))
    if hung is None:
        return _reached(tree, start)
    fixed = saved(_below(tree, seen))
    into = saved(links.select(F.col("dst").alias("key"), F.col("src").alias("node")).distinct())
    for _ in range(MOST_ROUNDS):
        met = meets(into, jump_table(saved(fixed.unionByName(hung))))
        after = saved(met.select(F.col("key").alias("node"), F.col("node").alias("idom")))
        if after.join(hung.withColumnRenamed("idom", "_old"), "node").where("idom <> _old").isEmpty():
            return fixed.unionByName(hung)
        hung = after
    raise RuntimeError("dominators did not settle")


def _below(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """The rows of a forest that hang at one of the tops, and the root itself."""
    at = saved(tree.select("node", "idom", F.coalesce("idom", "node").alias("far")))
    for _ in range(2 + at.count().bit_length()):
        up = at.select(F.col("node").alias("far"), F.col("far").alias("_far"))
        nxt = at.join(up, "far", "left")
        if nxt.where("_far IS NOT NULL AND _far <> far").isEmpty():
            break
        at = saved(nxt.select("node", "idom", F.coalesce("_far", "far").alias("far")))
    return at.join(tops.select(F.col("node").alias("far")), "far", "left_semi").select("node", "idom")


def subtree_sums(jumps: DataFrame, values: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(node, *keys, value columns): the sums of each node and all below it.

    ``values``: (node, *keys, number columns), nodes and keys once. Where ways are held, each node counts along its own, summed before the shuffle. Else sums over what lies less
    than 2^k steps below make those over less than 2^(k+1), so there are as many rounds as the depth has digits, and no row for a pair of nodes.
    """
    columns = [c for c in values.columns if c not in ("node", *keys)]
    deepest = _deepest(jumps)
    if deepest < SHALLOW:
        along = values.join(jumps.select("node", "way"), "node", "left").select(F.explode(F.coalesce("way", F.array("node"))).alias("node"), *keys, *columns)
        return along.groupBy("node", *keys).agg(*[F.sum(c).alias(c) for c in columns])
    levels = math.ceil(math.log2(1 + deepest))
    now = values
    for k in range(levels):
        up = jumps.where(F.size("jump") > k).select("node", F.col("jump")[k].alias("_up"))
        lifted = now.join(up, "node").select(F.col("_up").alias("node"), *keys, *columns)
        now = saved(now.unionByName(lifted).groupBy("node", *keys).agg(*[F.sum(c).alias(c) for c in columns]))
    return now
