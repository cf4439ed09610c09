"""Registered queries that compare graphs or states of one, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from graphlens.operators import metrics, paths, twin, versions
from graphlens.operators.fixpoint import reach_set, saved
from graphlens.operators.rules import apply_rules
from graphlens.sources.tables import supply, table

from .queries import CONFIG, GRAPH_SQL, TWIN_SQL, _named, _prepared, _stock, query


@query(f"""
WITH RECURSIVE {GRAPH_SQL}, o AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst, c_acctbal > 5000 AS follow FROM customer WHERE c_mktsegment = 'BUILDING'),
w AS (SELECT DISTINCT j.src, j.dst, coalesce(to_tier, 0) AS to_tier FROM judged j LEFT JOIN o ON o.src = j.src AND o.dst = j.dst WHERE NOT coalesce(NOT o.follow, j.excluded)),
t AS (SELECT 'r0' AS node, 0 AS tier UNION SELECT w.dst, greatest(t.tier, w.to_tier) FROM t JOIN w ON w.src = t.node),
low AS (SELECT node, min(tier) AS tier FROM t GROUP BY node),
price AS (SELECT 'o' || o_orderkey AS node, o_totalprice AS v FROM orders UNION ALL SELECT 'p' || p_partkey, p_retailprice FROM part)
SELECT CAST(k AS INTEGER) AS tier, count(*) AS count, round(sum(coalesce(v, 0)), 2) AS sum FROM low LEFT JOIN price USING (node) JOIN range(3) r(k) ON low.tier <= k GROUP BY k""")
def what_if(spark, sf_dir):
    """What r0 would reach by tier if no building customers were followed but those with a balance over 5000 (the later override wins)."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"), "c_acctbal")
    overrides = c.select("src", "dst", F.lit(1).alias("ord"), F.lit(False).alias("follow")).unionByName(c.where("c_acctbal > 5000").select("src", "dst", F.lit(2).alias("ord"), F.lit(True).alias("follow")))
    return metrics.what_if(_prepared(spark, sf_dir), _named(spark, "r0"), overrides, "price").withColumn("sum", F.round("sum", 2))


@query(f"""WITH {TWIN_SQL}, x AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY branch) AS position FROM a), y AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY branch) AS position FROM b)
SELECT src, dst, CAST(position AS INTEGER) AS position, x.src IS NOT NULL AS in_left, y.src IS NOT NULL AS in_right FROM x FULL JOIN y USING (src, dst, position)""")
def twin_arrows(spark, sf_dir):
    return twin.twin_arrows(_ordered(spark, sf_dir, "1998-07-01"), _ordered(spark, sf_dir, "2002-01-01"))


def _ordered(spark, sf_dir, before):
    return supply(spark, sf_dir, before, ordered=True).edges.where("type_key = 'stock'")


#: Parts and the orders that hold them, by lines shipped before 2000 and by those shipped from 1997 on: each line is in one version at least.
LINES_SQL = ", ".join(f"{n} AS (SELECT DISTINCT 'p' || l_partkey AS src, 'o' || l_orderkey AS dst, l_returnflag AS tag FROM lineitem WHERE l_shipdate {when})" for n, when in (("a", "< TIMESTAMP '2000-01-01'"), ("b", ">= TIMESTAMP '1997-01-01'"))) + """,
ln AS (SELECT DISTINCT dst AS node FROM a), rn AS (SELECT DISTINCT dst AS node FROM b)
"""


def _sides(spark, sf_dir):
    """All parts, and the edges from them to orders in both versions."""
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    shipped, name = F.col("l_shipdate"), lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    roots = table(spark, sf_dir, "part").select(name("p", "p_partkey").alias("node"))
    sides = []
    for held in (shipped < day("2000-01-01"), shipped >= day("1997-01-01")):
        lines = table(spark, sf_dir, "lineitem").where(held).select("l_partkey", "l_orderkey", "l_returnflag").distinct()
        sides.append(lines.select(name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst"), F.col("l_returnflag").alias("tag"), F.ascii("l_returnflag").cast("long").alias("edge_ord")))
    return roots, sides


def _pairs(roots, edges):
    return roots.select(F.col("node").alias("root"), "node").unionByName(edges.select(F.col("src").alias("root"), F.col("dst").alias("node"))).distinct()


@query(f"""WITH {LINES_SQL}, ch AS ((SELECT node FROM ln EXCEPT SELECT node FROM rn) UNION ALL (SELECT node FROM rn EXCEPT SELECT node FROM ln)),
x AS (SELECT DISTINCT src, dst, CAST(-1 AS DOUBLE) AS v FROM a UNION ALL SELECT DISTINCT src, dst, 1 FROM b)
SELECT src AS root, sum(v) AS delta FROM x JOIN ch ON dst = node GROUP BY src""")
def exclusive_delta(spark, sf_dir):
    """By part, how many of its orders came to be reached from any part, less those that ceased to be."""
    roots, sides = _sides(spark, sf_dir)
    pairs = [_pairs(roots, e) for e in sides]
    states = [p.select("node", F.lit(True).alias("reachable")).distinct() for p in pairs]
    return twin.exclusive_delta(*pairs, *states)


@query(f"""WITH {LINES_SQL}, x AS (SELECT src, dst, tag = 'A' AS excluded, row_number() OVER (PARTITION BY src, dst ORDER BY tag) AS position FROM a),
y AS (SELECT src, dst, tag = 'R' AS excluded, row_number() OVER (PARTITION BY src, dst ORDER BY tag) AS position FROM b)
SELECT src, dst, CAST(position AS INTEGER) AS position, CASE WHEN dst NOT IN (SELECT node FROM ln) THEN CASE WHEN dst IN (SELECT node FROM rn) THEN 'node_became_reachable' ELSE 'no_change' END
  WHEN dst NOT IN (SELECT node FROM rn) THEN 'node_became_unreachable' WHEN x.src IS NULL THEN CASE WHEN y.excluded THEN 'excluded_edge_was_added' ELSE 'edge_was_added' END
  WHEN y.src IS NULL THEN CASE WHEN x.excluded THEN 'excluded_edge_was_removed' ELSE 'edge_was_removed' END
  WHEN x.excluded AND NOT y.excluded THEN 'edge_became_included' WHEN y.excluded AND NOT x.excluded THEN 'edge_became_excluded' ELSE 'no_change' END AS change
FROM x FULL JOIN y USING (src, dst, position)""")
def edge_classes(spark, sf_dir):
    """What became of each edge from a part to an order; tag A is excluded in the first version, tag R in the second."""
    roots, sides = _sides(spark, sf_dir)
    states = [_pairs(roots, e).select("node", F.lit(True).alias("reachable")).distinct() for e in sides]
    return twin.edge_classes(*(e.withColumn("excluded", F.col("tag") == t) for e, t in zip(sides, "AR", strict=True)), *states)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, hot AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_brand = 'Brand#12' UNION SELECT 'r' || r_regionkey FROM region UNION SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
e AS (SELECT DISTINCT src, dst FROM edges),
f AS (SELECT node AS goal, node, -1 AS skipped FROM hot UNION SELECT f.goal, e.src, f.skipped + 1 FROM f JOIN e ON e.dst = f.node WHERE f.skipped = -1 OR f.node NOT IN (SELECT node FROM hot))
SELECT node AS src, goal AS dst, CAST(min(skipped) AS INTEGER) AS skipped FROM f WHERE skipped >= 0 AND node IN (SELECT node FROM hot) AND node <> goal GROUP BY node, goal""")
def changed_frontier(spark, sf_dir):
    """The graph of regions, building customers and parts of a brand alone, with how many others lie between."""
    g = supply(spark, sf_dir)
    hot = g.nodes.where((F.element_at("props", "brand") == "Brand#12") | F.col("node").startswith("r") | (F.element_at("props", "segment") == "BUILDING"))
    return twin.changed_frontier(g.edges, hot)


MERGE_SQL = ", ".join(f"{n} AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) {y})" for n, y in (("a", "< 1996"), ("m", "= 1996"), ("b", "> 1996")))


@query(f"""WITH {MERGE_SQL}, k AS (SELECT * FROM a UNION SELECT * FROM m UNION SELECT * FROM b),
x AS (SELECT k.*, a.l_partkey IS NOT NULL AS in_a, m.l_partkey IS NOT NULL AS in_m, b.l_partkey IS NOT NULL AS in_b FROM k LEFT JOIN a USING (l_partkey, l_suppkey) LEFT JOIN m USING (l_partkey, l_suppkey) LEFT JOIN b USING (l_partkey, l_suppkey))
SELECT CASE WHEN in_a AND in_b THEN 'change' WHEN in_a THEN 'remove' ELSE 'add' END AS op, l_partkey, l_suppkey FROM x WHERE (in_a AND in_b AND NOT in_m) OR in_a <> in_b""")
def delta_merge(spark, sf_dir):
    """What parts were shipped by whom before a year, in it and after it: the changes of two steps as those of one."""
    year = F.year("l_shipdate")
    span = lambda held: table(spark, sf_dir, "lineitem").where(held).select("l_partkey", "l_suppkey", F.lit(1).alias("held")).distinct()
    keys = ["l_partkey", "l_suppkey"]
    spans = [span(year < 1996), span(year == 1996), span(year > 1996)]
    steps = [versions.derive(spans[k], spans[k + 1], keys, "held").withColumn("graph_id", F.lit(k)) for k in (0, 1)]
    return versions.merge(steps[0].unionByName(steps[1]), keys, "held").select("op", *keys)


@query(f"""WITH {GRAPH_SQL}, d AS (SELECT j.src, j.dst, j.kind, j.excluded AS was, CASE WHEN kind = 'tagged' AND tag = 'N' THEN (dst = 'c7' OR t.brand = 'Brand#12') ELSE j.excluded END AS now FROM judged j LEFT JOIN nodes t ON t.node = j.dst)
SELECT kind, CAST(count(*) FILTER (was AND NOT now) AS BIGINT) AS included, CAST(count(*) FILTER (now AND NOT was) AS BIGINT) AS excluded FROM d GROUP BY kind""")
def config_effect(spark, sf_dir):
    """How many edges of each kind are judged differently once the rule for a tag is left out."""
    g = supply(spark, sf_dir)
    keys = ["src", "dst", "kind", "tag", "branch"]
    with_, without = (apply_rules(g.edges, g.nodes, c).select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], F.col("excluded").alias(n)) for c, n in ((CONFIG, "was"), (replace(CONFIG, force_tagged={}), "now")))
    return with_.join(without, keys).groupBy("kind").agg(F.count_if(F.col("was") & ~F.col("now")).alias("included"), F.count_if(F.col("now") & ~F.col("was")).alias("excluded"))


@query()
def find_path(spark, sf_dir):
    """A shortest path from a region to the least supplier that is reached from it, over edges that are followed."""
    g = supply(spark, sf_dir, ordered=True)
    live = saved(apply_rules(g.edges, g.nodes, CONFIG).where("NOT excluded"))
    goal = reach_set(live, _named(spark, "r1")).where("node LIKE 's%'").orderBy("node").limit(1).select("node")
    return paths.find_path(live, _named(spark, "r1"), goal)
