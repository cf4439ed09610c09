"""The registered queries over the graphs in the tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import formats
from graphlens.operators import history, metrics, paths, scc, selection, traverse, twin, versions
from graphlens.operators.fixpoint import new_folder, reach_set
from graphlens.operators.rules import apply_rules
from graphlens.operators.selection import NodeSelection
from graphlens.sources import documents, gexf
from graphlens.sources.tables import flow, supply, table

from .config import TraversalConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The configuration of the queries: brand 12 parts are not followed, open stock only, returned lines load lazily.
CONFIG = TraversalConfig(
    force_tagged={"N": False},
    force_dynamic={"stock": {"default": ("include", ["O"]), "overrides": {"line": {"branches": ("exclude", ["F"]), "decision": None}}}},
    label_predicates=(("brand", "Brand#12", True, False),),
    force_nodes={"c7": False},
    tiers=(("eager", (), ()), ("lazy", ("R",), ()), ("late", (), ("stock",))),
)

#: The supply graph in SQL.
GRAPH_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS brand FROM region UNION ALL SELECT 'n' || n_nationkey, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, NULL FROM customer UNION ALL SELECT 'o' || o_orderkey, NULL FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_brand FROM part UNION ALL SELECT 's' || s_suppkey, NULL FROM supplier
), edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'directed' AS kind, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS type_key, CAST(NULL AS VARCHAR) AS branch FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'directed', NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'tagged', o_orderpriority, NULL, NULL FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'tagged', l_returnflag, NULL, NULL FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'dynamic', NULL, 'stock', l_linestatus FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), judged AS (
  SELECT e.*, CASE WHEN dst = 'c7' THEN true
                   WHEN t.brand = 'Brand#12' THEN true
                   WHEN tag = 'N' AND kind = 'tagged' THEN true
                   WHEN kind = 'dynamic' THEN branch = 'F' ELSE false END AS excluded,
         CASE WHEN kind = 'tagged' AND tag = 'R' THEN 1 WHEN kind = 'dynamic' THEN 2 END AS to_tier
  FROM edges e LEFT JOIN nodes t ON e.dst = t.node
), live AS (SELECT DISTINCT src, dst, coalesce(to_tier, 0) AS to_tier FROM judged WHERE NOT excluded)
"""
REACHED_SQL = "reached AS (SELECT 'r0' AS node UNION SELECT l.dst FROM reached r JOIN live l ON l.src = r.node)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _named(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def _prepared(spark: SparkSession, sf_dir: str, root: str = "r0", held: str = "judged") -> traverse.Prepared:
    g = supply(spark, sf_dir, by_src=True, once=held != "pairs")
    return traverse.prepare(g.nodes, g.node_metrics, g.edges, CONFIG, _named(spark, root), rows=g.rows, held=held)


@query(f"WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL} SELECT node FROM reached")
def reachability(spark, sf_dir):
    return _prepared(spark, sf_dir).state.where("reachable").select("node")


@query(f"WITH {GRAPH_SQL} SELECT kind, count(*) AS n, CAST(count(*) FILTER (excluded) AS BIGINT) AS n_excluded FROM judged GROUP BY kind")
def edge_stats(spark, sf_dir):
    g = supply(spark, sf_dir)
    return apply_rules(g.edges, g.nodes, CONFIG).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("n_excluded"))


@query(f"WITH {GRAPH_SQL} SELECT src, dst, tag, branch, excluded, CAST(coalesce(to_tier, -1) AS INTEGER) AS to_tier FROM judged")
def edge_rules(spark, sf_dir):
    g = supply(spark, sf_dir)
    return apply_rules(g.edges, g.nodes, CONFIG).select("src", "dst", "tag", "branch", "excluded", F.coalesce("to_tier", F.lit(-1)).alias("to_tier"))


@query(f"""
WITH RECURSIVE {GRAPH_SQL}, t AS (
  SELECT 'r0' AS node, 0 AS tier UNION SELECT l.dst, greatest(t.tier, l.to_tier) FROM t JOIN live l ON l.src = t.node
) SELECT node, CAST(min(tier) AS INTEGER) AS tier FROM t GROUP BY node""")
def tiers(spark, sf_dir):
    return _prepared(spark, sf_dir).state.where("reachable").select("node", "tier")


@query(f"WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL} SELECT dst AS node, count(*) AS parents FROM judged WHERE NOT excluded AND src IN (SELECT node FROM reached) GROUP BY dst")
def parents_count(spark, sf_dir):
    return metrics.parents_count(_prepared(spark, sf_dir)).where("parents > 0")


CLOSURE_SQL = f"""
WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL}, roots AS (SELECT DISTINCT dst AS node FROM live WHERE src = 'r0' OR src IN (SELECT dst FROM live WHERE src = 'r0')),
c AS (SELECT node AS root, node FROM roots UNION SELECT c.root, l.dst FROM c JOIN live l ON l.src = c.node),
price AS (SELECT 'o' || o_orderkey AS node, o_totalprice AS v FROM orders UNION ALL SELECT 'p' || p_partkey, p_retailprice FROM part)
"""


def _children(p: traverse.Prepared, spark: SparkSession) -> DataFrame:
    """Children and grandchildren of r0."""
    level = lambda of: p.steps.join(of.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    first = level(_named(spark, "r0"))
    return first.unionByName(level(first)).distinct()


@query(f"{CLOSURE_SQL} SELECT root AS node, count(*) AS count, round(coalesce(sum(v), 0), 2) AS sum FROM c LEFT JOIN price USING (node) GROUP BY root")
def transitive_sum(spark, sf_dir):
    p = _prepared(spark, sf_dir, held="pairs")
    return metrics.transitive(p, _children(p, spark), "price").withColumn("sum", F.round("sum", 2))


@query(f"{CLOSURE_SQL} SELECT root AS node, count(*) AS count, round(coalesce(sum(v), 0), 2) AS sum FROM c LEFT JOIN price USING (node) GROUP BY root ORDER BY sum DESC, node LIMIT 10 OFFSET 5")
def explore_children_page(spark, sf_dir):
    """The second half-page of ten of the children by price of all they reach."""
    p = _prepared(spark, sf_dir, held="pairs")
    return metrics.top(metrics.transitive(p, _children(p, spark), "price").withColumn("sum", F.round("sum", 2)), "sum", 10, 5)


@query(f"""{CLOSURE_SQL}, ti AS (SELECT 'r0' AS node, 0 AS tier UNION SELECT l.dst, greatest(ti.tier, l.to_tier) FROM ti JOIN live l ON l.src = ti.node),
low AS (SELECT node, min(tier) AS tier FROM ti GROUP BY node), s AS (
  SELECT root, CAST(k AS INTEGER) AS tier, round(sum(v), 2) AS sum FROM c JOIN low USING (node) JOIN price USING (node) JOIN range(3) r(k) ON low.tier <= k GROUP BY root, k
) SELECT root, tier, sum FROM s WHERE sum > 0""")
def tiered_sum(spark, sf_dir):
    p = _prepared(spark, sf_dir, held="pairs")
    return metrics.tiered_of(p, _children(p, spark), "price").withColumn("sum", F.round("sum", 2))


@query(f"""WITH {GRAPH_SQL}, v AS (SELECT coalesce(CAST(p_size AS DOUBLE), 0) AS x, coalesce(c_acctbal, 0) AS y FROM nodes LEFT JOIN part ON node = 'p' || p_partkey LEFT JOIN customer ON node = 'c' || c_custkey)
SELECT 'size' AS metric, min(x) AS least, max(x) AS greatest FROM v UNION ALL SELECT 'balance', min(y), max(y) FROM v
UNION ALL SELECT 'size without zeros', min(x), max(x) FROM v WHERE x <> 0""")
def metric_min_max(spark, sf_dir):
    """Over all nodes: those without the metric count as 0, unless zeros are ignored."""
    g = supply(spark, sf_dir)
    of = lambda name, metric, ignore=False: metrics.metric_range(g.nodes, g.node_metrics, metric, ignore).select(F.lit(name).alias("metric"), "least", "greatest")
    return of("size", "size").unionByName(of("balance", "balance")).unionByName(of("size without zeros", "size", True))


@query(f"""WITH {GRAPH_SQL} SELECT node FROM nodes LEFT JOIN customer ON node = 'c' || c_custkey WHERE floor(abs(coalesce(c_acctbal, 0)) + 0.5) = 0""")
def select_metric_zero(spark, sf_dir):
    """Nodes whose balance is 0 once rounded: also all that have none."""
    g = supply(spark, sf_dir)
    return selection.select_nodes(g.nodes, NodeSelection(metrics={"balance": 0}), g.node_metrics)


@query(f"""WITH {GRAPH_SQL}, v AS (SELECT node, coalesce(CAST(p_size AS DOUBLE), 0) AS x FROM nodes LEFT JOIN part ON node = 'p' || p_partkey), e AS (SELECT min(x) AS a, max(x) AS b FROM v)
SELECT node, round(CASE WHEN x = 0 OR a = b THEN 1 ELSE 1 + 99 * (x - a) / (b - a) END, 6) AS size FROM v, e""")
def sizes_for_display(spark, sf_dir):
    g = supply(spark, sf_dir)
    return metrics.normalised_sizes(g.nodes, g.node_metrics, "size").select("node", F.round("size", 6).alias("size"))


@query("SELECT 'p' || p_partkey AS node FROM part WHERE p_brand = 'Brand#12' AND p_size = 7")
def select_property_and_metric(spark, sf_dir):
    g = supply(spark, sf_dir)
    return selection.select_nodes(g.nodes, NodeSelection(properties={"brand": "Brand#12"}, metrics={"size": 7}), g.node_metrics)


@query(f"WITH {GRAPH_SQL} SELECT node FROM nodes WHERE regexp_matches(node, '^[op]1[0-9]*7$') AND contains(lower(node), '1')")
def select_regex(spark, sf_dir):
    return selection.select_nodes(supply(spark, sf_dir).nodes, NodeSelection(substring="1", regex="^[op]1[0-9]*7$"))


@query(f"WITH {GRAPH_SQL} SELECT node FROM nodes WHERE regexp_matches(node, '1.*2.*3') ORDER BY strlen(node), node LIMIT 20")
def select_fuzzy_top(spark, sf_dir):
    return selection.select_nodes(supply(spark, sf_dir).nodes, NodeSelection(fuzzy="123", limit=20))


@query(f"""WITH {GRAPH_SQL.replace("judged AS (", "judged AS MATERIALIZED (")} SELECT node FROM nodes SEMI JOIN (SELECT DISTINCT dst AS node FROM judged WHERE NOT excluded AND tag = 'R') USING (node)
SEMI JOIN (SELECT DISTINCT src AS node FROM judged WHERE NOT excluded AND type_key = 'stock') USING (node)""")
def select_edge_tags(spark, sf_dir):
    g = supply(spark, sf_dir)
    return selection.select_nodes(g.nodes, NodeSelection(incoming_tags=("R",), outgoing_keys=("stock",)), edges=apply_rules(g.edges, g.nodes, CONFIG))


@query("""SELECT 'property' AS kind, name, count(*) AS n_values FROM (SELECT DISTINCT 'segment' AS name, c_mktsegment AS v FROM customer UNION SELECT DISTINCT 'type', p_type FROM part UNION SELECT DISTINCT 'brand', p_brand FROM part) GROUP BY name
UNION ALL SELECT 'tag', t, 1 FROM (SELECT DISTINCT o_orderpriority AS t FROM orders UNION SELECT DISTINCT l_returnflag FROM lineitem) UNION ALL SELECT 'type_key', 'stock', 1""")
def filter_candidates(spark, sf_dir):
    g = supply(spark, sf_dir)
    return selection.filter_candidates(g.nodes, g.edges).select("kind", "name", "n_values")


@query(f"WITH RECURSIVE {GRAPH_SQL}, up AS (SELECT 's1' AS node UNION SELECT e.src FROM up JOIN edges e ON e.dst = up.node) SELECT node FROM up WHERE node <> 's1' AND node NOT IN (SELECT dst FROM edges)")
def parentless_ancestors(spark, sf_dir):
    return paths.ancestors(supply(spark, sf_dir).edges, _named(spark, "s1"), parentless=True, limit=None).select("node")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, open AS (SELECT DISTINCT src, dst FROM judged WHERE NOT excluded AND dst NOT IN ('n1', 'n2')),
b AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT o.dst, b.depth + 1 FROM b JOIN open o ON o.src = b.node WHERE b.depth < 12)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node""")
def shortest_path_depths(spark, sf_dir):
    g = supply(spark, sf_dir, ordered=True)
    return paths.shortest_paths(apply_rules(g.edges, g.nodes, CONFIG).where("NOT excluded"), _named(spark, "r1"), _named(spark, "n1", "n2")).select("node", "depth")


FLOW_SQL = """
fe AS (SELECT DISTINCT src, dst FROM (SELECT 'u' || user_id AS src, lead('u' || user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst),
fn AS (SELECT 'u' || user_id AS node, CAST(count(*) AS DOUBLE) AS events FROM events GROUP BY 1),
pairs AS (SELECT node AS a, node AS b FROM fn UNION SELECT p.a, fe.dst FROM pairs p JOIN fe ON fe.src = p.b),
scc AS (SELECT p.a AS node, min(p.b) AS scc FROM pairs p JOIN pairs q ON p.a = q.b AND p.b = q.a GROUP BY p.a)
"""


@query(f"WITH RECURSIVE {FLOW_SQL} SELECT node, scc FROM scc")
def scc_membership(spark, sf_dir):
    g = flow(spark, sf_dir)
    return scc.components(g.nodes, g.edges)


@query(f"WITH RECURSIVE {FLOW_SQL} SELECT scc, count(*) AS size, sum(events) AS events FROM scc JOIN fn USING (node) GROUP BY scc")
def scc_condense(spark, sf_dir):
    g = flow(spark, sf_dir)
    made, _ = scc.condense(scc.components(g.nodes, g.edges), g.node_metrics, g.edges)
    return made.select("scc", "size", F.element_at("metrics", "events").alias("events"))


@query(f"WITH RECURSIVE {FLOW_SQL} SELECT DISTINCT scc AS node FROM scc WHERE scc NOT IN (SELECT b.scc FROM fe JOIN scc a ON fe.src = a.node JOIN scc b ON fe.dst = b.node WHERE a.scc <> b.scc)")
def entry_points(spark, sf_dir):
    g = flow(spark, sf_dir)
    return scc.source_entry_points(g.nodes, g.edges)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL}, mid AS (SELECT DISTINCT src AS x FROM live WHERE src IN (SELECT node FROM reached) AND (src LIKE 'n%' OR src LIKE 'c%')),
w AS (SELECT x, 'r0' AS node FROM mid UNION SELECT w.x, l.dst FROM w JOIN live l ON l.src = w.node WHERE l.dst <> w.x)
SELECT x AS node, (SELECT count(*) FROM reached) - count(*) AS count FROM w GROUP BY x""")
def dominated_count(spark, sf_dir):
    """How many nodes each nation and customer dominates that leads on: what is lost without it."""
    p = _prepared(spark, sf_dir)
    leads = p.followed.select(F.col("src").alias("node")).where("node LIKE 'n%' OR node LIKE 'c%'").distinct()
    return metrics.dominated(p).join(leads, "node", "left_semi").select("node", "count")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL}, f AS (SELECT DISTINCT l.src, l.dst FROM live l JOIN reached r ON r.node = l.src),
c AS (SELECT src AS n, dst AS c FROM f WHERE src LIKE 'n%'), o AS (SELECT n, c, dst AS o FROM f JOIN c ON c = src),
p AS (SELECT dst AS p, CASE WHEN count(DISTINCT n) = 1 THEN min(n) END AS n, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS c, CASE WHEN count(DISTINCT o) = 1 THEN min(o) END AS o FROM f JOIN o ON o = src GROUP BY dst),
s AS (SELECT dst AS s, CASE WHEN count(DISTINCT n) = 1 AND count(n) = count(*) THEN min(n) END AS n, CASE WHEN count(DISTINCT c) = 1 AND count(c) = count(*) THEN min(c) END AS c,
  CASE WHEN count(DISTINCT o) = 1 AND count(o) = count(*) THEN min(o) END AS o, CASE WHEN count(DISTINCT p) = 1 THEN min(p) END AS p FROM f JOIN p ON p = src GROUP BY dst)
SELECT dst AS node, src AS idom FROM f WHERE src = 'r0' UNION ALL SELECT c, n FROM c UNION ALL SELECT o, c FROM o UNION ALL SELECT p, coalesce(o, c, n, 'r0') FROM p UNION ALL SELECT s, coalesce(p, o, c, n, 'r0') FROM s""")
def dominator_tree(spark, sf_dir):
    """The immediate dominator of each node that the region reaches."""
    return _prepared(spark, sf_dir, held="steps").tree.where("idom IS NOT NULL")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL}, c AS (SELECT node AS root, node FROM reached UNION SELECT c.root, l.dst FROM c JOIN live l ON l.src = c.node),
price AS (SELECT 'o' || o_orderkey AS node, o_totalprice AS v FROM orders UNION ALL SELECT 'p' || p_partkey, p_retailprice FROM part)
SELECT root AS node, count(*) AS count, round(coalesce(sum(v), 0), 2) AS sum FROM c LEFT JOIN price USING (node) GROUP BY root""")
def transitive_sums_of_all(spark, sf_dir):
    """What every reachable node reaches, by bitmaps."""
    return metrics.transitive_all(_prepared(spark, sf_dir, held="pairs"), "price").withColumn("sum", F.round("sum", 2))


@query()
def min_cut(spark, sf_dir):
    """The least cut between a customer and two parts it reaches."""
    p = _prepared(spark, sf_dir)
    start = p.followed.where("src LIKE 'c%'").select(F.col("src").alias("node")).distinct().orderBy("node").limit(1)
    goals = reach_set(p.followed, start).where("node LIKE 'p%'").orderBy("node").limit(2).select("node")
    return paths.min_cut(p.followed, start, goals)[0]


TWIN_SQL = """
a AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_linestatus AS branch FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01'),
b AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_linestatus AS branch FROM lineitem WHERE l_shipdate < TIMESTAMP '2002-01-01')
"""


def _stock(spark: SparkSession, sf_dir: str, before: str) -> tuple:
    g = supply(spark, sf_dir, before)
    return g.nodes.where("node LIKE 'p%'"), g.node_metrics.where("node LIKE 'p%'"), g.edges.where("type_key = 'stock'")


@query(f"""WITH {TWIN_SQL}, d AS (SELECT DISTINCT src FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)))
SELECT 'p' || p_partkey AS node, CAST(CASE WHEN d.src IS NULL THEN 0 ELSE 4 END AS INTEGER) AS diff FROM part LEFT JOIN d ON d.src = 'p' || p_partkey
UNION ALL SELECT dst, CAST(CASE WHEN x.n IS NULL THEN 1 WHEN y.n IS NULL THEN 2 ELSE 0 END AS INTEGER) FROM (SELECT DISTINCT dst, 1 AS n FROM a) x FULL JOIN (SELECT DISTINCT dst, 1 AS n FROM b) y USING (dst)""")
def twin_node_diff(spark, sf_dir):
    """Parts are declared, their suppliers known only as targets."""
    return twin.node_diff(_stock(spark, sf_dir, "1998-07-01"), _stock(spark, sf_dir, "2002-01-01"))


@query(f"""WITH {TWIN_SQL}, x AS (SELECT src, count(*) AS n FROM a GROUP BY src), y AS (SELECT src, count(*) AS n FROM b GROUP BY src)
SELECT src AS node, coalesce(x.n, 0) AS left, coalesce(y.n, 0) AS right, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM x FULL JOIN y USING (src)""")
def twin_delta(spark, sf_dir):
    n = lambda day: _stock(spark, sf_dir, day)[2].groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("value"))
    return twin.value_delta(n("1998-07-01"), n("2002-01-01"))


@query(f"WITH {TWIN_SQL} SELECT 'add' AS op, src, dst, branch FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'remove', src, dst, branch FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def delta_derive(spark, sf_dir):
    e = lambda day: _stock(spark, sf_dir, day)[2].select("src", "dst", "branch", F.lit(1).alias("held"))
    return versions.derive(e("1998-07-01"), e("2002-01-01"), ["src", "dst", "branch"], "held").select("op", "src", "dst", "branch")


@query(f"WITH {TWIN_SQL} SELECT src, dst, branch FROM b")
def delta_apply(spark, sf_dir):
    """The later graph again, from the earlier one and the changes between them."""
    e = lambda day: _stock(spark, sf_dir, day)[2].select("src", "dst", "branch", F.lit(1).alias("held"))
    keys = ["src", "dst", "branch"]
    changes = versions.derive(e("1998-07-01"), e("2002-01-01"), keys, "held").withColumn("graph_id", F.lit(1))
    return versions.apply(e("1998-07-01"), changes, keys, "held").select(*keys)


def day_number(ts: str):
    """Days since the last one of 2023, so that every day of any month and year has its own number."""
    return F.datediff(F.to_date(ts), F.lit("2023-12-31").cast("date")).cast("long")


#: Days of events are the frames of a timeline; days 8, 9 and 17 are taken as empty, every tenth from the first as full.
FRAMES_SQL = """
frames AS (SELECT 'events' AS timeline_id, CAST(CAST(ts AS DATE) - DATE '2023-12-31' AS BIGINT) AS graph_id, min(ts) AS ts FROM events GROUP BY 1, 2),
typed AS (SELECT *, CASE WHEN graph_id IN (8, 9, 17) THEN 'empty' WHEN graph_id % 10 = 1 THEN 'full' ELSE 'delta' END AS frame_type FROM frames)
"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(day_number("ts").alias("graph_id")).agg(F.min("ts").alias("ts"))
    kind = F.when(F.col("graph_id").isin(8, 9, 17), "empty").when(F.col("graph_id") % 10 == 1, "full").otherwise("delta")
    return days.select(F.lit("events").alias("timeline_id"), "graph_id", "ts", kind.alias("frame_type"))


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT *, sum(CASE WHEN frame_type = 'empty' THEN 1 ELSE 0 END) OVER (ORDER BY graph_id) AS cut FROM typed)
SELECT graph_id, frame_type, coalesce(CASE WHEN frame_type <> 'empty' THEN max(CASE WHEN frame_type = 'full' THEN graph_id END) OVER (PARTITION BY cut ORDER BY graph_id) END, -1) AS full_id FROM c""")
def nearest_full(spark, sf_dir):
    return versions.nearest_full(_frames(spark, sf_dir)).select("graph_id", "frame_type", F.coalesce("full_id", F.lit(-1)).alias("full_id"))


@query(f"WITH {FRAMES_SQL} SELECT graph_id, CASE WHEN frame_type = 'full' AND graph_id > 1 AND lag(frame_type) OVER (ORDER BY graph_id) <> 'empty' THEN 'delta' ELSE frame_type END AS becomes FROM typed")
def compaction(spark, sf_dir):
    return versions.compaction(_frames(spark, sf_dir)).select("graph_id", "becomes")


HISTORY_SQL = f"""{FRAMES_SQL},
v AS (SELECT CAST(CAST(ts AS DATE) - DATE '2023-12-31' AS BIGINT) AS graph_id, 'u' || user_id AS node, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2),
live AS (SELECT v.* FROM v JOIN typed USING (graph_id) WHERE frame_type <> 'empty'),
grid AS (SELECT n.node, t.graph_id, coalesce(l.x, 0) AS x, l.x IS NOT NULL AS here FROM (SELECT DISTINCT node FROM live) n CROSS JOIN typed t LEFT JOIN live l ON l.node = n.node AND l.graph_id = t.graph_id WHERE frame_type <> 'empty'),
s AS (SELECT g.*, p.x AS was, coalesce(p.here, false) AS before, e.graph_id IS NOT NULL AS gap FROM grid g LEFT JOIN grid p ON p.node = g.node AND p.graph_id = g.graph_id - 1 LEFT JOIN typed e ON e.graph_id = g.graph_id - 1 AND e.frame_type = 'empty'),
j AS (SELECT *, NOT gap AND before AND abs(x - was) >= 4 AS over_, NOT gap AND here AND NOT before AS first_ FROM s)
"""


def _history(spark: SparkSession, sf_dir: str, threshold: float = 4.0) -> DataFrame:
    frames = _frames(spark, sf_dir).select("graph_id", (F.col("frame_type") != "empty").alias("has_data"))
    values = table(spark, sf_dir, "events").groupBy(day_number("ts").alias("graph_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return history.judge(frames, values.withColumn("metric", F.lit("events")), threshold)


@query(f"WITH {HISTORY_SQL} SELECT node, graph_id FROM j WHERE over_")
def history_crossings(spark, sf_dir):
    return _history(spark, sf_dir).where(F.col("reasons").bitwiseAND(history.OVER_THRESHOLD) != 0).select("node", "graph_id")


@query(f"""WITH {HISTORY_SQL}, r AS (
  SELECT a.node, a.graph_id, a.here, (CASE WHEN a.first_ THEN 1 ELSE 0 END) + (CASE WHEN a.over_ THEN 2 ELSE 0 END) + (CASE WHEN a.here AND coalesce(b.over_, false) THEN 4 ELSE 0 END)
    + (CASE WHEN a.here AND a.graph_id = (SELECT max(graph_id) FROM typed WHERE frame_type <> 'empty') THEN 8 ELSE 0 END) AS reasons,
    a.gap OR EXISTS (SELECT 1 FROM typed t WHERE t.graph_id = a.graph_id + 1 AND t.frame_type = 'empty') AS barrier
  FROM j a LEFT JOIN j b ON b.node = a.node AND b.graph_id = a.graph_id + 1)
SELECT node, graph_id, CAST(reasons AS INTEGER) AS reasons FROM r WHERE reasons > 0 OR (here AND barrier)""")
def history_reasons(spark, sf_dir):
    return _history(spark, sf_dir).select("node", "graph_id", F.col("reasons").cast("int").alias("reasons"))


@query("""WITH d AS (SELECT 'u' || user_id AS node, CAST(ts AS DATE) AS day, round(CAST(count(*) AS DOUBLE) * 1000) AS v FROM events GROUP BY 1, 2),
w AS (SELECT *, CAST(isoyear(day) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week FROM d),
l AS (SELECT *, lag(v) OVER (PARTITION BY node, week ORDER BY day) AS was FROM w)
SELECT node, week, CAST(day AS VARCHAR) AS day, v / 1000 AS value FROM l WHERE was IS NULL OR was <> v""")
def flat_history_weekly(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node"), F.to_date("ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return history.weekly(daily.withColumn("metric", F.lit("events"))).select("node", "week", F.col("ts").cast("string").alias("day"), "value")


@query("""SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.2f}', floor(o_totalprice * 100 + 0.5) / 100), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS price,
  CASE WHEN o_totalprice * 1000 >= 1e9 THEN format('{:,.2f} GB', floor(o_totalprice * 1000 / 1e9 * 100 + 0.5) / 100) WHEN o_totalprice * 1000 >= 1e6 THEN format('{:,.2f} MB', floor(o_totalprice * 1000 / 1e6 * 100 + 0.5) / 100)
       WHEN o_totalprice * 1000 >= 1e3 THEN format('{:,.2f} kB', floor(o_totalprice * 1000 / 1e3 * 100 + 0.5) / 100) ELSE format('{:,.0f} bytes', floor(o_totalprice * 1000 + 0.5)) END AS size FROM orders""")
def format_values(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.number(price).alias("price"), formats.size(price * 1000).alias("size"))


@query("""SELECT event_id, CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week_start,
  CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week FROM events""")
def calendar(spark, sf_dir):
    ts, day = F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd"
    return table(spark, sf_dir, "events").select("event_id", F.date_format(formats.day_start(ts), day).alias("day"), F.date_format(formats.week_start(ts), day).alias("week_start"), formats.iso_week(ts).alias("week"))


@query(f"""WITH {GRAPH_SQL} SELECT DISTINCT src, dst, kind, tag, type_key, branch, CASE WHEN kind = 'dynamic' THEN '{{"lot":"' || CAST(substr(src, 2) AS BIGINT) % 7 || '"}}' END AS metadata FROM edges""")
def document_round_trip(spark, sf_dir):
    """The edges of the graph as written to and read back from document lines."""
    path = new_folder(spark, "documents")
    documents.write_lines(supply(spark, sf_dir), path)
    return documents.read_lines(spark, path).edges.select("src", "dst", "kind", "tag", "type_key", "branch", "metadata")


@query(f"""WITH {GRAPH_SQL}, ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM nodes), e AS (SELECT DISTINCT src, dst, kind, tag, type_key, branch FROM edges)
SELECT row_number() OVER (ORDER BY src, kind = 'tagged', kind = 'dynamic', tag, type_key, branch, dst) - 1 AS id, s.id AS source, t.id AS target,
  CASE kind WHEN 'tagged' THEN tag WHEN 'dynamic' THEN type_key || ':line:' || branch END AS label FROM e JOIN ids s ON s.node = src JOIN ids t ON t.node = dst""")
def gexf_edges(spark, sf_dir):
    return gexf.elements(supply(spark, sf_dir))[2]


@query(f"WITH {FRAMES_SQL} SELECT graph_id, frame_type FROM typed WHERE frame_type IN ('full', 'delta') AND graph_id BETWEEN 3 AND 25 ORDER BY ts DESC, graph_id DESC LIMIT 7")
def select_frames(spark, sf_dir):
    return versions.select_frames(_frames(spark, sf_dir), "events", ["full", "delta"], least_id=3, most_id=25, descending=True, limit=7).select("graph_id", "frame_type")
