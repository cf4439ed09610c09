"""Registered queries that explore graphs, compare them and fetch versions, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from graphlens.operators import deltas, explore, paths, traverse, versions
from graphlens.operators.fixpoint import new_folder, reach_set, saved
from graphlens.operators.messages import message_id, rendered, with_messages
from graphlens.operators.rules import apply_rules
from graphlens.operators.selection import NodeSelection
from graphlens.sources.frames import FrameStore
from graphlens.sources.tables import Graph, supply, table

from .config import MetricView
from .queries import CLOSURE_SQL, CONFIG, FRAMES_SQL, GRAPH_SQL, REACHED_SQL, _frames, _named, _prepared, day_number, query


@query(f"""{CLOSURE_SQL}, ti AS (SELECT 'r0' AS node, 0 AS tier UNION SELECT l.dst, greatest(ti.tier, l.to_tier) FROM ti JOIN live l ON l.src = ti.node),
low AS (SELECT node, min(tier) AS tier FROM ti GROUP BY node), kids AS (SELECT dst AS node FROM judged WHERE src = 'r0' AND NOT excluded),
s AS (SELECT root AS node, count(*) AS n, sum(v) AS total, sum(CASE WHEN low.tier <= 1 THEN v ELSE 0 END) AS lazy FROM c JOIN low USING (node) LEFT JOIN price USING (node) WHERE root IN (SELECT node FROM kids) GROUP BY root)
SELECT kids.node, round(coalesce(s.total, 0), 2) AS transitive, round(coalesce(s.lazy, 0), 2) AS lazy, CAST(s.n AS DOUBLE) AS reached, CAST(1 AS DOUBLE) AS parents, coalesce(low.tier, 0)::DOUBLE AS tier
FROM kids JOIN s USING (node) LEFT JOIN low USING (node)""")
def explore_columns(spark, sf_dir):
    """The children of a region with a column for each view, by what they reach."""
    views = ["price~transitive", "price#lazy", "node-count~transitive", "parents-count", "tier"]
    page = explore.explore(_prepared(spark, sf_dir), "node:r0", [MetricView.parse(v) for v in views], sort="price~transitive").rows
    return page.select("node", F.round("`price~transitive`", 2).alias("transitive"), F.round("`price#lazy`", 2).alias("lazy"), F.col("`node-count~transitive`").alias("reached"), F.col("`parents-count`").alias("parents"), "tier")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL}, hit AS (SELECT node FROM reached JOIN nodes USING (node) WHERE regexp_matches(node, '^p.*7')) SELECT count(*) AS total FROM hit""")
def explore_total(spark, sf_dir):
    return explore.explore(_prepared(spark, sf_dir), NodeSelection(regex="^p.*7"), []).total


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL} SELECT node, coalesce(p_retailprice, o_totalprice, 0) AS price FROM reached LEFT JOIN part ON node = 'p' || p_partkey LEFT JOIN orders ON node = 'o' || o_orderkey
ORDER BY price DESC, node LIMIT 50 OFFSET 20""")
def explore_all_by_price(spark, sf_dir):
    page = explore.explore(_prepared(spark, sf_dir), "all", [MetricView("price")], sort="price", offset=20).rows
    return page.select("node", "price")


@query(f"""WITH {GRAPH_SQL} SELECT dst AS node, tag, excluded, CASE WHEN dst = 'c7' THEN 'node_force_excluded' WHEN t.brand = 'Brand#12' THEN 'force_labels_excluded' WHEN tag = 'N' THEN 'force_tagged_excluded' END AS message_id
FROM judged LEFT JOIN nodes t ON t.node = dst WHERE kind = 'tagged' AND src LIKE 'o%'""")
def exclusion_messages(spark, sf_dir):
    """Every edge from an order to a part with the id of the message that says why it is not followed."""
    g = supply(spark, sf_dir)
    judged = apply_rules(g.edges, g.nodes, CONFIG).where("kind = 'tagged' AND src LIKE 'o%'")
    return judged.select(F.col("dst").alias("node"), "tag", "excluded", message_id().alias("message_id"))


@query(f"""WITH {GRAPH_SQL} SELECT dst AS node, 'This edge was EXCLUDED because it matched the `force_dynamic` config for type_key `type_key=stock, edge_name=line` on branch `' || branch || '`.' AS message FROM judged WHERE kind = 'dynamic' AND excluded""")
def exclusion_texts(spark, sf_dir):
    g = supply(spark, sf_dir)
    judged = apply_rules(g.edges, g.nodes, CONFIG).where("kind = 'dynamic' AND excluded")
    return judged.select(F.col("dst").alias("node"), rendered().alias("message"))


@query(f"""WITH {GRAPH_SQL} SELECT src, dst, tag, CASE WHEN t.brand = 'Brand#12' THEN 'no_brand' WHEN tag = 'N' THEN 'force_tagged_excluded' ELSE 'kept' END AS message_id,
CASE WHEN t.brand = 'Brand#12' THEN 'No ' || dst || ' for ' || src WHEN tag = 'N' THEN 'Out by ' || tag ELSE 'Kept: ' || tag END AS message
FROM judged LEFT JOIN nodes t ON t.node = dst WHERE kind = 'tagged' AND src LIKE 'o%' AND (t.brand = 'Brand#12' OR tag IN ('N', 'A'))""")
def entry_messages(spark, sf_dir):
    """What the entries of a configuration say of the edges from orders to parts: one by its own text, one by an id that is not known, one by a brand."""
    g = supply(spark, sf_dir)
    named = {("force_tagged", "N"): "unknown", ("force_tagged", "A"): "kept", ("label", 0): "no_brand"}
    texts = {"no_brand": "No %points_to% for %points_from%", "force_tagged_excluded": "Out by %edge_tag%", "kept": "Kept: %edge_tag%"}
    config = replace(CONFIG, force_tagged={"N": False, "A": True}, message_of=named, messages=texts)
    judged = apply_rules(g.edges, g.nodes, config).where("kind = 'tagged' AND src LIKE 'o%' AND rule IS NOT NULL")
    return with_messages(judged, g.nodes, config).select("src", "dst", "tag", "message_id", "message")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL} SELECT e.src AS node, e.excluded, e.src NOT IN (SELECT node FROM reached) AS unreachable FROM judged e WHERE e.dst = 's1'""")
def arrows_into_supplier(spark, sf_dir):
    """All parts that a supplier stocks, followed or not: the reverse arrows of a node."""
    return explore.targets(_prepared(spark, sf_dir), "node:s1", "reverse", excluded=True).select("node", "excluded", "unreachable")


#: The same graph under two configurations: the second follows tag N.
OTHER = replace(CONFIG, force_tagged={})
BOTH_SQL = f"""{GRAPH_SQL}, later AS (SELECT DISTINCT src, dst, coalesce(to_tier, 0) AS to_tier FROM judged j LEFT JOIN nodes t ON t.node = j.dst
  WHERE NOT CASE WHEN kind = 'tagged' THEN (dst = 'c7' OR coalesce(t.brand = 'Brand#12', false)) ELSE excluded END),
l AS (SELECT 'r0' AS node UNION SELECT e.dst FROM l JOIN live e ON e.src = l.node), r AS (SELECT 'r0' AS node UNION SELECT e.dst FROM r JOIN later e ON e.src = r.node)
"""


def _both(spark, sf_dir, held: str = "steps"):
    """``held``: ``laid``, if edges are asked for by themselves; else only the pairs that are followed are saved, with ``pairs`` without counting their edges."""
    g = supply(spark, sf_dir, by_src=True, once=held != "pairs")
    edges = traverse.laid(g.edges, g.rows) if held == "laid" else g.edges
    return traverse.prepare_all(g.nodes, g.node_metrics, edges, [CONFIG, OTHER], _named(spark, "r0"), g.rows, by_src=held == "laid", counted=held != "pairs")


@query(f"""WITH RECURSIVE {BOTH_SQL}, n AS (SELECT node, l.node IS NOT NULL AS a, r.node IS NOT NULL AS b FROM l FULL JOIN r USING (node)),
pl AS (SELECT dst AS node, count(*) AS n FROM judged WHERE NOT excluded AND src IN (SELECT node FROM l) GROUP BY dst),
pr AS (SELECT j.dst AS node, count(*) AS n FROM judged j LEFT JOIN nodes t ON t.node = j.dst WHERE NOT CASE WHEN kind = 'tagged' THEN (dst = 'c7' OR coalesce(t.brand = 'Brand#12', false)) ELSE excluded END AND src IN (SELECT node FROM r) GROUP BY j.dst)
SELECT node, CAST(coalesce(pr.n, 0) AS DOUBLE) AS parents, CAST(coalesce(pr.n, 0) - coalesce(pl.n, 0) AS DOUBLE) AS delta, a <> b AS changed
FROM n LEFT JOIN pl USING (node) LEFT JOIN pr USING (node) ORDER BY abs(coalesce(pr.n, 0) - coalesce(pl.n, 0)) DESC, node LIMIT 200""")
def explore_delta_rows(spark, sf_dir):
    """What is reached under either configuration, by how the number of parents differs."""
    left, right = _both(spark, sf_dir)
    page = explore.explore_delta(left, right, "all", [MetricView("", "parents"), MetricView("", "parents", None, "delta")], sort="parents-count@delta", limit=200).rows
    return page.select("node", F.col("`parents-count`").alias("parents"), F.col("`parents-count@delta`").alias("delta"), "changed")


@query(f"""WITH RECURSIVE {BOTH_SQL}, n AS (SELECT node, l.node IS NOT NULL AS a, r.node IS NOT NULL AS b FROM l FULL JOIN r USING (node))
SELECT CAST(count(*) FILTER (a <> b) AS BIGINT) AS total, CAST(count(*) FILTER (a = b) AS BIGINT) AS hidden FROM n""")
def explore_delta_total(spark, sf_dir):
    left, right = _both(spark, sf_dir)
    return explore.explore_delta(left, right, "all", [], changed_only=True).total


@query(f"""WITH RECURSIVE {BOTH_SQL}, ch AS (SELECT node FROM l FULL JOIN r USING (node) WHERE l.node IS NULL OR r.node IS NULL), kids AS (SELECT dst AS node FROM judged WHERE src = 'r0' AND NOT excluded),
cl AS (SELECT node AS root, node FROM kids UNION SELECT c.root, e.dst FROM cl c JOIN live e ON e.src = c.node), cr AS (SELECT node AS root, node FROM kids UNION SELECT c.root, e.dst FROM cr c JOIN later e ON e.src = c.node),
d AS (SELECT root, -1 AS v FROM cl JOIN ch USING (node) UNION ALL SELECT root, 1 FROM cr JOIN ch USING (node))
SELECT kids.node, coalesce(CAST(sum(v) AS DOUBLE), 0) AS delta FROM kids LEFT JOIN d ON d.root = kids.node GROUP BY kids.node""")
def exclusive_count_of_children(spark, sf_dir):
    """For each child of a region, how many nodes it reaches that only one configuration reaches at all."""
    left, right = _both(spark, sf_dir, "laid")
    page = explore.explore_delta(left, right, "node:r0", [MetricView("", "count_transitive", None, "delta")], limit=1000).rows
    return page.select("node", F.col("`node-count~transitive@delta`").alias("delta"))


def _versions(spark, sf_dir) -> tuple[Graph, Graph]:
    """Parts now, and once those of size over 40 are gone, prices are rounded to tens and the types of the smallest are taken away."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")
    labels = F.create_map(F.lit("brand"), F.array("p_brand")).alias("labels")
    kind = lambda keep: F.map_filter(F.create_map(F.lit("type"), F.when(keep, F.col("p_type")), F.lit("brand"), F.col("p_brand")), lambda k, v: v.isNotNull()).alias("props")
    edges = spark.createDataFrame([], "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string, metadata string, edge_ord long")
    old = Graph(part.select(name, kind(F.lit(True)), labels), part.select(name, F.lit("price").alias("metric"), F.col("p_retailprice").alias("value")), edges)
    later = part.where("p_size <= 40")
    return old, Graph(later.select(name, kind(F.col("p_size") > 3), labels), later.select(name, F.lit("price").alias("metric"), (F.floor(F.col("p_retailprice") / 10) * 10).cast("double").alias("value")), edges)


@query("""SELECT CASE WHEN p_size > 40 THEN 'remove' ELSE 'change' END AS op, 'p' || p_partkey AS node, 'price' AS metric, CASE WHEN p_size <= 40 THEN floor(p_retailprice / 10) * 10 END AS value
FROM part WHERE p_size > 40 OR floor(p_retailprice / 10) * 10 <> p_retailprice""")
def delta_metrics(spark, sf_dir):
    return deltas.derive(*_versions(spark, sf_dir))["metrics"]


@query("""SELECT 'remove' AS op, 'p' || p_partkey AS node, 'type' AS name, CAST(NULL AS VARCHAR) AS value FROM part WHERE p_size > 40 OR p_size <= 3
UNION ALL SELECT 'remove', 'p' || p_partkey, 'brand', NULL FROM part WHERE p_size > 40""")
def delta_properties(spark, sf_dir):
    return deltas.derive(*_versions(spark, sf_dir))["properties"]


@query("SELECT 'remove' AS op, 'p' || p_partkey AS node, 'brand' AS name, p_brand AS label FROM part WHERE p_size > 40")
def delta_labels(spark, sf_dir):
    return deltas.derive(*_versions(spark, sf_dir))["labels"].select("op", "node", "name", "label")


@query("""SELECT 'p' || p_partkey AS node, CASE WHEN p_size > 3 THEN p_type END AS type, p_brand AS brand, floor(p_retailprice / 10) * 10 AS price FROM part WHERE p_size <= 40""")
def graph_delta_apply(spark, sf_dir):
    """The later graph again, whole, from the earlier one and the changes of all its parts."""
    old, new = _versions(spark, sf_dir)
    back = deltas.apply(old, deltas.derive(old, new))
    one = back.node_metrics.select("node", F.col("value").alias("price"))
    return back.nodes.join(one, "node").select("node", F.element_at("props", "type").alias("type"), F.element_at("props", "brand").alias("brand"), "price")


def _store(spark, sf_dir, fulls: tuple[int, ...] = (), expires: str = "false") -> FrameStore:
    """Days of events as frames of counts by user and type: every tenth (and ``fulls``) in full, others as changes, three empty; ``expires`` says which expire in 2025."""
    store = FrameStore(spark, new_folder(spark, "store"), ["user_id", "event_type"], "n", "user_id long, event_type string, n long")
    frames = _frames(spark, sf_dir)
    frames = frames.withColumn("expires_at", F.when(F.expr(expires), F.lit("2025-01-01").cast("timestamp_ntz")))
    frames = saved(frames.withColumn("frame_type", F.when(F.col("graph_id").isin(list(fulls)), "full").otherwise(F.col("frame_type"))))
    live = frames.where("frame_type <> 'empty'").select("graph_id", "frame_type")
    counts = table(spark, sf_dir, "events").groupBy(day_number("ts").alias("graph_id"), F.col("user_id").cast("long").alias("user_id"), "event_type").agg(F.count(F.lit(1)).alias("n")).join(live, "graph_id")
    counts = saved(counts)
    full = counts.where("frame_type = 'full'").select("graph_id", F.lit("full").alias("op"), *store.keys, "n")
    before = counts.select((F.col("graph_id") + 1).alias("graph_id"), *store.keys, "n").join(live.where("frame_type = 'delta'"), "graph_id", "left_semi")
    changes = versions.derive(before, counts.where("frame_type = 'delta'").select("graph_id", *store.keys, "n"), ["graph_id", *store.keys], "n")
    store.add(frames, full.unionByName(changes.select("graph_id", "op", *store.keys, "n")).withColumn("timeline_id", F.lit("events")))
    return store


#: Frames 9 to 10 and 18 to 20 stand after a gap without a full frame, so they cannot be fetched.
COUNTS_SQL = f"WITH {FRAMES_SQL}, n AS (SELECT CAST(CAST(ts AS DATE) - DATE '2023-12-31' AS BIGINT) AS graph_id, CAST(user_id AS BIGINT) AS user_id, event_type, count(*) AS n FROM events GROUP BY ALL)"


@query(f"{COUNTS_SQL} SELECT user_id, event_type, n FROM n WHERE graph_id = 16")
def fetch_frame(spark, sf_dir):
    """A version from the last full frame before it and the changes since."""
    return _store(spark, sf_dir).fetch("events", 16)


@query(f"{COUNTS_SQL} SELECT graph_id, user_id, event_type, n FROM n WHERE graph_id BETWEEN 5 AND 24 AND graph_id NOT IN (8, 9, 10, 17, 18, 19, 20)")
def load_frames(spark, sf_dir):
    return _store(spark, sf_dir).load_range("events", 5, 24)


@query(f"{COUNTS_SQL} SELECT graph_id, user_id, event_type, n FROM n WHERE graph_id IN (8, 9, 11)")
def store_frame_range(spark, sf_dir):
    """Two empty frames filled as a range, and a full one beside them that stays."""
    store = _store(spark, sf_dir)
    counts = table(spark, sf_dir, "events").groupBy(day_number("ts").alias("graph_id"), F.col("user_id").cast("long").alias("user_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    store.store_range("events", counts.where("graph_id IN (8, 9)"))
    return store.load_range("events", 8, 11).where("graph_id <> 10")


@query(f"{COUNTS_SQL} SELECT user_id, event_type, n FROM n WHERE graph_id = 26")
def fetch_compacted_frame(spark, sf_dir):
    """A version once full frames that follow another were rewritten as changes."""
    store = _store(spark, sf_dir, (14, 24))
    if store.compact("events") != 2:
        raise ValueError("two full frames follow another version")
    return store.fetch("events", 26)


@query(f"""WITH RECURSIVE {GRAPH_SQL}, open AS (SELECT DISTINCT src, dst FROM judged WHERE NOT excluded), b AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT o.dst, b.depth + 1 FROM b JOIN open o ON o.src = b.node WHERE b.depth < 12)
SELECT min(depth) + 1 AS nodes FROM b WHERE node = (SELECT min(node) FROM b WHERE node LIKE 's%')""")
def find_path_length(spark, sf_dir):
    """How many nodes a shortest path has from a region to the least supplier it reaches."""
    g = supply(spark, sf_dir, ordered=True)
    live = saved(apply_rules(g.edges, g.nodes, CONFIG).where("NOT excluded"))
    goal = reach_set(live, _named(spark, "r1")).where("node LIKE 's%'").orderBy("node").limit(1).select("node")
    return paths.find_path(live, _named(spark, "r1"), goal).agg(F.count(F.lit(1)).alias("nodes"))
