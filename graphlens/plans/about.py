"""Registered queries that describe and search graphs, and read or delete ranges of histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import formats
from graphlens.operators import about, history
from graphlens.operators.selection import NodeSelection
from graphlens.sources.tables import supply, table
from graphlens.streaming import ingest

from .queries import CONFIG, GRAPH_SQL, HISTORY_SQL, REACHED_SQL, _prepared, query
from .timelines import DAYS_SQL, REASONS_SQL, _days, _streamed


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {REACHED_SQL}, every AS (SELECT node FROM nodes UNION SELECT src FROM edges UNION SELECT dst FROM edges),
e AS (SELECT count(*) AS edges, CAST(count(*) FILTER (kind = 'directed') AS BIGINT) AS directed_edges, CAST(count(*) FILTER (kind = 'tagged') AS BIGINT) AS tagged_edges,
  CAST(count(*) FILTER (kind = 'dynamic') AS BIGINT) AS dynamic_edges, CAST(count(*) FILTER (excluded) AS BIGINT) AS excluded_edges FROM judged)
SELECT n.*, e.* FROM (SELECT count(*) AS nodes, count(*) - count(reached.node) AS unreachable_nodes FROM every LEFT JOIN reached ON reached.node = every.node) n, e""")
def about_stats(spark, sf_dir):
    return about.stats(_prepared(spark, sf_dir))


@query("""WITH m AS (SELECT 'price' AS metric, (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS nodes UNION ALL SELECT 'size', count(*) FROM part UNION ALL SELECT 'balance', count(*) FROM customer)
SELECT metric, nodes, concat_ws(' ', metric, metric || '~transitive', metric || '~dominated', metric || '#eager', metric || '#eager~dominated', metric || '#lazy', metric || '#lazy~dominated', metric || '#late', metric || '#late~dominated') AS views FROM m
UNION ALL SELECT NULL, 0, 'parents-count node-count~transitive node-count~dominated tier'""")
def about_metrics(spark, sf_dir):
    views = about.metric_views(supply(spark, sf_dir).node_metrics, [t[0] for t in CONFIG.tiers])
    return views.select("metric", "nodes", F.array_join("views", " ").alias("views"))


@query(f"""WITH {GRAPH_SQL} SELECT 'p' || p_partkey AS node, p_type AS type, p_retailprice AS price, (SELECT count(*) FROM edges WHERE src = 'p' || p_partkey) AS stocked
FROM part WHERE p_brand = 'Brand#13' AND 'p' || p_partkey LIKE '%7%' ORDER BY 1 LIMIT 30""")
def search_nodes(spark, sf_dir):
    """Parts of a brand by a piece of their names, first thirty, with what their documents hold."""
    found = about.search(supply(spark, sf_dir), NodeSelection(substring="7", properties={"brand": "Brand#13"}))
    stocked = F.aggregate(F.map_values(F.col("spec.edges_dynamic")["stock"]["line"]["branches"]), F.lit(0).cast("long"), lambda n, to: n + F.size(to))
    return found.select("node", F.col("spec.properties")["type"].alias("type"), F.col("spec.metrics")["price"].alias("price"), F.coalesce(stocked, F.lit(0)).alias("stocked"))


@query(f"""WITH {DAYS_SQL}, w AS (SELECT DISTINCT week, graph_id FROM d), k AS (SELECT DISTINCT node, metric, week FROM d)
SELECT k.node, k.metric, w.graph_id, d.value FROM k JOIN w USING (week) LEFT JOIN d ON d.node = k.node AND d.metric = k.metric AND d.week = k.week AND d.graph_id = w.graph_id
WHERE w.graph_id BETWEEN 5 AND 17 AND k.node IN (SELECT 'u' || user_id FROM events WHERE event_type = 'purchase')
  AND k.node IN (SELECT node FROM d WHERE graph_id BETWEEN 5 AND 17)""")
def history_range(spark, sf_dir):
    """What users who purchased did on the days of two frames and between, across weeks; weeks are written twice and read once."""
    days = _days(spark, sf_dir)
    rows = history.dense(days, days.select("graph_id", "week").distinct())
    buyers = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node")).distinct()
    return history.read_range(rows.unionByName(rows), buyers, 5, 17)


@query(f"WITH {HISTORY_SQL}, {REASONS_SQL} SELECT node, graph_id, reasons FROM kept WHERE graph_id NOT BETWEEN 5 AND 12 AND NOT (node = 'u1' AND graph_id >= 20)")
def history_delete(spark, sf_dir):
    """The streamed history once a range of frames, and one user's rows from a frame on, are deleted."""
    store = _streamed(spark, sf_dir)
    ingest.delete(spark, store, 5, 12)
    ingest.delete(spark, store, 20, None, "u1")
    return ingest.read(spark, store).select("node", "graph_id", "reasons")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'query' WHEN event_id % 3 = 1 THEN 'frame' ELSE 'timeline' END AS kind, CASE WHEN event_id % 3 > 0 THEN event_type END AS timeline_id,
  CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS BIGINT) END AS graph_id, CASE WHEN event_id % 3 = 0 THEN 'gqc_' || event_type END AS query_key FROM events""")
def handles(spark, sf_dir):
    """Handles of all three forms made from events, and taken apart again."""
    kind, name = F.col("event_id") % 3, F.col("event_type")
    text = F.when(kind == 0, F.concat(F.lit("gqc_"), name)).when(kind == 1, F.concat(name, F.lit("~"), F.col("event_id").cast("string"))).otherwise(name)
    return table(spark, sf_dir, "events").select("event_id", formats.handle(text).alias("h")).select("event_id", "h.*")


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 60 THEN text END AS whole, strlen(text) > 60 AS cut FROM documents""")
def truncated_texts(spark, sf_dir):
    """Texts of at most 60 bytes stay; others lose their middle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", formats.truncated("text", 60).alias("short"))
    return docs.select("doc_id", F.when(F.col("short") == F.col("text"), F.col("short")).alias("whole"), F.col("short").contains("in the middle...").alias("cut"))
