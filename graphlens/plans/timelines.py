"""Registered queries over frames, histories and times, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import formats
from graphlens.operators import history, versions
from graphlens.operators.fixpoint import new_folder
from graphlens.sources.tables import table
from graphlens.streaming import ingest

from .queries import FRAMES_SQL, HISTORY_SQL, _frames, _history, day_number, query

REASONS_SQL = """r AS (
  SELECT a.node, a.graph_id, a.here, (CASE WHEN a.first_ THEN 1 ELSE 0 END) + (CASE WHEN a.over_ THEN 2 ELSE 0 END) + (CASE WHEN a.here AND coalesce(b.over_, false) THEN 4 ELSE 0 END)
    + (CASE WHEN a.here AND a.graph_id = (SELECT max(graph_id) FROM typed WHERE frame_type <> 'empty') THEN 8 ELSE 0 END) AS reasons,
    a.gap OR EXISTS (SELECT 1 FROM typed t WHERE t.graph_id = a.graph_id + 1 AND t.frame_type = 'empty') AS barrier
  FROM j a LEFT JOIN j b ON b.node = a.node AND b.graph_id = a.graph_id + 1),
kept AS (SELECT node, graph_id, CAST(reasons AS INTEGER) AS reasons FROM r WHERE reasons > 0 OR (here AND barrier))"""
HIGHER_SQL = HISTORY_SQL.replace(">= 4 ", ">= 6 ")


@query(f"WITH {HISTORY_SQL}, {REASONS_SQL} SELECT node, graph_id, coalesce(lag(graph_id) OVER (PARTITION BY node ORDER BY graph_id) = graph_id - 1, false) AS attributable FROM kept")
def history_series(spark, sf_dir):
    return history.series(_history(spark, sf_dir)).select("node", "graph_id", "attributable")


@query(f"WITH {HIGHER_SQL}, {REASONS_SQL} SELECT node, graph_id, reasons FROM kept")
def history_compact(spark, sf_dir):
    """Rows kept at a threshold of 4, judged again at 6: those that 6 had kept at once."""
    return history.compact(_history(spark, sf_dir, 4.0), 6.0).select("node", "graph_id", F.col("reasons").cast("int").alias("reasons"))


def _streamed(spark, sf_dir) -> str:
    """Days of events as frames in files, streamed a file at a time in no order: the folder of the history that the stream leaves."""
    days = table(spark, sf_dir, "events").groupBy(day_number("ts").alias("graph_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    full = _frames(spark, sf_dir).select("graph_id", (F.col("frame_type") != "empty").alias("has_data"))
    records = full.join(days.withColumn("metric", F.lit("events")), "graph_id").select("graph_id", "has_data", "node", "metric", "value")
    frames, store = new_folder(spark, "frames"), new_folder(spark, "history")
    records.repartition(4, "graph_id").write.parquet(frames)
    stream = spark.readStream.schema(ingest.RECORD).option("maxFilesPerTrigger", 1).parquet(frames)
    ingest.ingest(stream, store, new_folder(spark, "offsets"), 4.0).awaitTermination()
    return store


@query(f"WITH {HISTORY_SQL}, {REASONS_SQL} SELECT node, graph_id, reasons FROM kept")
def history_stream(spark, sf_dir):
    """The history that a stream of frames leaves, whatever their order."""
    return ingest.read(spark, _streamed(spark, sf_dir)).select("node", "graph_id", "reasons")



DAYS_SQL = """
d AS (SELECT 'u' || user_id AS node, event_type AS metric, CAST(CAST(ts AS DATE) - DATE '2023-12-31' AS BIGINT) AS graph_id,
  CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3, 4)"""


def _days(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    of = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node"), F.col("event_type").alias("metric"), day_number("ts").alias("graph_id"), formats.iso_week(ts).alias("week"))
    return of.agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(f"""WITH {DAYS_SQL}, w AS (SELECT DISTINCT week, graph_id FROM d), k AS (SELECT DISTINCT node, metric, week FROM d)
SELECT k.node, k.metric, k.week, w.graph_id, d.value FROM k JOIN w USING (week) LEFT JOIN d ON d.node = k.node AND d.metric = k.metric AND d.week = k.week AND d.graph_id = w.graph_id""")
def history_dense(spark, sf_dir):
    days = _days(spark, sf_dir)
    return history.dense(days, days.select("graph_id", "week").distinct())


@query(f"""WITH {DAYS_SQL} SELECT node, metric, row_number() OVER w - 1 AS seq, graph_id - coalesce(lag(graph_id) OVER w, 0) AS frame_step, value - coalesce(lag(value) OVER w, 0) AS value_step
FROM d WINDOW w AS (PARTITION BY node, metric ORDER BY graph_id)""")
def history_encode(spark, sf_dir):
    return history.encode_series(_days(spark, sf_dir))


@query(f"WITH {DAYS_SQL} SELECT node, metric, graph_id, value FROM d")
def history_decode(spark, sf_dir):
    return history.decode_series(history.encode_series(_days(spark, sf_dir)))


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT unnest(['full', 'delta', 'empty', 'error']) AS frame_type), a AS (SELECT *, TIMESTAMP '2024-01-31' - ts AS age FROM typed)
SELECT 'events' AS timeline_id, t.frame_type, count(*) FILTER (age BETWEEN INTERVAL 0 HOUR AND INTERVAL 24 HOUR) AS h24, count(*) FILTER (age BETWEEN INTERVAL 0 HOUR AND INTERVAL 168 HOUR) AS h168, count(*) FILTER (age BETWEEN INTERVAL 0 HOUR AND INTERVAL 720 HOUR) AS h720, count(graph_id) AS every
FROM t LEFT JOIN a USING (frame_type) GROUP BY t.frame_type""")
def frame_type_counts(spark, sf_dir):
    return versions.type_counts(_frames(spark, sf_dir), "2024-01-31")


@query(f"""WITH {FRAMES_SQL}, new AS (SELECT graph_id, CASE WHEN graph_id % 5 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END AS ts FROM typed WHERE graph_id > 18),
x AS (SELECT *, coalesce(lag(ts) OVER (ORDER BY graph_id), (SELECT max(ts) FROM typed WHERE graph_id <= 20)) AS was FROM new)
SELECT graph_id FROM x WHERE graph_id <= 20 OR ts < was""")
def append_violations(spark, sf_dir):
    """Of frames to be added after the twentieth: those whose id does not rise or whose time falls."""
    every = _frames(spark, sf_dir)
    moved = F.when(F.col("graph_id") % 5 == 0, F.col("ts") - F.make_dt_interval(F.lit(3))).otherwise(F.col("ts"))
    return versions.append_violations(every.where("graph_id <= 20"), every.where("graph_id > 18").withColumn("ts", moved)).select("graph_id")


@query("""WITH known AS (SELECT 'c' || c_custkey AS external_id, c_custkey + 1 AS graph_id FROM customer WHERE c_nationkey < 10)
SELECT 'c' || c_custkey AS external_id, (SELECT max(graph_id) FROM known) + row_number() OVER (ORDER BY c_custkey) AS graph_id FROM customer WHERE c_nationkey >= 10""")
def external_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("external_id"), F.col("c_custkey").alias("ord"), "c_nationkey")
    known = rows.where("c_nationkey < 10").select("external_id", (F.col("ord") + 1).alias("graph_id"))
    return versions.add_external_ids(known, rows.select("external_id", "ord"))


@query(f"WITH {FRAMES_SQL} SELECT graph_id FROM typed WHERE ts + to_days(CASE WHEN frame_type = 'full' THEN 30 ELSE 7 END) <= TIMESTAMP '2024-01-20'")
def expired_frames(spark, sf_dir):
    """Frames that are gone by a day, where full ones are held for 30 days and others for 7."""
    ttl = F.when(F.col("frame_type") == "full", 30).otherwise(7)
    return versions.expired(_frames(spark, sf_dir).withColumn("expires_at", F.col("ts") + F.make_dt_interval(ttl)), "2024-01-20").select("graph_id")


@query("""SELECT event_id, strftime(ts + INTERVAL 1 DAY + INTERVAL 3 HOUR - INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS later, CAST(trunc(epoch_us(ts) / 1e6 - epoch(TIMESTAMP '2024-01-15')) AS BIGINT) AS seconds,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS comparable, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS unix, strftime(date_trunc('day', ts), '%Y-%m-%d') || ' 23:59:59' AS day_end FROM events""")
def date_arithmetic(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        formats.plain_datetime(formats.shifted(ts, 1, 3, -15)).alias("later"),
        formats.difference(ts, F.lit("2024-01-15").cast("timestamp_ntz")).alias("seconds"),
        formats.weekday(ts).alias("weekday"),
        formats.comparable(ts).alias("comparable"),
        formats.unix_seconds(ts).alias("unix"),
        formats.plain_datetime(formats.day_end(ts)).alias("day_end"),
    )
