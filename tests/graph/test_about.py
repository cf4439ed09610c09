"""Handles, long texts and search on small graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphlens.functions import formats
from graphlens.operators import about
from graphlens.operators.selection import NodeSelection
from graphlens.sources.documents import from_specs
from graphlens.sources.documents import SPEC_TYPE
from graphlens.streaming import ingest


def cut(text: str, most: int) -> str:
    data = text.encode()
    if len(data) <= most:
        return text
    half = most // 2
    start, end = data[:half].decode(errors="ignore"), data[len(data) - half :]
    while end and 128 <= end[0] < 192:
        end = end[1:]
    return start + formats.CUT[0] + str(len(data)) + formats.CUT[1] + end.decode()


def test_truncated(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab é€😀\n") for _ in range(rnd.randrange(0, 40))) for _ in range(200)] + ["", "x" * 20, "x" * 21]
    for most in (20, 21, 1):
        rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", formats.truncated("t", most).alias("s")).collect()
        assert all(r.s == (None if r.t is None else cut(r.t, most)) for r in rows)


def test_handles(spark):
    given = ["gqc_0a", "npm~12", "a~b~-3", "plain", None]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(formats.handle(F.col("t")).alias("h")).collect()
    assert [tuple(r.h) if r.h else None for r in rows] == [("query", None, None, "gqc_0a"), ("frame", "npm", 12, None), ("frame", "a~b", -3, None), ("timeline", "plain", None, None), None]
    for bad in ("", "npm~", "~4", "npm~x"):
        with pytest.raises(Exception, match="not a handle"):
            spark.createDataFrame([(bad,)], "t string").select(formats.handle(F.col("t")).alias("h")).collect()


def test_search_returns_documents_of_the_first_names(spark):
    spec = lambda **kw: {"properties": None, "labels": None, "metrics": None, "edges_directed": None, "edges_tagged": None, "edges_dynamic": None} | kw
    rows = [("b1", spec(edges_directed=["a1", "c"])), ("a1", spec(metrics={"size": 2.0})), ("b2", spec(properties={"k": "v"})), ("x", spec())]
    g = from_specs(spark.createDataFrame(rows, f"node string, spec {SPEC_TYPE}"))
    found = {r.node: r.spec for r in about.search(g, NodeSelection(regex="^[abc]"), 3).collect()}
    assert set(found) == {"a1", "b1", "b2"}
    assert found["b1"].edges_directed == ["a1", "c"] and found["a1"].metrics == {"size": 2.0} and found["b2"].properties == {"k": "v"}
    assert {r.node for r in about.search(g, NodeSelection(), 2).collect()} == {"a1", "b1"}
    views = {r.metric: r.views for r in about.metric_views(g.node_metrics, [], dominated=False).collect()}
    assert views == {"size": ["size", "size~transitive"], None: ["parents-count", "node-count~transitive"]}


def test_deleted_rows_stay_away(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    rows = [(g, True, n, "m", float(g * k)) for g in (1, 2, 3, 5) for k, n in ((7, "a"), (9, "b"))] + [(4, False, None, None, None)]
    ingest.fold(spark.createDataFrame(rows, ingest.RECORD), store, 1.0)
    before = {(r.node, r.graph_id) for r in ingest.read(spark, store).collect()}
    assert ingest.delete(spark, store, 2, 3, "a") == sum(n == "a" and g in (2, 3) for n, g in before)
    assert ingest.delete(spark, store, 5) == sum(g >= 5 for _, g in before)
    assert ingest.delete(spark, store, 5) == 0
    assert {(r.node, r.graph_id) for r in ingest.read(spark, store).collect()} == {(n, g) for n, g in before if g < 5 and not (n == "a" and g in (2, 3))}
