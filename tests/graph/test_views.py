"""Names, arrows, tiers of what is dominated, configurations with many names, edges in changes, frames before a point, defaults of comparisons."""

import datetime

import pytest
from graphlens.operators import deltas, explore, traverse, versions
from graphlens.operators.rules import LITERALS, apply_rules
from graphlens.operators.selection import NodeSelection, select_nodes
from graphlens.plans.config import MetricView, TraversalConfig
from graphlens.sources import documents, export
from graphlens.sources.tables import Graph
from pyspark.sql import functions as F

EDGE = "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string, metadata string, edge_ord long"
LINKS = [("r", "a", None), ("r", "b", "late"), ("a", "c", None), ("b", "c", None), ("b", "d", None), ("d", "e", "late"), ("a", "f", None)]


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame([(x, y, "tagged" if t else "directed", t, None, None, None, None, k) for k, (x, y, t) in enumerate(LINKS)], EDGE)
    names = sorted({n for x, y, _ in LINKS for n in (x, y)})
    nodes = spark.createDataFrame([(n, {}, {}) for n in names], "node string, props map<string,string>, labels map<string,array<string>>")
    return Graph(nodes, spark.createDataFrame([(n, "w", float(k + 1)) for k, n in enumerate(names)], "node string, metric string, value double"), edges)


def prepared(spark, g, **more):
    config = TraversalConfig(tiers=(("first", (), ()), ("later", ("late",), ())), **more)
    return traverse.prepare(g.nodes, g.node_metrics, g.edges, config, spark.createDataFrame([("r",)], "node string"))


def test_arrows_and_dominated_tiers(spark, graph):
    p = prepared(spark, graph)
    assert {(r.node, r.ord, r.tag) for r in explore.arrows(p, "r").collect()} == {("a", 0, None), ("b", 1, "late")}
    assert {r.node for r in explore.arrows(p, "c", "reverse").collect()} == {"a", "b"}
    assert {r.node for r in explore.arrows(p, "r", "dominator").collect()} == {"a", "b", "c"}
    assert {r.node for r in explore.arrows(p, "b", "dominator").collect()} == {"d"}
    # a 1, b 2, c 3, d 4, e 5, f 6, r 7; the first tier has r, a, c, f
    rows = p.state.select("node")
    of = lambda view: {r.node: r.value for r in explore.view_values(p, rows, MetricView.parse(view)).collect()}
    assert of("w#first~dominated") == {"r": 17.0, "a": 7.0, "b": 0.0, "c": 3.0, "d": 0.0, "e": 0.0, "f": 6.0}
    assert of("w#later~dominated") == {"r": 28.0, "a": 7.0, "b": 11.0, "c": 3.0, "d": 9.0, "e": 5.0, "f": 6.0}
    assert of("w~dominated") == of("w#later~dominated") and of("node-count~dominated") == {"r": 7.0, "a": 2.0, "b": 3.0, "c": 1.0, "d": 2.0, "e": 1.0, "f": 1.0}


def test_names_and_either_side(spark, graph):
    assert [r.node for r in select_nodes(graph.nodes, NodeSelection(name="b")).collect()] == ["b"] and select_nodes(graph.nodes, NodeSelection(name="B")).isEmpty()
    left, right = prepared(spark, graph), prepared(spark, graph, force_nodes={"b": False})
    page = explore.explore_delta(left, right, NodeSelection(regex="^[bcd]$"), sort="name", descending=False).rows
    assert [r.node for r in page.collect()] == ["b", "c", "d"]
    assert [str(c) for c in explore.default_columns([MetricView("w"), MetricView("", "tier")])] == ["w", "w@delta", "tier"]


def test_configurations_with_many_names(spark, graph):
    few = {"b": False, "c": True, "x0": False}
    many = few | {f"x{k}": k % 2 == 0 for k in range(1, LITERALS + 50)}
    pair = {("a", "f"): False}
    judge = lambda **c: sorted((r.src, r.dst, r.excluded, r.rule) for r in apply_rules(graph.edges, graph.nodes, TraversalConfig(**c)).select("src", "dst", "excluded", "rule").collect())
    assert judge(force_nodes=few, force_edges=pair) == judge(force_nodes=many, force_edges=pair)


def test_edges_in_changes(spark, graph):
    later = Graph(graph.nodes, graph.node_metrics, graph.edges.where("dst <> 'f'").unionByName(graph.edges.where("dst = 'e'").withColumn("tag", F.lit("other"))))
    changes = deltas.derive(graph, later)
    assert sorted((r.op, r.src, r.dst, r.tag) for r in changes["edges"].select("op", "src", "dst", "tag").collect()) == [("add", "d", "e", "other"), ("remove", "a", "f", deltas.NONE)]
    back = deltas.apply(graph, changes)
    key = lambda g: sorted((r.src, r.dst, r.tag or "") for r in g.edges.select("src", "dst", "tag").collect())
    assert key(back) == key(later)


def test_the_frame_before_a_point(spark):
    at = [datetime.datetime(2024, 1, d) for d in (1, 1, 2, 5)]
    frames = spark.createDataFrame([("t", k, "full", t) for k, t in enumerate(at)], "timeline_id string, graph_id long, frame_type string, ts timestamp_ntz")
    before = lambda ts, k: [r.graph_id for r in versions.select_frames(frames, "t", before=(ts, k)).collect()]
    assert before(at[1], 1) == [0] and before(at[3], 3) == [2] and before(at[0], 0) == [] and before(datetime.datetime(2024, 2, 1), 0) == [3]


def test_exports(spark, graph, tmp_path):
    p = prepared(spark, Graph(graph.nodes.where("node <> 'f'"), graph.node_metrics, graph.edges), force_nodes={"b": False})
    for scope, count in (("Whole", 7), ("Reachable", 4)):
        export.export(p, scope, "MapGraphJson", f"file://{tmp_path}/{scope}")
        text = "".join(f.read_text() for f in sorted((tmp_path / scope).glob("part-*")))
        (tmp_path / f"{scope}.json").write_text(text)
        g, entry = documents.read_document(spark, f"file://{tmp_path}/{scope}.json")
        assert g.nodes.count() == count and [r.node for r in entry.collect()] == ["r"]
        want = LINKS if scope == "Whole" else [e for e in LINKS if e[0] in "ra" and e[1] != "b"]
        assert sorted((r.src, r.dst, r.tag or "") for r in g.edges.collect()) == sorted((x, y, t or "") for x, y, t in want)
        export.export(p, scope, "Gephi", f"file://{tmp_path}/{scope}-gexf")
        lines = "".join(f.read_text() for f in sorted((tmp_path / f"{scope}-gexf").glob("part-*")))
        assert lines.count("<node id=") == count and lines.count("<edge id=") == len(want) and lines.endswith("</gexf>\n")
    for bad in (("All", "Gephi"), ("Whole", "Dot")):
        with pytest.raises(ValueError, match="unknown export"):
            export.export(p, *bad, f"file://{tmp_path}/no")


def test_counts_by_windows_include_both_ends_and_parts_of_seconds(spark):
    times = ["2024-01-29 23:59:59.7", "2024-01-30 00:00:00", "2024-01-30 00:00:00.3", "2024-01-31 00:00:00", "2024-01-31 00:00:00.3", "2024-01-31 00:30:00"]
    frames = spark.createDataFrame([("a", k, t) for k, t in enumerate(times)], "timeline_id string, graph_id long, ts string")
    frames = frames.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("frame_type", F.lit("full"))
    got = {r.frame_type: r for r in versions.type_counts(frames, "2024-01-31").collect()}
    assert (got["full"].h24, got["full"].h168, got["full"].h720, got["full"].every) == (3, 4, 4, 6) and got["error"].every == 0
