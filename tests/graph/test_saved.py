import json
import random

import pytest
from pyspark.sql import functions as F

from graphlens.operators.json_diff import changes_of, json_changes
from graphlens.sources import configs
from graphlens.sources.arrays import from_documents, read_any
from graphlens.sources.configs import ConfigStore, GraphQuery, resolve, settled

ARRAYS = {
    "node_names_ordered": {"node_names": "aßbc", "offsets": [0, 3, 4, 5]},
    "edges": {
        "edges": [1, 2, 2, 0],
        "edge_offsets": [0, 3, 3, 4],
        "edge_metadata": [{"Tagged": {"tag": "t"}}, {"Dynamic": {"type_key": "k", "edge_name": "n", "branch": "on", "metadata": {"x": "y"}}}],
        "edge_metadata_map": {"2": 0, "3": 1},
    },
    "node_metadata": {"metrics": {"size": [1.5, 0.0, 2.0]}, "labels": {"l": {"1": ["v", "w"]}}, "properties": {"p": {"2": "q"}}},
    "graph_settings": None,
    "traversal_config": None,
    "entry_points": ["aß"],
}


def test_array_form(spark):
    g, entry = from_documents(spark.createDataFrame([(json.dumps(ARRAYS, ensure_ascii=False),)], "value string"))
    rows = {(e.src, e.dst, e.kind, e.tag, e.type_key, e.edge_name, e.branch, e.metadata) for e in g.edges.collect()}
    assert rows == {
        ("aß", "b", "directed", None, None, None, None, None),
        ("aß", "c", "directed", None, None, None, None, None),
        ("aß", "c", "tagged", "t", None, None, None, None),
        ("c", "aß", "dynamic", None, "k", "n", "on", '{"x":"y"}'),
    }
    assert {(m.node, m.metric, m.value) for m in g.node_metrics.collect()} == {("aß", "size", 1.5), ("c", "size", 2.0)}
    assert {(n.node, tuple(n.labels.get("l", ())), n.props.get("p")) for n in g.nodes.collect()} == {("aß", (), None), ("b", ("v", "w"), None), ("c", (), "q")}
    assert [r.node for r in entry.collect()] == ["aß"]


def test_files_of_both_forms_and_of_none(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ARRAYS, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"nodes": {"d": {"edges_directed": ["b"]}}}))
    g, _ = read_any(spark, str(tmp_path))
    assert g.nodes.count() == 4 and g.edges.where("src = 'd'").count() == 1
    with pytest.raises(Exception, match="neither form"):
        from_documents(spark.createDataFrame([("{}",)], "value string"))[0].nodes.collect()


def common(a: list, b: list) -> int:
    """The length of a longest common subsequence, by one row at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def test_arrays_lose_and_gain_as_little_as_can_be():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        tones = [tone for _, tone, *_ in changes_of(a, b)]
        assert tones.count("removed") == len(a) - common(a, b) and tones.count("added") == len(b) - common(a, b)
        # beyond the bound equal ends still stand side by side, and what is between them is compared place by place
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        tones = [tone for _, tone, *_ in changes_of([*a, 9], [*b, 9], cells=-1)]
        assert tones.count("changed") == sum(x != y for x, y in zip(a, b)) and len(tones) == tones.count("changed") + abs(len(a) - len(b))


def test_json_changes(spark):
    pairs = [
        (1, '{"b":[1,{"c":2}],"a":1}', '{"a":1.0,"b":[1,{"c":3}]}'),
        (2, '{"x":{"y":[1,2]}}', '{"x":7}'),
        (3, None, "[1,{}]"),
        (4, None, None),
        (5, "null", "null"),
    ]
    got = json_changes(spark.createDataFrame(pairs, "id long, l string, r string"), "id", "l", "r").orderBy("id", "place").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, '$["b"][1]', "removed", '{"c": 2}', None, 3),
        (1, 1, '$["b"][1]', "added", None, '{"c": 3}', 3),
        (2, 0, '$["x"]', "removed", '{"y": [1, 2]}', None, 6),
        (2, 1, '$["x"]', "added", None, "7", 1),
        (3, 0, "$", "added", None, "[1, {}]", 5),
    ]


def test_configs(spark, tmp_path):
    store = ConfigStore(spark, f"file://{tmp_path}/configs")
    doc = {"force_nodes": {"c": {"include": False}}}
    key, other = store.put_one(doc), store.put_query("line", ["b", "a"], doc)
    assert key.startswith("tvc_") and len(key) == 20 and store.put_one(doc) == key and store.rows.count() == 2
    assert settled(store, GraphQuery(other)) == GraphQuery("line", ("a", "b"), doc)
    assert settled(store, GraphQuery(other, ("x",), {})) == GraphQuery("line", ("x",), {})
    assert settled(store, GraphQuery("line~3", None, key)) == GraphQuery("line~3", None, doc)
    with pytest.raises(ValueError, match="no configuration"):
        store.get("tvc_0")
    with pytest.raises(ValueError, match="another saved query"):
        settled(store, GraphQuery(store.put_query(other)))


def test_texts_that_share_a_key(spark, tmp_path, monkeypatch):
    store = ConfigStore(spark, f"file://{tmp_path}/configs")
    store.put_one({"a": 1})
    monkeypatch.setattr(configs, "content_key", lambda prefix, text: F.concat(F.lit(prefix), F.lit("0" * 16)))
    store.put_one({"b": 1})
    assert store.put_one({"b": 1}) == "tvc_" + "0" * 16
    with pytest.raises(ValueError, match="share the key"):
        store.put_one({"b": 2})


def test_resolved_graph(spark, tmp_path):
    g, _ = from_documents(spark.createDataFrame([(json.dumps({"nodes": {"a": {"edges_directed": ["b"]}, "b": {"edges_directed": ["c"]}, "z": {"edges_directed": ["a"]}}}),)], "value string"))
    store, asked = ConfigStore(spark, f"file://{tmp_path}/configs"), []

    def graph_of(timeline, frame):
        asked.append((timeline, frame))
        return g, {"force_nodes": {"c": {"include": False}}}

    reached = lambda query, **more: {r.node for r in resolve(store, query, graph_of, **more).state.where("reachable").collect()}
    assert reached(GraphQuery("line~7")) == {"a", "b", "z"}
    assert reached(GraphQuery("line", ("a", "none"), {})) == {"a", "b", "c"}
    assert reached(GraphQuery("line", ()), super_root=True) == {"~root~", "a", "b", "z"}
    assert asked == [("line", 7), ("line", None), ("line", None)]
