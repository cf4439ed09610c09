"""Messages that entries of a configuration name."""

import pytest
from graphlens.operators import messages
from graphlens.operators.rules import apply_rules
from graphlens.plans.config import TraversalConfig

DOC = {
    "force_nodes": {"b": {"include": False, "message_id": "node"}, "c": {"include": False}},
    "force_edges": {"a": {"d": {"include": True, "message_id": "edge"}, "e": {"include": False, "message_id": "nowhere"}}},
    "force_tagged": {"t": {"include": False, "message_id": "forced_children_of_excluded"}},
    "force_dynamic": {"k": {"overrides": {"n": {"branches": {"Exclude": ["x"]}, "decision": {"include": True, "message_id": "edge"}}, "m": {"decision": {"include": False, "message_id": "own"}}}}},
    "label_predicates": {
        "1": {"label_name": "l", "label_value": "v", "contains": True, "decision": {"include": False, "message_id": "own"}},
        "2": {"label_name": "l", "label_value": "w", "contains": True, "decision": {"include": False}},
    },
    "messages": {"node": "no %points_to%", "edge": "%points_from% to %points_to%", "own": "%edge_branch%", "force_labels_excluded": "by label"},
}
EDGES = [
    ("a", "b", "directed", None, None, None, None),
    ("a", "c", "directed", None, None, None, None),
    ("a", "d", "directed", None, None, None, None),
    ("a", "e", "directed", None, None, None, None),
    ("a", "f", "tagged", "t", None, None, None),
    ("a", "g", "dynamic", None, "k", "n", "x"),
    ("a", "g", "dynamic", None, "k", "n", "y"),
    ("a", "g", "dynamic", None, "k", "n", None),
    ("a", "g", "dynamic", None, "k", "m", "z"),
    ("a", "v", "directed", None, None, None, None),
    ("a", "w", "directed", None, None, None, None),
    ("a", "h", "directed", None, None, None, None),
]


@pytest.mark.parametrize("literals", [200, 0])
def test_entries_name_their_messages(spark, monkeypatch, literals):
    """The same by literal conditions and by joins; a null branch is in no list; ids that are not known fall back."""
    monkeypatch.setattr(messages, "LITERALS", literals)
    edges = spark.createDataFrame(EDGES, "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string")
    nodes = spark.createDataFrame([("v", {"l": ["v"]}), ("w", {"l": ["v", "w"]}), ("h", None)], "node string, labels map<string,array<string>>")
    config = TraversalConfig.from_json(DOC)
    judged = apply_rules(edges, nodes, config)
    got = messages.with_messages(judged, nodes, config)
    assert got.columns == [*judged.columns, "message_id", "message"]
    said = {(r.dst, r.edge_name, r.branch): (r.message_id, r.message) for r in got.collect()}
    children = "This edge was EXCLUDED because the node `f` is a child of a node whose children were excluded from the traversal using `force_children_of` config."
    assert said.pop(("f", None, None)) == ("forced_children_of_excluded", children)
    assert said.pop(("c", None, None))[0] == "node_force_excluded" and said.pop(("e", None, None))[0] == "edge_force_excluded"
    assert said.pop(("g", "n", "x"))[0] == "force_dynamic_excluded"
    assert said == {
        ("b", None, None): ("node", "no b"),
        ("d", None, None): ("edge", "a to d"),
        ("g", "n", "y"): ("edge", "a to g"),
        ("g", "n", None): ("edge", "a to g"),
        ("g", "m", "z"): ("own", "z"),
        ("v", None, None): ("own", "%edge_branch%"),
        ("w", None, None): ("force_labels_excluded", "by label"),
        ("h", None, None): (None, None),
    }


def test_empty_tables_and_no_entries(spark):
    edges = spark.createDataFrame([], "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string")
    nodes = spark.createDataFrame([], "node string, labels map<string,array<string>>")
    for config in (TraversalConfig(), TraversalConfig.from_json(DOC)):
        assert messages.with_messages(apply_rules(edges, nodes, config), nodes, config).collect() == []
