"""Documents and GEXF files against a small graph written by hand, and formats against plain values."""

import glob
import json
import xml.etree.ElementTree as ET

from graphlens.functions import formats
from graphlens.sources import documents, gexf
from graphlens.sources.tables import Graph
from pyspark.sql import functions as F

DOC = {
    "nodes": {
        'a "x"': {"properties": {"team": "t<1>"}, "labels": {"kind": ["p", "q"]}, "metrics": {"size": 3.0, "cost": 1.25}, "edges_directed": ["b", "c"], "edges_tagged": {"lazy": ["b"]}},
        "b": {"edges_dynamic": {"os": {"button": {"branches": {"ios": ["c"], "web": ["d"]}, "metadata": None}}}, "metrics": None},
        "c": {},
    },
    "entry_points": ['a "x"'],
}
EDGES = {('a "x"', "b", "directed", None, None), ('a "x"', "c", "directed", None, None), ('a "x"', "b", "tagged", "lazy", None), ("b", "c", "dynamic", None, "ios"), ("b", "d", "dynamic", None, "web")}


def edges(g):
    return {(r.src, r.dst, r.kind, r.tag, r.branch) for r in g.edges.collect()}


def parts(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


def read(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOC))
    return documents.read_document(spark, f"file://{tmp_path}/d.json")


def test_document_is_read_and_written(spark, tmp_path):
    g, entries = read(spark, tmp_path)
    assert edges(g) == EDGES and [r.node for r in entries.collect()] == ['a "x"']
    assert {r.node for r in g.nodes.collect()} == {'a "x"', "b", "c", "d"}
    documents.write_document(g, f"file://{tmp_path}/out", ['a "x"'])
    back = json.loads(parts(tmp_path / "out"))
    assert back["nodes"]['a "x"'] == DOC["nodes"]['a "x"'] and back["entry_points"] == DOC["entry_points"] and back["nodes"]["d"] == {}
    assert back["nodes"]["b"]["edges_dynamic"]["os"]["button"]["branches"] == {"ios": ["c"], "web": ["d"]}
    documents.write_lines(g, f"file://{tmp_path}/lines")
    assert edges(documents.read_lines(spark, f"file://{tmp_path}/lines")) == EDGES


def test_gexf_is_well_formed(spark, tmp_path):
    g, _ = read(spark, tmp_path)
    gexf.write(g, f"file://{tmp_path}/g")
    root, ns = ET.fromstring(parts(tmp_path / "g").encode()), "{http://gexf.net/1.3}"
    assert [(n.get("id"), n.get("label")) for n in root.iter(f"{ns}node")] == [("0", 'a "x"'), ("1", "b"), ("2", "c"), ("3", "d")]
    assert [(e.get("source"), e.get("target"), e.get("label")) for e in root.iter(f"{ns}edge")] == [("0", "1", None), ("0", "2", None), ("0", "1", "lazy"), ("1", "2", "os:button:ios"), ("1", "3", "os:button:web")]
    assert [(a.get("for"), a.get("value")) for a in root.iter(f"{ns}attvalue")] == [("0", "1.25"), ("1", "3"), ("2", "p,q"), ("3", "t<1>")]


def test_formats(spark):
    v = spark.createDataFrame([(0.5,), (1234567.891,), (-2.5,), (999.0,), (None,)], "v double")
    got = v.select(formats.number(F.col("v")), formats.number(F.col("v"), 0, 0), formats.size(F.col("v")), formats.percent(F.col("v"), True)).collect()
    assert [tuple(r) for r in got] == [
        ("0.5", "1", "1 bytes", "50%"),
        ("1,234,567.89", "1,234,568", "1.23 MB", "123,456,789.1%"),
        ("-2.5", "-3", "-3 bytes", "-250%"),
        ("999", "999", "999 bytes", "99,900%"),
        (None, None, None, None),
    ]


def test_gexf_in_many_files_is_the_same_document(spark, tmp_path, monkeypatch):
    names = [f"n{k}" for k in range(9)]
    nodes = spark.createDataFrame([(n, {"p": n}, {}) for n in names], "node string, props map<string,string>, labels map<string,array<string>>")
    metrics = spark.createDataFrame([(n, "w", 1.5) for n in names], "node string, metric string, value double")
    links = [(a, b, "directed", None, None, None, None) for a in names for b in names[:4]]
    g = Graph(nodes, metrics, spark.createDataFrame(links, "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string"))
    texts = []
    for most in (1000, 4):
        monkeypatch.setattr(gexf, "LINES", most)
        gexf.write(g, f"file://{tmp_path}/{most}")
        texts.append(parts(tmp_path / str(most)))
    assert texts[0] == texts[1] and texts[0].count("<edge id=") == len(links) and len(list((tmp_path / "4").glob("part-*"))) == 1 + 3 + 9
    assert [line.split('"')[1] for line in texts[0].splitlines() if line.startswith("<edge ")] == [str(k) for k in range(len(links))]
