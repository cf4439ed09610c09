"""Loops on small random graphs against brute force, and histories that arrive out of order."""

import itertools
import random

import pytest
from graphlens.operators import dominators as tree_of
from graphlens.operators import fixpoint, history, metrics, paths, reached, scc, traverse, twin
from graphlens.plans.config import MetricView, TraversalConfig
from graphlens.streaming import ingest
from pyspark.sql import functions as F


def closure(nodes, links, without=None):
    out = {n: {n} for n in nodes if n != without}
    for n in out:
        todo = [n]
        while todo:
            x = todo.pop()
            for a, b in links:
                if a == x and b != without and b not in out[n]:
                    out[n].add(b)
                    todo.append(b)
    return out


@pytest.fixture(scope="module", params=[1, 2])
def graph(spark, request):
    rng = random.Random(request.param)
    nodes = [f"n{k:02d}" for k in range(14)]
    links = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(20)})
    links = [(a, b) for a, b in links if a != b]
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(links)], "src string, dst string, edge_ord long")
    return nodes, links, spark.createDataFrame([(n,) for n in nodes], "node string"), edges


def test_components(graph):
    nodes, links, n, e = graph
    reach = closure(nodes, links)
    want = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    assert {r.node: r.scc for r in scc.components(n, e).collect()} == want


def test_components_of_long_ways(spark, monkeypatch):
    """A way of 200 nodes with loops, rings beside it: rounds by digits of its length, not by its nodes."""
    writes = []
    monkeypatch.setattr(scc, "saved", lambda df: writes.append(1) or fixpoint.saved(df))
    nodes = [f"n{(k * 77) % 200:03d}" for k in range(200)]
    ring = [f"r{k}" for k in range(9)]
    links = [*zip(nodes, nodes[1:]), *[(nodes[k + 7], nodes[k]) for k in range(20, 180, 40)], (nodes[70], nodes[65]), *zip(ring, ring[1:] + ring[:1]), ("x", "y"), ("y", "x")]
    every = sorted({n for e in links for n in e} | {"alone"})
    reach = closure(every, links)
    got = scc.components(spark.createDataFrame([(n,) for n in every], "node string"), spark.createDataFrame(links, "src string, dst string"))
    assert {r.node: r.scc for r in got.collect()} == {a: min(b for b in reach[a] if a in reach[b]) for a in every}
    assert len(writes) < 80


def dominators(links, root):
    """Immediate dominators by iteration over a search order."""
    live = sorted(closure({root} | {x for e in links for x in e}, links)[root])
    dom = {n: set(live) for n in live} | {root: {root}}
    into = {n: [a for a, b in links if b == n and a in dom] for n in live}
    moved = True
    while moved:
        moved = False
        for n in live:
            if n != root:
                new = {n} | set.intersection(*(dom[a] for a in into[n]))
                moved, dom[n] = moved or new != dom[n], new
    return {n: max(dom[n] - {n}, key=lambda x: len(dom[x]), default=None) for n in live}


@pytest.mark.parametrize("seed,shallow", [(1, 32), (3, 32), (1, 1)])
def test_dominator_tree(spark, seed, shallow, monkeypatch):
    """By the ways of shallow trees and by jumps alone."""
    monkeypatch.setattr(tree_of, "SHALLOW", shallow)
    rng = random.Random(seed)
    size, n = [(14, 20), (14, 24), (30, 34), (30, 60), (60, 90), (12, 40)][seed]
    links = sorted({(f"n{rng.randrange(size)}", f"n{rng.randrange(size)}") for _ in range(n)})
    root = links[0][0]
    edges = spark.createDataFrame(links, "src string, dst string")
    tree = tree_of.dominator_tree(edges, spark.createDataFrame([(root,)], "node string"))
    assert {r.node: r.idom for r in tree.collect()} == dominators(links, root)
    up = dominators(links, root)
    table = tree_of.jump_table(tree)
    jumps = {r.node: (r.depth, r.jump) for r in table.collect()}

    def chain(x):
        return [x, *chain(up[x])] if x else []

    assert jumps == {x: (len(chain(x)) - 1, [chain(x)[1 << k] for k in range(8) if 1 << k < len(chain(x))]) for x in up}
    held = max(len(chain(x)) for x in up) <= shallow
    assert {r.node: r.way for r in table.collect()} == {x: chain(x)[::-1] if held else None for x in up}
    sums = tree_of.subtree_sums(table, tree.select("node", F.lit(1).alias("n"), F.length("node").alias("v")))
    assert {r.node: (r.n, r.v) for r in sums.collect()} == {x: (len(b := [y for y in up if x in chain(y)]), sum(map(len, b))) for x in up}


def test_dominators_of_a_long_path_with_side_steps(spark):
    n = 2000
    links = [(f"v{k}", f"v{k + 1}") for k in range(n)] + [(f"v{k}", f"w{k}") for k in range(0, n, 50)] + [(f"w{k}", f"v{k + 30}") for k in range(0, n - 30, 50)] + [(f"v{k + 7}", f"v{k}") for k in range(0, n - 7, 90)]
    tree = tree_of.dominator_tree(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([("v0",)], "node string"))
    want = {f"v{k + 1}": f"v{k}" for k in range(n)} | {f"w{k}": f"v{k}" for k in range(0, n, 50)} | {f"v{k + 30}": f"v{k}" for k in range(0, n - 30, 50)} | {"v0": None}
    assert {r.node: r.idom for r in tree.collect()} == want


@pytest.mark.parametrize("seed", [0, 2])
def test_sums_over_what_all_reach(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(reached, "ROWS", 3)
    nodes = [f"n{k}" for k in range(40)]
    links = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range([30, 45, 70][seed])})
    value = {x: rng.randrange(9) / 2 for x in nodes[:30]}
    got = reached.reached_sums(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(list(value.items()), "node string, v double"))
    assert {r.node: (r["count"], r.v) for r in got.collect()} == {x: (len(s), sum(value.get(y, 0) for y in s)) for x, s in closure(nodes, links).items()}


def test_bitmaps_of_several_runs(spark):
    n = 70_000
    links = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("src"), F.concat(F.lit("x"), F.col("id")).alias("dst")).union(spark.sql("SELECT 'r', 'a' UNION ALL SELECT 'r', 'b' UNION ALL SELECT 'x5', 'x6'"))
    nodes = links.select("dst").union(spark.sql("SELECT 'r'")).toDF("node")
    got = {r.node: (r["count"], r.v) for r in reached.reached_sums(nodes, links, nodes.select("node", F.lit(2.0).alias("v"))).where("length(node) = 1 OR node = 'x5'").collect()}
    assert got == {"r": (n + 3, 2.0 * (n + 3)), "a": (23_335, 46_670.0), "b": (46_668, 93_336.0), "x5": (2, 4.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_roots_are_summed_without_pairs(spark, seed, monkeypatch):
    """Lists and bitmaps give the same sums, with and without loops, however small lists, groups and parts are; pairs are not walked."""
    for name, size in (("ROWS", 3), ("LISTED", 12), ("GROUP", 10), ("LARGE", 20)):
        monkeypatch.setattr(reached, name, size, raising=False)
    monkeypatch.setattr(metrics, "FEW", 3, raising=False)
    monkeypatch.setattr(metrics, "reach", lambda *_: pytest.fail("pairs were walked"))
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(40)]
    links = {(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range([90, 60][seed - 1])) if a < b or seed == 2} | {("n00", x) for x in nodes[1:9]}
    tiers = (("now", (), ()), ("late", ("t",), ()))
    rows = [(a, b, "tagged", "t" if (a + b).count("3") else "u", None, None, None, None, None) for a, b in sorted(links)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string, metadata string, edge_ord long")
    value = {x: float(rng.randrange(-2, 5)) for x in nodes[:30]}
    held = spark.createDataFrame([(x, "v", v) for x, v in value.items()], "node string, metric string, value double")
    every = spark.createDataFrame([(x, None, None) for x in nodes], "node string, props map<string,string>, labels map<string,array<string>>")
    p = traverse.prepare(every, held, edges, TraversalConfig(tiers=tiers), spark.createDataFrame([("n00",)], "node string"), rows=len(rows), held="pairs")
    whole, tier = closure(nodes, sorted(links)), {r.node: r.tier for r in p.reached.collect()}
    ask = spark.createDataFrame([(x,) for x in nodes], "node string")
    want = {x: (len(whole[x]), sum(value.get(y, 0) for y in whole[x])) if x in tier else (0, 0) for x in nodes}
    assert {r.node: (r["count"], r["sum"]) for r in metrics.transitive(p, ask, "v").collect()} == want
    sums = {(x, k): sum(value.get(y, 0) for y in whole[x] if tier[y] <= k) for x in tier for k in (0, 1)}
    assert {(r.root, r.tier): r["sum"] for r in metrics.tiered_of(p, ask, "v").collect()} == {k: v for k, v in sums.items() if v > 0}


def test_shortest_path_depths(graph, spark):
    nodes, links, _, e = graph
    want, level, depth = {}, {nodes[0]}, 0
    while level:
        want |= dict.fromkeys(level, depth)
        level, depth = {b for a, b in links if a in level and b not in want}, depth + 1
    got = paths.shortest_paths(e, spark.createDataFrame([(nodes[0],)], "node string"))
    assert {r.node: r.depth for r in got.select("node", "depth").collect()} == want


def test_edge_classes(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string, edge_ord long, excluded boolean")
    state = lambda names: spark.createDataFrame([(n, True) for n in names], "node string, reachable boolean")
    left = edges([("a", "b", 1, False), ("a", "c", 2, True), ("a", "d", 3, False), ("a", "e", 4, True), ("a", "g", 5, False), ("a", "h", 6, True)])
    right = edges([("a", "b", 1, True), ("a", "c", 2, False), ("a", "e", 3, True), ("a", "f", 4, False), ("a", "g", 5, False), ("a", "g", 6, True), ("a", "i", 7, True)])
    got = {(r.dst, r.position): r.change for r in twin.edge_classes(left, right, state("bcdegh"), state("bcefghi")).collect()}
    assert got == {
        ("b", 1): "edge_became_excluded",
        ("c", 1): "edge_became_included",
        ("d", 1): "node_became_unreachable",
        ("e", 1): "no_change",
        ("f", 1): "node_became_reachable",
        ("g", 1): "no_change",
        ("g", 2): "excluded_edge_was_added",
        ("h", 1): "excluded_edge_was_removed",
        ("i", 1): "node_became_reachable",
    }
    alone = {r.dst: r.change for r in twin.edge_classes_alone(left, state("bcde")).collect()}
    assert alone == {"b": "no_change", "c": "single_graph_edge_excluded", "d": "no_change", "e": "single_graph_edge_excluded", "g": "single_graph_unreachable", "h": "single_graph_unreachable"}


def test_config_diff(spark):
    rows = lambda r: spark.createDataFrame(r, "section string, key string, value string")
    got = twin.config_diff(rows([("nodes", "a", "1"), ("tags", "t", "1"), ("tags", "u", "1")]), rows([("nodes", "b", "1"), ("tags", "t", "0"), ("tags", "u", "1")]))
    assert {(r.section, r.key, r.change) for r in got.collect()} == {("nodes", "a", "removed"), ("nodes", "b", "added"), ("tags", "t", "changed")}


def series(seed):
    """Values of one node over frames from 1 on, one of which is a gap; none is 0, which would mean that the node is absent."""
    rng = random.Random(seed)
    last, gap = 14, rng.randrange(4, 11)
    return last, gap, {k: float(1 + rng.randrange(12)) for k in range(1, last + 1) if k != gap}


def judged(last, gap, values, threshold):
    """{frame: reasons} of the rows that are kept: first 1, over the threshold 2, before such a row 4, newest 8; 0 beside the gap."""
    over = {k for k in values if k - 1 in values and abs(values[k] - values[k - 1]) >= threshold}
    of = {k: (1 if k == 1 else 0) + 2 * (k in over) + 4 * (k + 1 in over) + 8 * (k == last) for k in values}
    return {k: r for k, r in of.items() if r or gap in (k - 1, k + 1)}


@pytest.mark.parametrize("seed", [3, 4])
def test_history_of_one_node(spark, seed):
    last, gap, values = series(seed)
    frames = spark.createDataFrame([(k, k != gap) for k in range(1, last + 1)], "graph_id long, has_data boolean")
    rows = spark.createDataFrame([(k, "a", "m", v) for k, v in values.items()], "graph_id long, node string, metric string, value double")
    kept = history.judge(frames, rows, 5.0)
    want = judged(last, gap, values, 5.0)
    assert {r.graph_id: r.reasons for r in kept.collect()} == want
    assert {r.graph_id for r in history.series(kept).where("attributable").collect()} == {k for k in want if k - 1 in want}
    assert {r.graph_id: r.reasons for r in history.compact(kept, 8.0).collect()} == judged(last, gap, values, 8.0)


def test_stream_in_any_order_and_again(spark, tmp_path):
    last, gap, values = series(5)
    record = lambda k: (k, k != gap, "a" if k != gap else None, "m", values.get(k))
    store = f"file://{tmp_path}/store"
    order = random.Random(6).sample(range(1, last + 1), last)
    for part in (order[:4], order[4:6], order[6:10], order[10:], order[3:6]):
        ingest.fold(spark.createDataFrame([record(k) for k in part], ingest.RECORD), store, 5.0)
    assert {r.graph_id: r.reasons for r in ingest.read(spark, store).collect()} == judged(last, gap, values, 5.0)


def test_views_are_written_and_read():
    for text, want in (("size", ("size", "self", None)), ("size~transitive", ("size", "transitive", None)), ("size#T1", ("size", "tiered", "T1")), ("size~T1", ("size", "tiered", "T1")), ("size~dominated~T1", ("size", "tiered_dominated", "T1")), ("size#T1~dominated", ("size", "tiered_dominated", "T1")), ("node-count~transitive", ("", "count_transitive", None)), ("tier", ("", "tier", None))):
        view = MetricView.parse(text + "@delta")
        assert (view.metric, view.kind, view.tier, view.side) == (*want, "delta") and MetricView.parse(str(view)) == view
    assert MetricView.parse("size@right").side is None
    for bad in ("", "size@top", "node-count~T1", "size#T1~transitive", "size#", "a~b~c"):
        with pytest.raises(ValueError):
            MetricView.parse(bad)


@pytest.mark.parametrize("seed", [1, 2])
def test_min_cut(spark, seed):
    rng = random.Random(seed)
    nodes = list("abcdefgh")
    links = sorted({(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(22)) if a != b} - {("a", "h")} | {("a", "b"), ("b", "h")})
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    cut, blocked = paths.min_cut(spark.createDataFrame(links, "src string, dst string"), one("a"), one("h"))
    got = {(r[0], r[1]) for r in cut.select("src", "dst").collect()}
    assert not blocked and got <= set(links) and "h" not in closure(nodes, set(links) - got)["a"]
    for less in itertools.combinations(links, len(got) - 1):
        assert "h" in closure(nodes, set(links) - set(less))["a"]


def test_find_path(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "d", 1), ("d", "e", 1)], "src string, dst string, edge_ord long")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    path = lambda a, b, avoid=None: [r.node for r in sorted(paths.find_path(edges, one(a), one(b), avoid and one(avoid)).collect())]
    assert path("a", "e") == ["a", "b", "d", "e"]
    assert path("a", "e", "b") == ["a", "c", "d", "e"]
    assert path("a", "a") == ["a"] and path("e", "a") == []


def test_routes_are_compared_on_shortest_ways_only(spark, monkeypatch):
    """Sequences of edges are not carried to what lies off the shortest ways to the goals; the path is the same."""
    rng = random.Random(5)
    nodes = [f"n{k:02}" for k in range(30)]
    links = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(75)} | {("n00", f"x{k}") for k in range(20)})
    edges = spark.createDataFrame([(a, b, k * 7 % 11) for k, (a, b) in enumerate(links)], "src string, dst string, edge_ord long")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    plain, carried = paths.shortest_paths, []
    found = {r.node: r for r in plain(edges, one("n00")).collect()}
    far = max((r.depth, x) for x, r in found.items())[1]
    near = sorted(x for x, r in found.items() if r.depth == 2)
    monkeypatch.setattr(paths, "shortest_paths", lambda e, *a, **b: carried.append({r.dst for r in e.collect()}) or plain(e, *a, **b))
    for goals in ([far], [*near, far]):
        end = min((found[x].depth, found[x].route, x) for x in goals)[2]
        want = [end]
        while found[want[0]].parent is not None:
            want.insert(0, found[want[0]].parent)
        got = paths.find_path(edges, one("n00"), one(*goals)).orderBy("position").collect()
        assert [tuple(r) for r in got] == [*enumerate(want)]
    assert len(carried) == 2 and not any(x.startswith("x") for held in carried for x in held)
    assert paths.find_path(edges, one("n00"), one("nowhere")).isEmpty()


def test_tiers_of_what_only_one_side_reaches_without_pairs(spark):
    """The same as over pairs, for many roots and tiers of either side."""
    rng = random.Random(6)
    nodes = [f"n{k:02}" for k in range(25)]
    rows = [(a, b, "tagged", rng.choice("tuv"), None, None, None, None, None) for a, b in sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(60)} | {("n00", x) for x in nodes[1:6]})]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string, metadata string, edge_ord long")
    every = spark.createDataFrame([(x, None, None) for x in nodes], "node string, props map<string,string>, labels map<string,array<string>>")
    held = spark.createDataFrame([(x, "v", float(rng.randrange(-2, 5))) for x in nodes[:20]], "node string, metric string, value double")
    tiers = [("now", (), ()), ("late", ("t",), ()), ("last", ("u",), ())]
    configs = [TraversalConfig(force_tagged={"v": False}, tiers=tuple(tiers)), TraversalConfig(tiers=tuple(tiers[:2]))]
    start = spark.createDataFrame([("n00",)], "node string")
    left, right = traverse.prepare_all(every, held, edges, configs, start, rows=len(rows), counted=False)
    want = twin.exclusive_tiered([metrics.closure(p, every) for p in (left, right)], left, right, "v")
    got = twin.exclusive_tiers_of(every, left, right, "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not want.isEmpty()


def test_min_cut_of_protected_edges(spark):
    table = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    edges = table([("a", "b"), ("b", "h"), ("b", "c"), ("c", "h")])
    assert paths.min_cut(edges, one("a"), one("h"), table([("a", "b"), ("b", "h")]))[1]
    cut, blocked = paths.min_cut(edges, one("a"), one("h"), table([("a", "b")]))
    assert not blocked and {tuple(r) for r in cut.collect()} == {("b", "h"), ("c", "h")}


def test_large_steps_are_dealt_by_their_key(spark, monkeypatch):
    """Steps beyond LARGE lie in as many parts as their rows ask for, whatever the session's number, with the same results."""
    for module in (fixpoint, paths):
        monkeypatch.setattr(module, "LARGE", 10)
    monkeypatch.setattr(fixpoint, "PART", 10)
    rng = random.Random(3)
    nodes = [f"n{k}" for k in range(50)]
    links = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)})
    e = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(links)], "src string, dst string, edge_ord long")
    assert fixpoint.dealt(e, 90, "src").rdd.getNumPartitions() == 9
    reach = closure(nodes, links)
    into = {b for _, b in links}
    got = paths.ancestors(e, spark.createDataFrame([("n7",)], "node string"), parentless=True, limit=None)
    assert {r.node for r in got.collect()} == {a for a in nodes if a != "n7" and "n7" in reach[a] and a not in into}
    comp = {a: min(b for b in reach[a] if a in reach[b]) for a in nodes}
    entered = {comp[b] for a, b in links if comp[a] != comp[b]}
    every = spark.createDataFrame([(n,) for n in nodes], "node string")
    assert {r.node for r in scc.source_entry_points(every, e).collect()} == {*comp.values()} - entered


def test_dominators_of_numbered_nodes(spark, monkeypatch):
    """The tree of a prepared graph is made of its steps alone: edges are not saved with their verdicts."""
    rng = random.Random(5)
    links = sorted({(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for _ in range(45)})
    pairs = [x for x in links if x[0] != x[1]]
    want = dominators(links, links[0][0])
    live = sorted({x for x in pairs if x[0] in want})
    one = spark.createDataFrame([(links[0][0],)], "node string")
    tree = tree_of.dominator_tree(spark.createDataFrame(live, "src string, dst string"), one, spark.createDataFrame([(x,) for x in want], "node string"))
    assert {r.node: r.idom for r in tree.collect()} == want
    edges = spark.createDataFrame([(a, b, "directed", None, None, None, None, k) for k, (a, b) in enumerate(links)], "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string, edge_ord long")
    nodes = spark.createDataFrame([(x, {}, {}) for x in sorted({a for a, _ in links})], "node string, props map<string,string>, labels map<string,array<string>>")
    monkeypatch.setattr(traverse, "laid", lambda *_: pytest.fail("edges are saved"))
    p = traverse.prepare(nodes, None, edges, entry=one, rows=len(links), held="steps")
    assert {r.node: r.idom for r in p.tree.collect()} == want
