"""Cuts, contraction, routes, hops, pages in their order, undeclared nodes, the index of names and weeks, against plain Python."""

import random
from collections import defaultdict

import pytest
from graphlens.operators import contraction, explore, fixpoint, history, json_diff, paths, scc, traverse, twin
from graphlens.operators.fixpoint import new_folder
from graphlens.plans.config import MetricView, TraversalConfig
from graphlens.sources import names
from graphlens.sources.tables import supply
from pyspark.sql import functions as F

EDGE = "src string, dst string, kind string, tag string, type_key string, edge_name string, branch string, edge_ord long"


def edges_of(spark, links):
    return spark.createDataFrame([(a, b, "tagged" if t else "directed", t, None, None, None, k) for k, (a, b, t) in enumerate(links)], EDGE)


def one(spark, *found):
    return spark.createDataFrame([(n,) for n in found], "node string")


def reach(links, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        x = todo.pop()
        for a, b in links:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def greatest_flow(links, sources, sinks):
    """Units by single augmenting paths."""
    cap = defaultdict(int)
    for a, b in links:
        if a != b:
            cap[a, b] += 1
    flow = 0
    while True:
        back, todo = dict.fromkeys(sources), list(sources)
        while todo:
            x = todo.pop(0)
            for (a, b), c in list(cap.items()):
                if a == x and c > 0 and b not in back:
                    back[b] = a
                    todo.append(b)
        goal = next((s for s in sinks if s in back), None)
        if goal is None:
            return flow
        while back[goal] is not None:
            cap[back[goal], goal] -= 1
            cap[goal, back[goal]] += 1
            goal = back[goal]
        flow += 1


def test_min_cut_of_many_units(spark):
    rng = random.Random(3)
    layers = [[f"a{k}" for k in range(3)], [f"b{k}" for k in range(6)], [f"c{k}" for k in range(6)], [f"d{k}" for k in range(3)]]
    links = [(rng.choice(x), rng.choice(y)) for x, y in zip(layers, layers[1:], strict=False) for _ in range(14)] + [("b0", "b1"), ("c1", "b2"), ("c2", "c3")]
    cut, blocked = paths.min_cut(spark.createDataFrame(links, "src string, dst string"), one(spark, *layers[0]), one(spark, *layers[3]))
    got = {tuple(r) for r in cut.collect()}
    rest = [e for e in links if e not in got]
    assert not blocked and not reach(rest, layers[0]) & {*layers[3]}
    assert sum(links.count(e) for e in got) == greatest_flow(links, layers[0], layers[3])


def test_contraction_and_routes(spark):
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(24)]
    links = sorted({(nodes[a], nodes[b], rng.choice([None, "lazy"])) for a, b in ((rng.randrange(20), rng.randrange(4, 24)) for _ in range(45)) if a < b}, key=str)
    edges = edges_of(spark, links)
    group = {n: f"g{k % 5}" for k, n in enumerate(nodes) if k % 3}
    value = {n: k + 1.0 for k, n in enumerate(nodes)}
    metrics = spark.createDataFrame([(n, "size", v) for n, v in value.items()], "node string, metric string, value double")
    members, sums, made = contraction.contract(one(spark, *nodes), metrics, edges, spark.createDataFrame([*group.items(), ("n0", None)], "node string, group string"))
    name = lambda n: group.get(n, n)
    assert {r.node: r.members for r in members.collect()} == {g: sum(name(n) == g for n in nodes) for g in map(name, nodes)}
    assert {r.node: r.value for r in sums.collect()} == {g: sum(v for n, v in value.items() if name(n) == g) for g in map(name, nodes)}
    assert sorted((r.src, r.dst, r.tag or "") for r in made.collect()) == sorted({(name(a), name(b), t or "") for a, b, t in links if name(a) != name(b)})

    member = [(n, r) for n in nodes for r in "xyz" if rng.random() < 0.35 and n not in nodes[:3]]
    entries = [n for n in nodes if not any(b == n for _, b, _ in links)]
    of = defaultdict(set)
    for n, r in member:
        of[n].add(r)
    want = {(r, n) for n in entries for r in of[n]}
    for n in entries:
        sets = [of[b] for a, b, _ in links if a == n and of[b]]
        want |= {(r, n) for r in set.intersection(*sets)} if sets and not of[n] else set()
    found, alone = contraction.route_entries(edges, one(spark, *nodes), spark.createDataFrame(member, "node string, route string"))
    assert {tuple(r) for r in found.collect()} == want and {r.node for r in alone.collect()} == {*entries} - {n for _, n in want}
    sizes = contraction.route_sizes(found, edges.select("src", "dst", F.col("tag").isNotNull().alias("lazy")), metrics, "size")
    for r in sizes.collect():
        start = [n for q, n in want if q == r.route]
        eager, every = reach([(a, b) for a, b, t in links if not t], start), reach([(a, b) for a, b, _ in links], start)
        assert (r.eager, r.lazy) == (sum(value[n] for n in eager), sum(value[n] for n in every - eager))


def test_hops_of_a_path(spark):
    edges = edges_of(spark, [("a", "b", "late"), ("a", "b", None), ("b", "c", "x"), ("a", "d", None), ("d", "e", None), ("e", "c", None)])
    hops = lambda *args: [(r.src, r.dst, r.tag) for r in paths.path_hops(edges, *args).orderBy("position").collect()]
    assert hops("a", "c") == [("a", "b", "late"), ("b", "c", "x")]
    assert hops("a", "c", ("b",)) == [("a", "d", None), ("d", "e", None), ("e", "c", None)] and hops("c", "a") == []
    for bad in (("a", "q"), ("a", "c", ("c",)), ("a", "c", ("zz",))):
        with pytest.raises(ValueError):
            hops(*bad)


def test_pages_keep_their_order_and_undeclared_nodes_are_compared(spark):
    rng = random.Random(2)
    kids = [f"k{k:02d}" for k in range(13)]
    weight = {n: float(rng.randrange(100)) for n in kids}
    nodes = spark.createDataFrame([(n, {}, {}) for n in ["r", *kids[:-1]]], "node string, props map<string,string>, labels map<string,array<string>>")
    metrics = spark.createDataFrame([(n, "w", v) for n, v in weight.items()], "node string, metric string, value double")
    edges = edges_of(spark, [("r", n, None) for n in kids])  # the last child is known only as a target
    fewer = edges.where(F.col("dst") != kids[3])
    views = [MetricView.parse(v) for v in ("w", "parents-count", "node-count~transitive")]
    p, q = (traverse.prepare(nodes, metrics, e, entry=one(spark, "r")) for e in (edges, fewer))
    page = explore.explore(p, "node:r", views, sort="w", offset=2, limit=8).rows.collect()
    want = sorted(kids, key=lambda n: (-weight[n], n))
    assert [r.node for r in page] == want[2:10] and [r.position for r in page] == list(range(3, 11)) and [r.w for r in page] == [weight[n] for n in want[2:10]]
    both = explore.explore_delta(p, q, "all", [MetricView.parse("parents-count@delta")], sort="parents-count@delta")
    rows = both.rows.collect()
    assert both.total.first().total == 14 and len(rows) == 14 and rows[0].node == kids[3] and [r.node for r in rows[1:]] == sorted(({*kids} | {"r"}) - {kids[3]})
    diff = {r.node: r.diff for r in twin.node_diff((nodes.where("node <> 'k05'"), metrics, edges.where("dst <> 'k05'")), (nodes, metrics, edges.where("dst <> 'k12'"))).collect()}
    assert diff["k05"] == twin.ADDED and diff["k12"] == twin.REMOVED and diff["r"] == twin.EDGES and diff["k01"] == 0


def test_index_of_names(spark):
    rng = random.Random(1)
    some = sorted({"".join(rng.choice("abcAB12.") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    folder = new_folder(spark, "names")
    names.write_index(one(spark, *some), folder)
    for text in ("a", "b1", "a2b", "..", "cab1"):
        def has(name, text=text):
            rest = iter(name.lower())
            return all(c in rest for c in text.lower())
        assert [r.node for r in names.search(spark, folder, text, 10).collect()] == sorted((n for n in some if has(n)), key=lambda n: (len(n), n))[:10]
    read = names.candidates(spark, folder, "cab1").count()
    assert sum(has(n, "cab1") for n in some) <= read < len(some)


def test_weeks_that_are_merged(spark):
    import datetime

    rng = random.Random(4)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(16)]
    value = {(n, d): float(rng.randrange(3)) for n in "ab" for d in days}
    frame = lambda of: spark.createDataFrame([(n, d, "m", v) for (n, d), v in value.items() if of(n, d)], "node string, ts date, metric string, value double")
    part = {d: rng.randrange(3) for d in days}
    stored = history.weekly(frame(lambda n, d: part[d] == 0))
    for turn in (2, 1):
        known = spark.createDataFrame([(d,) for d in days if part[d] in (0, 2, turn)], "ts date")
        stored = history.weekly_merge(stored, frame(lambda n, d, turn=turn: part[d] == turn), known)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, history.weekly(frame(lambda n, d: True)).collect()))


def test_condensed_graph_and_paths_of_two_graphs(spark):
    rng = random.Random(7)
    nodes = [f"n{k:02d}" for k in range(16)]
    links = sorted({(rng.choice(nodes), rng.choice(nodes), rng.choice([None, "t"])) for _ in range(26)}, key=str)
    plain = [(a, b) for a, b, _ in links]
    reached = {n: reach(plain, [n]) for n in nodes}
    comp = {a: min(b for b in nodes if b in reached[a] and a in reached[b]) for a in nodes}
    large = sorted({c for c in comp.values() if [*comp.values()].count(c) > 1})
    name = {n: f"SCC #{large.index(c) + 1}" if c in large else c for n, c in comp.items()}
    edges = edges_of(spark, links)
    made, sums, outer = scc.condensed_graph(scc.components(one(spark, *nodes), edges), spark.createDataFrame([(n, "m", 2.0) for n in nodes], "node string, metric string, value double"), edges)
    size = {x: [*name.values()].count(x) for x in name.values()}
    assert {r.node: r["size"] for r in made.collect()} == size
    assert {(r.node, r.metric): r.value for r in sums.collect()} == {(x, "m"): 2.0 * n for x, n in size.items()} | {(x, "scc_node_count"): float(n) for x, n in size.items() if n > 1}
    assert sorted((r.src, r.dst, r.tag or "", r.entered) for r in outer.collect()) == sorted({(name[a], name[b], t or "", b) for a, b, t in links if name[a] != name[b]})

    left = edges_of(spark, [("s", "a", None), ("a", "b", None), ("b", "g", None), ("x", "y", None)])
    right = edges_of(spark, [("s", "a", None), ("a", "g", None), ("s", "c", None), ("c", "d", None), ("d", "g", None)])
    side, path = twin.twin_path(left, right, one(spark, "s"), one(spark, "g"))
    assert side == "right" and [r.node for r in path.orderBy("position").collect()] == ["s", "a", "g"]
    assert twin.twin_path(left, right, one(spark, "g"), one(spark, "s"))[0] is None
    hops = twin.changed_path(left, right, one(spark, "s", "d", "g"), one(spark, "s"), one(spark, "g"))
    assert [(r.node, r.skipped) for r in hops.orderBy("position").collect()] == [("s", 0), ("g", 1)]
    sides = twin.with_twin_roots((left, one(spark, "s")), (right, one(spark, "s")))
    assert [e.count() for e, _ in sides] == [4, 5]
    sides = twin.with_twin_roots((left, one(spark, "s")), (right, one(spark, "s", "c")))
    assert [e.count() for e, _ in sides] == [5, 7] and {entry.first().node for _, entry in sides} == {"~root~"}


def test_arrays_are_aligned_at_every_size():
    rng = random.Random(8)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for k, y in enumerate(b):
                row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
        return row[-1]

    for n, m, letters in ((0, 3, "ab"), (7, 0, "ab"), (40, 60, "abc"), (700, 900, "abcdefgh")):
        a, b = [rng.choice(letters) for _ in range(n)], [rng.choice(letters) for _ in range(m)]
        pairs = list(json_diff._aligned(a, b))
        assert [i for i, _ in pairs if i is not None] == list(range(n)) and [j for _, j in pairs if j is not None] == list(range(m))
        assert all(a[i] == b[j] for i, j in pairs if i is not None and j is not None)
        assert sum(i is not None and j is not None for i, j in pairs) == longest(a, b)
    a = [str(k) for k in range(5000)]
    b = [x for k, x in enumerate(a) if k % 7] + ["z"] * 700
    rng.shuffle(b)
    assert len([1 for i, j in json_diff._aligned(a, sorted(b, key=lambda x: (x == "z", int(x) if x != "z" else 0))) if i is not None and j is not None]) == 4285


def test_one_graph_under_two_configurations_is_not_compared_edge_by_edge(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"n{k:02d}" for k in range(30)]
    nodes = spark.createDataFrame([(n, {}, {}) for n in names], "node string, props map<string,string>, labels map<string,array<string>>")
    metrics = spark.createDataFrame([(n, "w", 1.0) for n in names], "node string, metric string, value double")
    edges = edges_of(spark, [("n00", "n01", None), ("n00", "q", "x"), *[(rng.choice(names), rng.choice(names), rng.choice([None, "x"])) for _ in range(60)]])
    configs = TraversalConfig(force_tagged={"x": False}), TraversalConfig()
    page = lambda sides: {tuple(r) for r in explore.explore_delta(*sides, "all", [MetricView.parse(v) for v in ("parents-count", "parents-count@delta")], sort="parents-count@delta", limit=100).rows.collect()}
    want = page([traverse.prepare(nodes, metrics, edges.where("src IS NOT NULL"), c, one(spark, "n00")) for c in configs])
    monkeypatch.setattr(fixpoint, "LARGE", 10)
    monkeypatch.setattr(traverse, "LARGE", 10)
    held = traverse.laid(edges, 60)
    monkeypatch.setattr(twin, "node_diff", lambda *_: pytest.fail("edges of one graph are compared"))
    assert page([traverse.prepare(nodes, metrics, edges, c, one(spark, "n00")) for c in configs]) == want
    sides = [traverse.prepare(nodes, metrics, held, c, one(spark, "n00"), rows=60, held="laid") for c in configs]
    assert page(sides) == want and len({r[2] for r in want}) == 2
    assert sides[0].state.count() == len(names) + 1 and traverse.prepare(nodes, metrics, edges, entry=one(spark, "n00", "nowhere")).state.where("entry").count() == 1


def test_routes_in_one_search_over_the_edges_asked_for(spark, monkeypatch):
    every, some = (supply(spark, "/root/testdata/sf0.001", **only).edges for only in ({}, {"only": "co"}))
    assert sorted(some.collect()) == sorted(every.where("src LIKE 'c%' OR src LIKE 'o%'").collect())
    monkeypatch.setattr(fixpoint, "LARGE", 3)
    rows = [("a", "b", True), ("a", "b", False), ("b", "c", True), ("c", "a", False), ("c", "d", False), ("e", "d", None), ("e", "b", True), ("x", "y", False)]
    edges = traverse.laid(spark.createDataFrame(rows, "src string, dst string, lazy boolean"), len(rows))
    values = spark.createDataFrame([(n, "w", float(1 << k)) for k, n in enumerate("abcdexy")], "node string, metric string, value double")
    routes = spark.createDataFrame([("one", "a"), ("two", "e"), ("two", "c"), ("none", "z")], "route string, node string")
    got = {r.route: (r.eager, r.lazy) for r in contraction.route_sizes(routes, edges, values, "w", by_src=True).collect()}
    assert got == {"one": (3.0, 12.0), "two": (31.0, 0.0), "none": (0.0, 0.0)}


def test_several_configurations_share_one_table_and_one_loop(spark, monkeypatch):
    rng = random.Random(9)
    names = [f"n{k:02d}" for k in range(30)]
    nodes = spark.createDataFrame([(n, {}, {"odd": ["yes"]} if k % 7 == 3 else {}) for k, n in enumerate(names)], "node string, props map<string,string>, labels map<string,array<string>>")
    metrics = spark.createDataFrame([(n, "w", 1.0) for n in names], "node string, metric string, value double")
    edges = edges_of(spark, [("n00", "n01", None), ("n00", "q", "x"), *[(rng.choice(names), rng.choice(names), rng.choice([None, "x", "y"])) for _ in range(90)]])
    tiers = (("first", (), ()), ("second", ("y",), ()))
    configs = [TraversalConfig(force_tagged={"x": False}, tiers=tiers), TraversalConfig(label_predicates=(("odd", "yes", True, False),)), TraversalConfig(tiers=tiers, max_tier=0)]
    seen = lambda p: (sorted(p.reached.collect()), sorted(p.open_steps.collect()), sorted(p.live.collect()), p.tiers)
    several, single = one(spark, "n00", "n05", "nowhere"), one(spark, "n00")
    want = [seen(traverse.prepare(nodes, metrics, edges, c, several)) for c in configs]
    assert want[0] != want[1] != want[2] != want[0]
    made = []
    loop, table = traverse.tiers_of, traverse.saved_by
    monkeypatch.setattr(traverse, "tiers_of", lambda *a, **k: made.append("loop") or loop(*a, **k))
    monkeypatch.setattr(traverse, "saved_by", lambda *a, **k: made.append("table") or table(*a, **k))
    assert [seen(p) for p in traverse.prepare_all(nodes, metrics, edges, configs, several)] == want and made == ["table", "loop"]
    want = [seen(traverse.prepare(nodes, metrics, edges, c, single)) for c in configs[:2]]
    monkeypatch.setattr(fixpoint, "LARGE", 10)
    sides = traverse.prepare_all(nodes, metrics, fixpoint.saved_by(fixpoint.dealt(edges, 92, "src"), 92, "src"), configs[:2], single, 92, by_src=True)
    assert [seen(p) for p in sides] == want and sides[0].same_graph(sides[1])


def test_edges_are_made_where_their_nodes_are_dealt(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = sorted(supply(spark, folder).edges.collect(), key=str)
    monkeypatch.setattr(fixpoint, "LARGE", 2000)
    monkeypatch.setattr(fixpoint, "PART", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        g = supply(spark, folder, by_src=True)
        assert sorted(g.edges.collect(), key=str) == want
        pairs = fixpoint.dealt(g.edges, g.rows, "src").groupBy("src", "dst").count()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # no shuffle above the union of the edges, nor one in the session's number of parts, as lines were shuffled once more when there were too many orders to broadcast
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Union")] and "ENSURE_REQUIREMENTS" not in plan
