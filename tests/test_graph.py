import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.operators import graph as G

EDGE = "seq int, subject string, relation string, object string, confidence double, source string"
# Ships, the harbours they call at, the coasts those lie on and their seas: two parts that do not meet.
FLEET = [
    ("Alma", "calls-at", "Skerry", 0.7), ("Alma", "calls-at", "Mole", 0.6), ("Bryn", "calls-at", "Mole", 0.8), ("Skerry", "lies-on", "North Coast", 0.9), ("Mole", "lies-on", "North Coast", 0.75), ("Mole", "lies-on", "East Coast", 0.75),
    ("North Coast", "bounds", "Cold Sea", 0.95), ("East Coast", "bounds", "Cold Sea", 0.85), ("Cold Sea", "borders", "Skerry", 0.5), ("Dory", "calls-at", "Far Quay", 0.65), ("Far Quay", "lies-on", "South Coast", 0.55),
]


def graph(spark, rows, source="parametric"):
    return spark.createDataFrame([(i, *r[:4], r[4] if len(r) > 4 else source) for i, r in enumerate(rows)], EDGE)


@pytest.fixture(scope="module")
def fleet(spark):
    return graph(spark, FLEET).cache()


@pytest.fixture(scope="module")
def tangle():
    """Many edges among few nodes, with loops, cycles and parallel edges."""
    rng = random.Random(9)
    return [(f"n{rng.randrange(25)}", rng.choice("rs"), f"n{rng.randrange(25)}", rng.randrange(1, 100) / 100) for _ in range(70)]


def triples(df):
    return {(r.subject, r.relation, r.object) for r in df.collect()}


def test_walk_takes_the_surest_edge_and_the_last_of_equals(spark, fleet):
    starts = spark.createDataFrame([("Alma",), ("Bryn",), ("Skerry",), ("Nobody",)], "start string")
    got = {r.start: r.path for r in G.walk(fleet, starts, ["calls-at", "lies-on", "bounds"]).collect()}
    assert got == {"Alma": ["Alma", "Skerry", "North Coast", "Cold Sea"], "Bryn": ["Bryn", "Mole", "East Coast", "Cold Sea"]}
    every = [(r.path, r.confidence) for r in G.walk_all_paths(fleet, starts, ["calls-at", "lies-on"], 2).collect()]
    assert sorted(every) == [(["Alma", "Mole", "East Coast"], 0.6), (["Alma", "Skerry", "North Coast"], 0.7), (["Bryn", "Mole", "East Coast"], 0.75), (["Bryn", "Mole", "North Coast"], 0.75)]


def test_first_edge_wins(spark):
    a, b = graph(spark, [("x", "r", "y", 0.35)]), graph(spark, [("x", "r", "y", 0.95), ("u", "r", "v", 1.7), ("w", "r", "v", -0.2)]).withColumn("seq", F.col("seq") + 10)
    assert {r.subject: r.confidence for r in G.add_edges(a, b).collect()} == {"x": 0.35, "u": 1.0, "w": 0.0}


def test_search(fleet):
    got = [(r.subject, r.object, r.score) for r in G.search(fleet, "mole lies mole", 10).collect()]
    assert got[0][2] == 3 and {g[:2] for g in got if g[2] == 3} == {("Mole", "North Coast"), ("Mole", "East Coast")}
    assert {g[:2] for g in got if g[2] == 2} == {("Alma", "Mole"), ("Bryn", "Mole")} and {g[:2] for g in got if g[2] == 1} == {("Skerry", "North Coast"), ("Far Quay", "South Coast")}
    assert G.search(fleet, "lies-on").count() == 0


def test_bfs_and_subgraph(fleet):
    assert {r.node: r.depth for r in G.bfs(fleet, "Alma", 2).collect()} == {"Alma": 0, "Skerry": 1, "Mole": 1, "North Coast": 2, "East Coast": 2}
    assert {r.node: r.depth for r in G.bfs(fleet, "Nobody", 3).collect()} == {"Nobody": 0}
    assert triples(G.subgraph(fleet, "Bryn", 1)) == {("Bryn", "calls-at", "Mole"), ("Mole", "lies-on", "North Coast"), ("Mole", "lies-on", "East Coast")}


def depth_first(rows, source, most):
    """By recursion on a stack of iterators, each node's edges from the last to the first."""
    seen = {}
    out = defaultdict(list)
    for s, _, o, _ in rows:
        out[s].insert(0, o)
    pending = [(source, 0)]
    while pending:
        node, depth = pending.pop(0)
        if node in seen or depth > most:
            continue
        seen[node] = depth
        if depth < most:
            pending = [(o, depth + 1) for o in out[node]] + pending
    return list(seen.items())


def test_dfs(spark, fleet, tangle):
    assert [(r.node, r.depth) for r in G.dfs(fleet, "Alma", 5).orderBy("place").collect()] == [("Alma", 0), ("Mole", 1), ("East Coast", 2), ("Cold Sea", 3), ("Skerry", 4), ("North Coast", 5)]
    g = graph(spark, tangle)
    for depth in (0, 1, 4):
        assert [(r.node, r.depth) for r in G.dfs(g, "n3", depth).orderBy("place").collect()] == depth_first(tangle, "n3", depth)
    assert [(r.node, r.depth) for r in G.dfs(g, "nowhere", 3).collect()] == [("nowhere", 0)]
    with pytest.raises(ValueError):
        G.dfs(g, "n3", 9, most_edges=3)


def cheapest(rows, source):
    cost, heap = {}, [(0.0, source)]
    while heap:
        c, node = heapq.heappop(heap)
        if node not in cost:
            cost[node] = c
            for s, _, o, p in rows:
                if s == node:
                    heapq.heappush(heap, (c + 1 - p, o))
    return cost


def test_shortest_paths_and_astar(spark, fleet, tangle):
    g = graph(spark, tangle)
    want = cheapest(tangle, "n3")
    assert {r.node: pytest.approx(r.cost) for r in G.shortest_paths(g, "n3").collect()} == want
    got = {r.node: r.path for r in G.shortest_paths(fleet, "Bryn").collect()}
    assert got["Cold Sea"] == ["Bryn", "Mole", "North Coast", "Cold Sea"] and got["Bryn"] == ["Bryn"] and "Alma" not in got
    rest = spark.createDataFrame([(n, 0.5 * c) for n, c in cheapest([(o, r, s, p) for s, r, o, p in tangle], max(want)).items()], "node string, h double")
    plain, led = G.astar(g, "n3", max(want)).first(), G.astar(g, "n3", max(want), rest).first()
    assert plain.cost == pytest.approx(want[max(want)]) == led.cost and led.path[0] == "n3" and led.path[-1] == max(want)
    assert 0 < led.nodes_explored <= plain.nodes_explored <= len(want)
    assert G.astar(fleet, "Dory", "Cold Sea").count() == 0
    loop = G.astar(fleet, "Dory", "Dory").first()
    assert (loop.cost, loop.path, loop.nodes_explored) == (0.0, ["Dory"], 0)


def test_components(spark, fleet):
    got = {r.node: (r.component, r.size) for r in G.components(fleet).collect()}
    assert got["Cold Sea"] == ("Alma", 7) and got["South Coast"] == ("Dory", 3)
    pairs = spark.createDataFrame([("Bryn", "Skerry"), ("Bryn", "Dory"), ("z", "z"), ("z", "y")], "a string, b string")
    assert {(r.a, r.b): r.connected for r in G.are_connected(fleet, pairs).collect()} == {("Bryn", "Skerry"): True, ("Bryn", "Dory"): False, ("z", "z"): True, ("z", "y"): False}
    chain = graph(spark, [(f"n{i:03}", "r", f"n{i + 1:03}", 1.0) for i in range(100)])
    assert {r.component for r in G.components(chain).collect()} == {"n000"}


def test_pagerank(spark, tangle):
    ranks, rounds, settled = G.pagerank(graph(spark, tangle))
    got = {r.node: r.rank for r in ranks.collect()}
    nodes = sorted({x for s, _, o, _ in tangle for x in (s, o)})
    out = defaultdict(list)
    for s, _, o, _ in tangle:
        out[s].append(o)
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(want[n] for n in nodes if n not in out)
        new = {n: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for n in nodes}
        for s, to in out.items():
            for o in to:
                new[o] += 0.85 * want[s] / len(to)
        want = new
    assert settled and got == {n: pytest.approx(r) for n, r in want.items()}
    assert not G.pagerank(graph(spark, tangle), max_rounds=2)[2]


def test_merge_and_diff(spark):
    old = graph(spark, [("a", "r", "b", 0.45, "wikidata"), ("c", "r", "d", 0.65, "unknown"), ("g", "r", "h", 0.2, "manual")])
    new = graph(spark, [("a", "r", "b", 0.55, "document"), ("c", "r", "d", 0.6, "manual"), ("e", "r", "f", 0.15, "manual")])
    for strategy, want in (("union", (0.45, 0.65)), ("max_confidence", (0.55, 0.65)), ("source_priority", (0.45, 0.6))):
        got = {r.subject: r.confidence for r in G.merge(old, new, strategy).collect()}
        assert (got["a"], got["c"], got["e"], got["g"]) == (*want, 0.15, 0.2)
    assert {(r.subject, r.status) for r in G.diff(old, new).collect()} == {("a", "changed"), ("c", "changed"), ("e", "added"), ("g", "removed")}


def test_filter_and_defaults(spark):
    rows = [(0, "Alma", "calls-at", "Mole", 0.35, "manual", {"layer": "3", "selectivity": "0.25", "c_in": "0.9"}), (1, "Bryn", "calls-at", "Skerry", 0.85, "manual", {"layer": "12", "c_out": "0.4"}),
            (2, "Mole", "lies-on", "North Coast", 0.85, "document", {"layer": "20", "selectivity": "0.95"}), (3, "Skerry", "lies-on", "North Coast", 0.1, "unknown", None)]
    g = spark.createDataFrame(rows, EDGE + ", metadata map<string,string>")
    n = lambda **k: {r.seq for r in G.filtered(g, **k).collect()}
    assert n() == {0, 1, 2, 3} and n(min_confidence=0.85) == {1, 2} and n(max_confidence=0.35) == {0, 3} and n(relations=["lies-on"]) == {2, 3} == n(without_relations=["calls-at"]) and n(sources=["document", "unknown"]) == {2, 3}
    assert n(layer_min=12) == {1, 2} and n(layer_max=12) == {0, 1} and n(selectivity_min=0.25) == {0, 2} and n(c_in_min=0.5) == {0} and n(c_out_min=0.4) == {1} and n(subject_contains="r") == {1, 3} and n(object_contains="S") == {1}
    assert n(relations=["calls-at"], min_confidence=0.5, layer_min=5) == {1}
    bare = G.edges_of(spark.createDataFrame([("a", "r", "b")], "subject string, relation string, object string")).first()
    assert (bare.confidence, bare.source, bare.metadata) == (1.0, "unknown", {})


def test_nodes_stats_and_empty_graph(spark, fleet):
    rules = spark.createDataFrame([(1, "ship", ["calls-at"], []), (2, "harbour", ["lies-on"], ["calls-at"]), (3, "sea", [], ["bounds"])], "rule_no int, node_type string, outgoing array<string>, incoming array<string>")
    got = {r.node: (r.degree, r.out_degree, r.in_degree, r.node_type) for r in G.nodes(fleet, rules).collect()}
    assert got["Mole"] == (4, 2, 2, "harbour") and got["Cold Sea"] == (3, 1, 2, "sea") and got["Alma"] == (2, 2, 0, "ship") and got["East Coast"][3] is None
    s = G.stats(fleet).first()
    assert (s.entities, s.edges, s.relations, s.components, s.by_source) == (10, 11, 4, 2, {"parametric": 11}) and s.avg_degree == pytest.approx(2.2)
    none = fleet.limit(0)
    assert G.stats(none).first().edges == 0 and G.components(none).count() == 0 and G.pagerank(none)[0].count() == 0


def test_extract_bfs(spark):
    known = spark.createDataFrame([("Alma calls at", "Mole", 0.8), ("Mole calls at", "a very long way off indeed", 0.9), ("Bryn calls at", "Skerry", 0.2)], "prompt string, answer string, probability double")
    templates = spark.createDataFrame([("calls", "{subject} calls at")], "relation string, template string")
    seeds = spark.createDataFrame([("Alma",), ("Bryn",)], "entity string")
    got = G.extract_bfs(seeds, templates, lambda asked: asked.join(known, "prompt"))
    assert triples(got) == {("Alma", "calls", "Mole"), ("Mole", "calls", "a very long way off indeed")}


def test_chain():
    guesses = {"Old": [(" grey", 0.8)], "Old grey": [(" quay", 0.6)], "Old grey quay": [("\n", 0.9)], "Low": [("er", 0.05)]}
    predict = lambda p: guesses.get(p, [])
    assert G.chain(predict, "Old") == ("grey quay", pytest.approx(0.7), 0.6)
    assert G.chain(predict, "Low", least=0.1) == ("", 0.0, 0.0) and G.chain(predict, "none") == ("", 0.0, 0.0)


def test_ranks_in_bounded_tasks(spark, monkeypatch):
    """More tasks for more edges, and the same ranks."""
    edges = spark.createDataFrame([(f"a{i % 7}", f"b{i % 5}") for i in range(60)], "subject string, object string")
    want = {r.node: round(r["rank"], 12) for r in G.pagerank(edges, max_rounds=3, tolerance=0.0)[0].collect()}
    monkeypatch.setattr(G, "RANK_ROWS", 3)
    assert {r.node: round(r["rank"], 12) for r in G.pagerank(edges, max_rounds=3, tolerance=0.0)[0].collect()} == want
