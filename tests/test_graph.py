from __future__ import annotations

from collections import deque
from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from coratia.operators import graph
from tests.conftest import rows

BOOK = ["AB", "AC", "BC", "BD", "DE", "DF", "DG", "EF", "FG"]


def _edges(spark, pairs):
    pairs = spark.createDataFrame([tuple(p) for p in pairs], "a string, b string")
    return graph.both_directions(pairs, "a", "b")


def _neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def _distances(near, root):
    level, queue = {root: 0}, deque([root])
    while queue:
        node = queue.popleft()
        for other in near[node]:
            if other not in level:
                level[other] = level[node] + 1
                queue.append(other)
    return level


def _shortest_paths(near, a, b):
    """All shortest paths from a to b, spelled out."""
    level = _distances(near, b)
    paths = [[a]] if a in level else []
    while paths and paths[0][-1] != b:
        paths = [p + [n] for p in paths for n in near[p[-1]] if level.get(n) == level[p[-1]] - 1]
    return paths


def _brute_betweenness(near):
    value = {}
    for a, b in combinations(sorted(near), 2):
        paths = _shortest_paths(near, a, b)
        for path in paths:
            for edge in zip(path, path[1:]):
                edge = tuple(sorted(edge))
                value[edge] = value.get(edge, 0) + 1 / len(paths)
    return value


def _brute_parts(near):
    return sorted({tuple(sorted(_distances(near, n))) for n in near})


def _brute_modularity(near0, parts):
    m2 = sum(len(v) for v in near0.values())
    total = 0
    for part in parts:
        for i in part:
            for j in part:
                total += (j in near0[i]) - len(near0[i]) * len(near0[j]) / m2
    return total / m2


def _brute_communities(pairs):
    near0, near = _neighbours(pairs), _neighbours(pairs)
    best = _brute_parts(near)
    best_value = _brute_modularity(near0, best)
    while True:
        between = _brute_betweenness(near)
        top = max((round(v, 9) for v in between.values()), default=0)
        if top <= 1:
            return best
        for (a, b), v in between.items():
            if round(v, 9) == top:
                near[a].discard(b)
                near[b].discard(a)
        parts = _brute_parts(near)
        value = _brute_modularity(near0, parts)
        if value > best_value + 1e-12:
            best, best_value = parts, value


def _random_pairs(seed, n=11, density=0.25):
    draw = Random(seed)
    names = [chr(ord("A") + i) for i in range(n)]
    return [p for p in combinations(names, 2) if draw.random() < density]


def _parts(membership):
    groups = {}
    for node, community in membership.collect():
        groups.setdefault(community, []).append(node)
    assert all(min(nodes) == name for name, nodes in groups.items())
    return sorted(tuple(sorted(nodes)) for nodes in groups.values())


def _same_betweenness(found, expected):
    found = {(r.src, r.dst): r.betweenness for r in found.collect()}
    assert found == pytest.approx(expected)


def test_book_example(spark):
    found = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(_edges(spark, BOOK)).collect()}
    assert found == pytest.approx(
        {"BD": 12, "AB": 5, "BC": 5, "DE": 4.5, "DG": 4.5, "DF": 4, "EF": 1.5, "FG": 1.5, "AC": 1}
    )


@pytest.mark.parametrize("options", [{}, {"hub": 2, "batches": 3}])
def test_random_graph_betweenness(spark, options):
    pairs = _random_pairs(3)
    near = _neighbours(pairs)
    between = graph.edge_betweenness(_edges(spark, pairs), **options)
    _same_betweenness(between, _brute_betweenness(near))
    # The values add up to the distances of all connected pairs.
    total = sum(_distances(near, a).get(b, 0) for a, b in combinations(sorted(near), 2))
    assert between.agg(F.sum("betweenness")).first()[0] == pytest.approx(total)
    assert between.filter(F.col("betweenness") < 1 - 1e-9).isEmpty()


def test_levels_paths_and_credits(spark):
    pairs = _random_pairs(4)
    near = _neighbours(pairs)
    found = {(r.root, r.node): (r.level, r.sigma) for r in graph.shortest_path_counts(_edges(spark, pairs)).collect()}
    expected = {
        (a, b): (d, float(len(_shortest_paths(near, a, b)))) for a in near for b, d in _distances(near, a).items()
    }
    assert found == expected
    roots = spark.createDataFrame([("A",), ("C",)], "node string")
    some = graph.shortest_path_counts(_edges(spark, pairs), roots, hub=1)
    assert {(r.root, r.node): (r.level, r.sigma) for r in some.collect()} == {
        k: v for k, v in expected.items() if k[0] in "AC"
    }
    credits = {(r.root, r.node): r.credit for r in graph.node_credit(_edges(spark, BOOK)).collect()}
    from_e = {n: c for (root, n), c in credits.items() if root == "E"}
    assert from_e == pytest.approx({"E": 7, "D": 4.5, "F": 1.5, "B": 3, "G": 1, "A": 1, "C": 1})


def test_path_graph_ends_in_singletons(spark):
    edges = _edges(spark, ["AB", "BC"])
    between = graph.edge_betweenness(edges)
    _same_betweenness(between, {("A", "B"): 2.0, ("B", "C"): 2.0})
    assert graph.drop_top_edges(edges, between).collect() == []
    assert _parts(graph.girvan_newman(edges)) == [("A", "B", "C")]


def test_clique_is_one_community(spark):
    edges = _edges(spark, ["AB", "BC", "AC"])
    membership = graph.girvan_newman(edges)
    assert _parts(membership) == [("A", "B", "C")]
    assert graph.modularity(edges, membership).first()[0] == pytest.approx(0)


def test_two_triangles(spark):
    edges = _edges(spark, ["AB", "BC", "AC", "CD", "DE", "EF", "DF"])
    membership = graph.girvan_newman(edges)
    assert _parts(membership) == [("A", "B", "C"), ("D", "E", "F")]
    assert graph.modularity(edges, membership).first()[0] == pytest.approx(5 / 14)
    left = graph.drop_top_edges(edges, graph.edge_betweenness(edges))
    assert edges.subtract(left).count() == 2


def test_communities_of_a_random_graph(spark):
    pairs = _random_pairs(8, 9, 0.3)
    assert _parts(graph.girvan_newman(_edges(spark, pairs))) == _brute_communities(pairs)


def test_components(spark):
    draw = Random(5)
    order = [f"{i:03d}" for i in range(120)]
    draw.shuffle(order)
    pairs = [p for p in zip(order, order[1:]) if draw.random() < 0.9]  # long paths
    pairs += [(order[0], order[i]) for i in range(100, 110)]
    near = _neighbours(pairs)
    spread = spark.createDataFrame(pairs, "a string, b string")
    edges = graph.both_directions(spread, "a", "b")
    nodes = graph.nodes_of(edges).unionByName(spark.createDataFrame([("alone",)], "node string"))
    near["alone"] = set()
    assert _parts(graph.components(nodes, edges)) == _brute_parts(near)


def test_modularity_of_any_split(spark):
    pairs = _random_pairs(6)
    near = _neighbours(pairs)
    halves = {n: "x" if n < "E" else "y" for n in near}
    membership = spark.createDataFrame(list(halves.items()), "node string, community string")
    parts = [[n for n in near if halves[n] == c] for c in "xy"]
    found = graph.modularity(_edges(spark, pairs), membership).first()[0]
    assert found == pytest.approx(_brute_modularity(near, parts))


def test_co_graph(spark):
    draw = Random(1)
    visits = [(u, i) for u in range(20) for i in range(12) if i < 2 or draw.random() < 0.5]
    df = spark.createDataFrame(visits * 2, "user long, item long")
    held = {}
    for u, i in visits:
        held.setdefault(u, set()).add(i)
    for threshold in (1, 4, 6):
        expected = sorted((u, v) for u in held for v in held if u != v and len(held[u] & held[v]) >= threshold)
        assert rows(graph.co_graph(df, "user", "item", threshold)) == expected
        # Items with more than three users are hot and make no pairs themselves.
        assert rows(graph.co_graph(df, "user", "item", threshold, hot_group=3, limit=9)) == expected
    counts = rows(graph.shared_counts(df, "user", "item", 5, hot_group=1))
    assert counts == sorted(
        (u, v, len(held[u] & held[v])) for u, v in combinations(held, 2) if len(held[u] & held[v]) >= 5
    )


def test_blocked_counts_are_the_shared_counts(spark):
    draw = Random(2)
    visits = [(f"u{u}", i) for u in range(50) for i in range(21) if draw.random() < 0.5]
    df = spark.createDataFrame(visits, "member string, group int")
    held = {}
    for u, i in visits:
        held.setdefault(u, set()).add(i)
    expected = sorted((u, v, len(held[u] & held[v])) for u in held for v in held if u < v and len(held[u] & held[v]) >= 6)
    for block in (7, 50, 64):
        assert rows(graph.blocked_counts(df, 6, block, fewest_matches=0)) == expected
    assert graph.blocked_counts(df, 6) is None
    assert graph.blocked_counts(df, 6, cells_per_match=0.5, fewest_matches=0) is None
    assert graph.blocked_counts(df.limit(0), 6, fewest_matches=0) is None


def test_dense_groups_make_no_matches(spark):
    """Thousands of members in every group: the pairs come from products, no row per match is shuffled."""
    df = spark.range(4_000).select((F.col("id")).alias("user"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("item"))
    df = df.filter((F.col("item") != F.col("user") % 13) & (F.col("user") % 13 < 12))
    pairs = graph.shared_counts(df, "user", "item", 11)
    assert "FlatMapCoGroupsInPandas" in pairs._jdf.queryExecution().executedPlan().toString()
    of_rest = [sum(1 for u in range(4_000) if u % 13 == k) for k in range(12)]
    assert pairs.count() == sum(n * (n - 1) // 2 for n in of_rest)
    assert pairs.filter("shared != 11 or member_1 >= member_2 or member_1 % 13 != member_2 % 13").isEmpty()


def test_empty(spark):
    edges = _edges(spark, []).filter(F.lit(True))
    nodes = graph.nodes_of(edges)
    assert graph.edge_betweenness(edges).collect() == []
    assert graph.shortest_path_counts(edges).collect() == []
    assert graph.node_credit(edges).collect() == []
    assert graph.components(nodes, edges).collect() == []
    assert graph.girvan_newman(edges).collect() == []
    assert graph.modularity(edges, graph.components(nodes, edges)).first()[0] is None
    assert graph.drop_top_edges(edges, graph.edge_betweenness(edges)).collect() == []


@pytest.mark.parametrize("state_rows", [1, 14, 1_000])
def test_betweenness_in_bounded_batches(spark, state_rows, monkeypatch):
    """Batches of roots as large as the bound allows; no batch holds more rows."""
    held = []
    real = graph._search_levels

    def counted(steps, roots):
        levels = real(steps, roots)
        held.append(sum(level.rows for level in levels))
        return levels

    monkeypatch.setattr(graph, "_search_levels", counted)
    found = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(_edges(spark, BOOK), state_rows=state_rows).collect()}
    assert found == {"BD": 12.0, "AB": 5.0, "BC": 5.0, "DE": 4.5, "DG": 4.5, "DF": 4.0, "EF": 1.5, "FG": 1.5, "AC": 1.0}
    assert len(held) == graph.root_batches(7, state_rows) and max(held) <= max(state_rows, 7)


def test_betweenness_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    folder, real, calls = str(tmp_path / "sums"), graph._search_levels, []

    def breaks(steps, roots):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(steps, roots)

    monkeypatch.setattr(graph, "_search_levels", breaks)
    edges = _edges(spark, BOOK)
    with pytest.raises(RuntimeError):
        graph.edge_betweenness(edges, batches=4, folder=folder)
    found = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(edges, batches=4, folder=folder).collect()}
    assert found["BD"] == 12.0 and found["AC"] == 1.0 and len(found) == 9
    # Two batches were written before the break, so two more searches were needed.
    assert len(calls) == 5


def test_first_split(spark):
    edges = _edges(spark, ["AB", "BC", "AC", "CD", "DE", "EF", "DF"])
    assert _parts(graph.first_split(edges)) == [("A", "B", "C"), ("D", "E", "F")]
    ring = _edges(spark, ["AB", "BC", "CD", "AD"])  # all edges tie and go together
    assert _parts(graph.first_split(ring)) == [("A",), ("B",), ("C",), ("D",)]
    assert graph.first_split(edges.limit(0)).collect() == []


@pytest.mark.parametrize("options", [{}, {"PART_WORK": 0, "SMALL_PART": 6}, {"PART_WORK": 0, "SMALL_PART": 1, "PART_EDGES": 12}])
def test_searches_in_strips_of_roots(spark, options, monkeypatch):
    """Strips, components and parts too large for strips give the same rows; without the latter no path becomes a row of a join."""
    pairs = _random_pairs(5) + [("X", "Y"), ("Y", "Z"), ("X", "W"), ("W", "Z"), ("P", "Q")]
    near = _neighbours(pairs)
    monkeypatch.setattr(graph, "STRIP_CELLS", 40)
    monkeypatch.setattr(graph, "LISTED_CELLS", 40)
    monkeypatch.setattr(graph, "GATHERED", 8)
    for name, value in options.items():
        monkeypatch.setattr(graph, name, value)
    joined, real = [], graph._search_levels
    monkeypatch.setattr(graph, "_search_levels", lambda *given: joined.append(1) or real(*given))
    edges = _edges(spark, pairs)
    _same_betweenness(graph.edge_betweenness(edges), _brute_betweenness(near))
    found = {(r.root, r.node): (r.level, r.sigma) for r in graph.shortest_path_counts(edges).collect()}
    assert found == {(a, b): (d, float(len(_shortest_paths(near, a, b)))) for a in near for b, d in _distances(near, a).items()}
    credits = {(r.root, r.node): r.credit for r in graph.node_credit(edges).collect()}
    assert credits.keys() == found.keys() and credits["X", "X"] == pytest.approx(4) and credits["X", "Y"] == pytest.approx(1.5)
    assert bool(joined) == ("PART_EDGES" in options)


@pytest.mark.parametrize("most", [4, 1_000])
def test_tasks_make_stars_of_the_links_they_have(spark, monkeypatch, most):
    """Few links are stars at once, without a round; where a task may hold few, the rounds go on to the same components."""
    rng = Random(4)
    pairs = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(70)] + [(-5, 3), (7, 7)]
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, most)
    asked, plain = [], graph._all_stars
    monkeypatch.setattr(graph, "_all_stars", lambda links: asked.append(1) or plain(links))
    least = {n: n for pair in pairs for n in pair}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    nodes = spark.createDataFrame([(n,) for n in least], "node long")
    try:
        assert {r["node"]: r["community"] for r in graph.components(nodes, edges, most).collect()} == least
    finally:
        spark.conf.set(batch, before)
    assert len(asked) == 1 if most > 4 else len(asked) > 1
