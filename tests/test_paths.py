"""Least-cost paths against Dijkstra's search and scenes worked out by hand."""

import heapq
import math
import random

from trailframe.operators import paths

EDGES = "src long, dst long, cost long"
REQUESTS = "request_id long, src long, dst long"


def dijkstra(edges, src):
    out, seen, heap = {}, {}, [(0, src)]
    for a, b, c in edges:
        if None not in (a, b, c):
            out.setdefault(a, []).append((b, c))
    while heap:
        cost, node = heapq.heappop(heap)
        if node in seen:
            continue
        seen[node] = cost
        for b, c in out.get(node, ()):
            heapq.heappush(heap, (cost + c, b))
    return seen


def found(spark, edges, requests, **more):
    asked = spark.createDataFrame(requests, REQUESTS)
    costs = paths.least_costs(spark.createDataFrame(edges, EDGES), asked, **more).cache()
    ways = {}
    for r in paths.paths(costs, asked).orderBy("request_id", "place").collect():
        ways.setdefault(r.request_id, []).append((r.place, r.node, r.cost))
    return {(r.request_id, r.node): r.cost for r in costs.collect()}, ways


def test_diamonds_one_ways_and_islands(spark):
    # two ways of one cost, a one-way, a dead end, an island, a loop, a parallel edge, and edges without an end
    edges = [(1, 3, 5), (1, 2, 5), (2, 4, 5), (3, 4, 5), (4, 5, 1), (5, 6, 0), (9, 8, 1), (2, 2, 1), (1, 2, 7), (None, 3, 1), (3, None, 1), (4, 6, None)]
    costs, ways = found(spark, edges, [(1, 1, 6), (2, 4, 1), (3, 7, 7), (4, 1, 8), (5, 1, 1)])
    assert ways == {1: [(0, 1, 0), (1, 2, 5), (2, 4, 10), (3, 5, 11), (4, 6, 11)], 3: [(0, 7, 0)], 5: [(0, 1, 0)]}
    assert (2, 1) not in costs and (4, 8) not in costs


def test_paths_of_many_requests(spark):
    draw = random.Random(2)
    side = 12
    at = {x * side + y: (47 + y * 0.001, 8 + x * 0.0015) for x in range(side) for y in range(side)}

    def metres(a, b):
        (y1, x1), (y2, x2) = at[a], at[b]
        h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    edges = []
    for n in at:
        for m in (n + 1, n - 1, n + side, n - side):
            if m in at and (abs(m - n) == side or m // side == n // side) and draw.random() < 0.85:
                edges.append((n, m, math.ceil(metres(n, m) * draw.choice((1, 1, 2, 5)))))
    requests = [(i, draw.randrange(side * side), draw.randrange(side * side)) for i in range(60)]
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "node long, lat double, lon double")
    plain, ways = found(spark, edges, requests)
    bounded, again = found(spark, edges, requests, nodes=nodes, cost_per_m=1.0)
    assert ways == again and len(bounded) < len(plain)
    least = {(a, b): c for a, b, c in sorted(edges, reverse=True)}
    for i, src, dst in requests:
        want = dijkstra(edges, src)
        if dst not in want:
            assert i not in ways
            continue
        way = ways[i]
        assert [p for p, *_ in way] == list(range(len(way))) and way[0][1:] == (src, 0) and way[-1][1:] == (dst, want[dst])
        assert all(b[2] - a[2] == least[a[1], b[1]] for a, b in zip(way, way[1:], strict=False))
    assert len(ways) > 40


def test_requests_of_the_same_ends_are_one_search(spark):
    # 300 requests of three pairs of ends, one without a source; an edge that starts where none ends is on no path
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 2, 4), (9, 2, 1), (3, 3, 1)], EDGES)
    asked = spark.createDataFrame([(i, *((1, 3), (1, 2), (3, 1))[i % 3]) for i in range(300)] + [(300, None, 1)], REQUESTS)
    found = paths.searches(asked).collect()
    assert sorted((r.request_id, r.search_id) for r in found) == [(i, i % 3) for i in range(300)]
    once = paths.searches(asked).filter("request_id = search_id").select("request_id", "src", "dst")
    kept = paths.usable(edges, once)
    assert sorted(map(tuple, kept.collect())) == [(1, 2, 4), (2, 3, 5)]
    costs = paths.least_costs(edges, once)
    assert costs.count() == 6 and {(r.request_id, r.node): r.cost for r in costs.collect()}[0, 3] == 9


def test_reached_nodes_are_not_broadcast(spark, monkeypatch):
    """Written costs compress well and look small to Spark; a broadcast of them takes the driver's memory."""
    from trailframe.sources import shared

    plans, plain = [], shared.Rounds.next
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(shared.Rounds, "next", lambda self, df: (plan(df), plain(self, df))[1])
    monkeypatch.setattr(paths, "FEW_EDGES", 0)  # as if edges were many
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 11)], EDGES)
    asked = paths.searches(spark.createDataFrame([(1, 1, 3), (2, 1, 3)], REQUESTS))
    plan(asked)
    costs = paths.least_costs(edges, asked.filter("request_id = search_id"))
    way = paths.paths(costs, asked.filter("request_id = search_id"))
    assert sorted((r.request_id, r.place, r.node, r.cost) for r in way.collect()) == [(1, 0, 1, 0), (1, 1, 2, 5), (1, 2, 3, 10)]
    plan(way)
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
