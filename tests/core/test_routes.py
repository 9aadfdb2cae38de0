"""Trips over gates against one search over the whole graph; floor links; ends of routes; components and cycles."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from atrium.operators import endpoints, floor_links, trip_routes
from atrium.operators.components import components, cycles
from atrium.operators.routing import searches

EDGE = "src long, dst long, edge_id string, weight double, metres double, seconds double"


def town(seed, planes=6, each=12):
    """Nodes on planes; edges one way or both ways, few of them between planes."""
    rng = random.Random(seed)
    nodes = [(p * 100 + k, p) for p in range(planes) for k in range(each)]
    edges = []
    for p in range(planes):
        for k in range(each):
            for _ in range(2):
                edges.append((p * 100 + k, p * 100 + rng.randrange(each)))
    for p in range(planes - 2):  # the last two planes are far from all others
        edges += [(p * 100 + rng.randrange(each), (p + 1) % (planes - 2) * 100 + rng.randrange(each)), ((p + 1) % (planes - 2) * 100 + rng.randrange(each), p * 100 + rng.randrange(each))]
    return nodes, [(a, b, f"e{i}", float(w := rng.randint(1, 20)), w * 2.0, float(w)) for i, (a, b) in enumerate(edges) if a != b]


def best_costs(edges, starts):
    cost, heap = {}, [(w, n) for n, w in starts]
    heapq.heapify(heap)
    out = {}
    for a, b, _, w, _, _ in edges:
        out.setdefault(a, []).append((b, w))
    while heap:
        w, n = heapq.heappop(heap)
        if n not in cost:
            cost[n] = w
            for b, x in out.get(n, []):
                heapq.heappush(heap, (w + x, b))
    return cost


def test_trips_cost_what_one_search_over_everything_costs(spark):
    for seed in range(2):
        nodes, edges = town(seed)
        rng = random.Random(seed + 10)
        ends = [(e, rng.choice(nodes)[0], float(rng.randint(0, 5)) * 1.2) for e in range(40) for _ in range(2)]
        trips = [(q, rng.randrange(42), rng.randrange(42)) for q in range(150)]
        ways = trip_routes.PlaneWays(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, "node_id long, plane_id long"))
        table = spark.createDataFrame(ends, "end_id long, node_id long, distance double")
        got = {r.query_id: r for r in ways.trips(spark.createDataFrame(trips, "query_id long, from_id long, to_id long"), table, table).collect()}
        for q, a, b in trips:
            cost = best_costs(edges, [(n, d / 1.2) for e, n, d in ends if e == a])
            want = min((cost[n] + d / 1.2 for e, n, d in ends if e == b and n in cost), default=None)
            assert (want is None) == (q not in got)
            if want is not None:
                assert got[q].weight == pytest.approx(want) and got[q].seconds == pytest.approx(want)


@pytest.mark.parametrize("hops", [1, 2, 3, 5])
def test_searches_with_any_number_of_hops_in_a_round(spark, monkeypatch, hops):
    from atrium.operators import routing

    monkeypatch.setattr(routing, "HOPS", hops)
    _, edges = town(3, planes=3)
    starts = spark.createDataFrame([(1, 0, 0.5, 7.0), (1, 5, 2.0, 0.0), (2, 104, 0.0, 0.0)], "search_id long, node long, extra double, walked double")
    got = {(r.search_id, r.node): r for r in searches(starts, spark.createDataFrame(edges, EDGE)).collect()}
    for s, own in ((1, [(0, 0.5), (5, 2.0)]), (2, [(104, 0.0)])):
        want = best_costs(edges, own)
        assert {n: got[s, n].weight for t, n in got if t == s} == pytest.approx(want)
    assert got[1, 0].metres == 7.0
    few = searches(starts, spark.createDataFrame(edges, EDGE), most_rounds=1)
    assert few.agg(F.max("hops")).first()[0] == 1


def test_floor_links_become_connectors(spark):
    floors = spark.createDataFrame([(p, 1, p, float(4 * p)) for p in (1, 2, 3)] + [(9, 2, 1, 0.0)], "plane_id long, building_id long, level int, elevation double")
    nodes = spark.createDataFrame([(p * 10 + k, p, float(k), 0.5) for p in (1, 2, 3, 9) for k in range(6)], "node_id long, plane_id long, x double, y double")
    edge = lambda i, a, b, kind, ok=True, one=False: (i, a // 10, a, b, kind, ok, one)
    edges = [edge("a", 10, 20, "stairs"), edge("b", 20, 30, "stairs"), edge("c", 11, 21, "escalator", True, True), edge("d", 21, 31, "escalator", True, True), edge("e", 32, 22, "escalator", True, True), edge("f", 13, 23, "walk", True, True)]
    edges += [edge("g", 14, 24, "elevator"), edge("h", 24, 15, "elevator"), edge("i", 12, 13, "walk"), edge("j", 15, 90, "walk"), edge("k", 10, 20, "elevator", False), edge("l", 25, 35, "escalator", True, True), edge("m", 35, 25, "escalator", True, True)]
    df = spark.createDataFrame(edges, "edge_id string, plane_id long, from_id long, to_id long, type string, accessible boolean, one_way boolean")
    plan = floor_links.planned(df, nodes, floors)
    got = {r.connector_id: (r.kind, r.accessible, r.direction, r.edges) for r in plan["connectors"].collect()}
    assert got == {"link-stairs-10": ("stairs", False, None, 2), "link-escalator-11": ("escalator", True, "up", 2), "link-escalator-22": ("escalator", True, "down", 1), "link-elevator-10": ("elevator", False, None, 1)}
    assert {(r.type, r.group, r.reason) for r in plan["skipped"].collect()} == {("walk", 13, "one-way-ambiguous"), ("elevator", 14, "multiple-nodes-on-floor"), ("escalator", 25, "one-way-ambiguous")}
    shaft = [{"x": -1.0, "y": -1.0}, {"x": 0.5, "y": -1.0}, {"x": 0.5, "y": 1.0}, {"x": -1.0, "y": 1.0}]
    spaces = spark.createDataFrame([(7, 1, 1, "stairs", shaft, []), (8, 2, 1, "room", shaft, [])], "space_id long, plane_id long, ord int, type string, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    stay, stops = floor_links.applied(plan, df, nodes, spaces)
    assert sorted(r.edge_id for r in stay.collect()) == ["f", "g", "h", "i", "j", "l", "m"]
    at = {(r.connector_id, r.node_id): r.space_id for r in stops.collect()}
    assert at["link-stairs-10", 10] == 7 and at["link-stairs-10", 20] is None and len(at) == 3 + 3 + 2 + 2


def test_ends_prefer_the_stated_room_and_look_further_for_a_clear_node(spark):
    box = lambda x0, y0, x1, y1: [{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}]
    spaces = spark.createDataFrame([(1, 1, 1, box(0.0, 0.0, 10.0, 10.0), []), (2, 1, 2, box(20.0, 0.0, 30.0, 10.0), []), (3, 1, 3, box(100.0, 0.0, 110.0, 10.0), [])], "space_id long, plane_id long, ord int, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    nodes = spark.createDataFrame([(11, 1, 5.0, 5.0), (22, 1, 25.0, 5.0), (23, 1, 22.0, 5.0)], "node_id long, plane_id long, x double, y double")
    walls = spark.createDataFrame([(1, 1, 15.0, -50.0, 15.0, 50.0)], "wall_id long, plane_id long, sx double, sy double, ex double, ey double")
    doors = spark.createDataFrame([], "entrance_id long, plane_id long, wall_id long, type string, x double, y double, width double")
    pois = spark.createDataFrame([(1, 1, 5.0, 6.0, 2), (2, 1, 5.0, 6.0, None), (3, 1, 5.0, 6.0, 77), (4, 1, 50.0, 5.0, None), (5, 8, 0.0, 0.0, None)], "poi_id long, plane_id long, x double, y double, space_id long")
    ends = spark.createDataFrame([(i, "poi", i, None, None, None) for i in range(1, 7)] + [(10, "node", 22, None, None, None), (11, "node", 99, None, None, None), (12, "space", 2, None, None, None), (13, "space", 3, None, None, None), (14, "position", None, 1, 12.0, 5.0), (15, "position", None, 1, 1e6, 1e6)], "end_id long, kind string, ref_id long, plane_id long, x double, y double")
    got = {}
    for r in endpoints.resolved(ends, pois, spaces, nodes, walls, doors).collect():
        got.setdefault(r.end_id, {})[r.node_id] = round(r.distance, 3)
    # the stated room is beyond the wall: the nearest node that can be walked to takes its place
    assert got[1] == {11: 1.0} and got[2] == {11: 1.0} and got[3] == {11: 1.0}
    assert got[4] == {22: 25.0} and 5 not in got and 6 not in got and got[10] == {22: 0.0} and 11 not in got
    assert got[12] == {22: 0.0, 23: 0.0} and got[13] == {22: 80.0} and got[14] == {11: 7.0} and 15 not in got


def test_components_and_cycles_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300) if i % 100 != 99]
    nodes = spark.createDataFrame([(i,) for i in range(302)], "node long")
    got = {r.node: r.component for r in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i // 100 * 100 if i < 301 else 301 for i in range(302)}
    rng = random.Random(4)
    order = list(range(60))
    rng.shuffle(order)
    rings = [order[:1], order[1:3], order[3:20], order[20:]]
    following = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    found = {r.item: (r.cycle, r.place, r.size) for r in cycles(spark.createDataFrame(following, "item long, next long")).collect()}
    for ring in rings:
        low = ring.index(min(ring))
        turned = ring[low:] + ring[:low]
        assert [found[i] for i in turned] == [(turned[0], k, len(ring)) for k in range(len(ring))]
