"""Trips over blocks of planes cost what one search over everything costs, and no search settles a whole plane."""

import random

import pytest

from atrium.operators import routing, trip_routes
from test_routes import EDGE, best_costs, town


def test_trips_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trip_routes, "blocks", lambda places: routing.blocks(places, 5))
    nodes, edges = town(3)
    rng = random.Random(5)
    ends = [(e, rng.choice(nodes)[0], float(rng.randint(0, 5)) * 1.2) for e in range(30) for _ in range(2)]
    trips = [(q, rng.randrange(31), rng.randrange(31)) for q in range(120)]
    table = spark.createDataFrame(ends, "end_id long, node_id long, distance double")
    placed = spark.createDataFrame([(n, p, float(n % 4), float(n % 7)) for n, p in nodes], "node_id long, plane_id long, x double, y double")
    ways = trip_routes.PlaneWays(spark.createDataFrame(edges, EDGE), placed, table)
    assert ways.nodes.groupBy("plane_id").count().agg({"count": "max"}).first()[0] <= 5
    got = {r.query_id: r for r in ways.trips(spark.createDataFrame(trips, "query_id long, from_id long, to_id long"), table, table).collect()}
    for q, a, b in trips:
        cost = best_costs(edges, [(n, d / 1.2) for e, n, d in ends if e == a])
        want = min((cost[n] + d / 1.2 for e, n, d in ends if e == b and n in cost), default=None)
        assert (want is None) == (q not in got)
        if want is not None:
            assert got[q].weight == pytest.approx(want)
