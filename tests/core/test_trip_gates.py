"""Gates of an end are weighed against gates of their own plane, not against all gates."""

from atrium.operators import trip_routes
from test_routes import EDGE, town


def test_gates_meet_gates_of_their_plane(spark, monkeypatch):
    monkeypatch.setattr(trip_routes, "BLOCK", 5)
    nodes, edges = town(3)
    placed = spark.createDataFrame([(n, p, float(n % 4), float(n % 7)) for n, p in nodes], "node_id long, plane_id long, x double, y double")
    ways = trip_routes.PlaneWays(spark.createDataFrame(edges, EDGE), placed)
    plane = {r.node_id: r.plane_id for r in ways.nodes.collect()}
    every = {(r.a, r.b) for r in ways.gates.collect() if r.a != r.b}
    beside = {(r.a, r.b) for r in ways.beside.collect()}
    assert beside == {(a, b) for a, b in every if plane[a] == plane[b]}
    assert 0 < len(beside) < len(every)
