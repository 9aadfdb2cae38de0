"""Ends of edges are looked up once for all kinds of edges and both directions."""

from atrium.operators import graph

EDGE = "edge_id string, from_id long, to_id long, type string, distance double, accessible boolean, one_way boolean, duration double"


def test_edges_of_many_kinds_meet_the_nodes_once(spark):
    row = lambda k, a, b, **more: tuple(({"edge_id": k, "from_id": a, "to_id": b, "type": "walk", "distance": 12.0, "accessible": True, "one_way": False, "duration": None} | more).values())
    kinds = [[row("a", 1, 2), row("lost", 1, 9)], [row("b", 2, 3, one_way=True)], [row("c", 3, 1, type="elevator", duration=4.0)]]
    frames = [spark.createDataFrame(k, EDGE) for k in kinds]
    nodes = spark.createDataFrame([(1,), (2,), (3,), (3,)], "node_id long")
    adjacent = graph.adjacency(frames[0].union(frames[1]).union(frames[2]), nodes, asked_speed=1.5, prefer_elevator=True)
    got = sorted((r.src, r.dst, r.edge_id, r.seconds, r.weight) for r in adjacent.collect())
    assert got == [(1, 2, "a", 8.0, 8.0), (1, 3, "c", 4.0, 2.0), (2, 1, "a", 8.0, 8.0), (2, 3, "b", 8.0, 8.0), (3, 1, "c", 4.0, 2.0)]
    # six pieces of a union, each with two joins, would all hold their memory within one task
    assert "Join" not in adjacent._jdf.queryExecution().executedPlan().toString()
