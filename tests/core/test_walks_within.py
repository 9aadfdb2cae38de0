"""Spots meet near nodes by cells, not all nodes of their plane, and POIs at one spot share their walks."""

import math
import random

from atrium.operators import endpoints
from atrium.plans import more
from atrium.sources.campus import Campus


def test_walks_equal_all_pairs(spark):
    rng = random.Random(2)
    spots = [(i, i % 2, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(60)] + [(60, 0, 6.0, 0.0)]
    nodes = [(i, i % 2, rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(80)] + [(80, 0, 0.0, 0.0)]
    got = endpoints.walks_within(spark.createDataFrame(spots, "s long, plane_id long, x double, y double"), spark.createDataFrame(nodes, "node_id long, plane_id long, x double, y double"), "s", 6.0)
    assert sorted((r.walk_id.s, r.walk_id.node_id) for r in got.collect()) == sorted((s, n) for s, p, x, y in spots for n, q, a, b in nodes if p == q and math.hypot(x - a, y - b) <= 6)


def test_pois_at_one_spot_share_walks(spark, monkeypatch):
    c = Campus(spark, "/root/testdata/sf0.001")
    many = c.pois().filter("poi_id = 0").selectExpr("explode(sequence(0L, 49L)) poi_id", "plane_id", "x", "y")
    monkeypatch.setattr(Campus, "pois", lambda self: many)
    walks, real = [], endpoints.blocked
    monkeypatch.setattr(endpoints, "blocked", lambda w, *rest: walks.append(w.count()) or real(w, *rest))
    rows = more.j6_blocked_walks(c).collect()
    assert sum(walks) > 0 and len(rows) == 50 and {r.walks for r in rows} == {sum(walks)}
