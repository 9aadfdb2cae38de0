"""Hulls of many points: equal to a walk over the sorted points, and not slower by the square of their number."""

import random
import time

from pyspark.sql import functions as F

from atrium.operators import export, spatial


def _hull(points):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(ps):
        stack = []
        for p in ps:
            while len(stack) > 1 and turn(stack[-2], stack[-1], p) <= 0:
                stack.pop()
            stack.append(p)
        return stack[:-1]

    return chain(points) + chain(points[::-1])


def test_hulls_of_parts_equal_one_walk(spark):
    rng = random.Random(5)
    sets = {
        1: [(rng.gauss(0, 9), rng.gauss(0, 3)) for _ in range(4000)],
        2: [(float(rng.randrange(30)), float(rng.randrange(40))) for _ in range(2000)],
        3: [(2.0, float(i % 7)) for i in range(50)],
        4: [(float(i), float(i)) for i in range(1500)],
        5: [(1.0, 1.0)] * 3,
        6: [(0.0, 0.0), (1.0, 2.0)],
    }
    df = spark.createDataFrame([(k, x, y) for k, ps in sets.items() for x, y in ps], "k int, x double, y double")
    got = {r.k: [(p.x, p.y) for p in r.hull] for r in spatial.hulls(df.select("k", F.struct("x", "y").alias("p")), "k").collect()}
    assert got == {k: _hull(ps) for k, ps in sets.items()}


def test_a_floor_of_many_rooms(spark):
    """60,000 corners of one floor: a fold over all of them grows with the square of their number."""
    room = spark.range(15000).selectExpr("id space_id", "1L plane_id", "cast(id % 10 * 6 as double) x", "cast(floor(id / 10) * 5 as double) y")
    room = room.selectExpr("space_id", "plane_id", "array(struct(x, y), struct(x + 5 as x, y), struct(x + 5 as x, y + 4 as y), struct(x, y + 4 as y)) polygon")
    floors = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "plane_id long, building_id long, level int")
    start = time.monotonic()
    got = {r.plane_id: r for r in export.levels(floors, room).collect()}
    assert time.monotonic() - start < 60
    assert [(p.x, p.y) for p in got[1].outline] == [(0.0, 0.0), (59.0, 0.0), (59.0, 7499.0), (0.0, 7499.0)]
    assert not got[1].empty and got[2].empty
