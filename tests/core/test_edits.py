"""Rounded corners, snapping, and walls that move, on small maps with known answers."""

from __future__ import annotations

import math

import pytest

from atrium.operators import rounding, snapping, wall_moves

WALL = "plane_id long, wall_id long, sx double, sy double, ex double, ey double, thickness double"
SPACE = "plane_id long, space_id long, ord long, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d)]


@pytest.fixture(scope="module")
def turn(spark):
    """Four routes over the same corner at (0, 0), from the left and upwards, each on a plane of its own; the fifth goes straight on."""
    rows = [(f"r{p}", p, i, x, y) for p in range(1, 5) for i, (x, y) in enumerate([(-3.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 3.0)])]
    rows += [("line", 5, i, float(i), 0.0) for i in range(3)] + [("point", 5, 0, 9.0, 9.0)]
    return spark.createDataFrame(rows, "path_id string, plane_id long, ord int, x double, y double")


def radii(out):
    return {r.path_id: r.radius for r in out.filter("radius is not null").select("path_id", "radius").distinct().collect()}


def test_corners_shrink_or_stay_sharp(spark, turn):
    walls = [(2, 1, -0.1, 0.1, -2.0, 2.0, 0.1), (3, 2, -0.3, 0.3, -2.0, 2.0, 0.1), (4, 3, -9.0, -5.0, 9.0, -5.0, 0.2)]
    spaces = [(4, 1, 0, box(-50.0, -50.0, 50.0, 50.0), [box(-2.0, 0.05, -0.05, 2.0)])]
    around = rounding.obstacles(spark.createDataFrame(walls, WALL), spark.createDataFrame(spaces, SPACE))
    out = rounding.rounded(turn, around).cache()
    got = radii(out)
    assert got["r1"] == pytest.approx(0.8)  # nothing near
    for plane, (x, y) in (("r2", (-0.1, 0.1)), ("r3", (-0.3, 0.3))):
        clear = [k for k in range(8) if nearest(0.8 * 0.6**k, x, y) >= 0.05]
        assert got[plane] == pytest.approx(0.8 * 0.6 ** clear[0])
    assert got["r2"] < got["r3"] <= 0.8
    touching = [k for k in range(8) if not crosses_hole(0.8 * 0.6**k)]
    assert got["r4"] == pytest.approx(0.8 * 0.6 ** touching[0])  # holes have no clearance, but are not cut
    assert "line" not in got
    assert out.filter("path_id = 'line'").count() == 3 and out.filter("path_id = 'point'").count() == 1
    first = out.filter("path_id = 'r1'").orderBy("ord", "step").collect()
    assert (first[0].x, first[0].y) == (-3.0, 0.0) and (first[-1].x, first[-1].y) == (0.0, 3.0)
    assert (first[1].x, first[1].y) == (pytest.approx(-0.8), 0.0) and len(first) == 2 + 9
    assert radii(rounding.rounded(turn)) == {f"r{p}": pytest.approx(0.8) for p in range(1, 5)}


def curve(r):
    return [(-r * (1 - i / 8) ** 2, r * (i / 8) ** 2) for i in range(9)]


def nearest(r, x, y):
    """The distance of (x, y), the end of a wall that points away, from the curve."""
    found = []
    for (ax, ay), (bx, by) in zip(curve(r), curve(r)[1:]):
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        inner = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        found.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) if inner < 0 else 0.0)
    return min(found)


def crosses_hole(r):
    """Whether a side of the curve comes into the hole, whose near corner is (-0.05, 0.05)."""
    return any(t_in(*p, *q) for p, q in zip(curve(r), curve(r)[1:]))


def t_in(ax, ay, bx, by):
    return any(ax + (bx - ax) * k / 200 <= -0.05 and ay + (by - ay) * k / 200 >= 0.05 for k in range(201))


def test_a_doorway_that_the_route_uses_blocks_nothing(spark, turn):
    walls = [(1, 1, 0.0, 0.0, -4.0, 0.0, 0.2)]  # the route runs in the wall itself
    got = radii(rounding.rounded(turn.filter("path_id = 'r1'"), rounding.obstacles(spark.createDataFrame(walls, WALL), spark.createDataFrame([], SPACE))))
    assert got == {"r1": pytest.approx(0.8)}


def test_each_kind_of_snapping_wins_once(spark):
    spaces = spark.createDataFrame([(1, 1, 0, box(0.0, 0.0, 10.0, 10.0), [])], SPACE)
    walls = spark.createDataFrame([(1, 7, 20.0, 0.0, 24.0, 3.0, 0.2)], WALL)
    rows = [
        (1, 1, 0.1, 0.1, None, None, None),  # a corner
        (2, 1, 5.4, 0.1, None, None, None),  # an edge, to the grid along it
        (3, 1, 5.4, 3.3, None, None, None),  # nothing: the grid
        (4, 1, 5.12, 3.4, 5.02, 9.0, None),  # above the reference point
        (5, 1, 0.1, 0.1, None, None, "space-1"),  # the room does not attract its own corner
        (6, 1, 22.03, 1.46, None, None, None),  # a slanted wall has no grid
        (7, 2, 0.1, 0.1, None, None, None),  # another plane
    ]
    p = spark.createDataFrame(rows, "point_id long, plane_id long, x double, y double, rx double, ry double, excluded string")
    got = {r.point_id: (r.kind, round(r.x, 6), round(r.y, 6)) for r in snapping.snapped(p, spaces, walls, grid=1.0).collect()}
    assert got[1] == ("vertex", 0.0, 0.0) and got[3] == ("grid", 5.0, 3.0) and got[4] == ("orthogonal", 5.02, 3.0)
    assert got[2] == ("grid", 5.0, 0.0)  # the same place; the grid comes before the edge
    assert got[5] == ("grid", 0.0, 0.0) and got[6][0] == "edge" and got[7] == ("grid", 0.0, 0.0)
    free = {r.point_id: (r.kind, round(r.x, 6), round(r.y, 6)) for r in snapping.snapped(p, spaces, walls).collect()}
    assert free[2] == ("edge", 5.4, 0.0) and free[3] == (None, 5.4, 3.3) and free[4] == ("orthogonal", 5.02, 3.4) and free[7] == (None, 0.1, 0.1)


@pytest.fixture(scope="module")
def draft(spark):
    walls = [(1, 1, 0.0, 0.0, 10.0, 0.0, 0.2), (1, 2, 10.0, 0.05, 10.0, 5.0, 0.2), (1, 3, 5.0, -0.3, 5.0, -4.0, 0.2), (2, 4, 0.0, 0.0, 10.0, 0.0, 0.2)]
    spaces = [(1, 1, 0, box(0.0, 0.0, 10.0, 5.0), [box(1.0, 1.0, 2.0, 2.0)]), (2, 2, 0, box(0.0, 0.0, 10.0, 5.0), [])]
    elements = [(1, 1, 5.0, 0.4, 0.9, True, (4.0, 0.0, 6.0, 0.0)), (1, 2, 5.0, 3.0, None, True, None), (1, 3, 5.0, 0.0, 0.9, False, None)]
    e = spark.createDataFrame(elements, "plane_id long, element_id long, x double, y double, width double, accepted boolean, support struct<sx:double,sy:double,ex:double,ey:double>")
    return wall_moves.Draft(spark.createDataFrame(walls, WALL), spark.createDataFrame(spaces, SPACE), e)


def ends(draft):
    return {r.wall_id: tuple(round(v, 6) for v in (r.sx, r.sy, r.ex, r.ey)) for r in draft.walls.collect()}


def rings(draft):
    return {r.space_id: [(round(p.x, 6), round(p.y, 6)) for p in r.polygon] for r in draft.spaces.collect()}


CHANGE = "plane_id long, wall_id long, sx double, sy double, ex double, ey double, detach boolean"


def test_a_reshaped_wall_takes_what_touches_it(spark, draft):
    out = wall_moves.reshaped(draft, spark.createDataFrame([(1, 1, 0.0, -1.0, 20.0, -1.0, None)], CHANGE))
    assert ends(out) == {1: (0.0, -1.0, 20.0, -1.0), 2: (20.0, -0.95, 10.0, 5.0), 3: (5.0, -0.3, 5.0, -4.0), 4: (0.0, 0.0, 10.0, 0.0)}
    assert rings(out) == {1: [(0.0, -1.0), (20.0, -1.0), (10.0, 5.0), (0.0, 5.0)], 2: [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)]}
    assert {r.element_id: r.accepted for r in out.elements.collect()} == {1: False, 2: True, 3: False}
    alone = wall_moves.reshaped(draft, spark.createDataFrame([(1, 1, 0.0, -1.0, 20.0, -1.0, True)], CHANGE))
    assert ends(alone)[1] == (0.0, -1.0, 20.0, -1.0) and ends(alone)[2] == ends(draft)[2] and rings(alone) == rings(draft)


@pytest.mark.parametrize("to", [(0.0, 0.0, 10.0, 0.0), (1.0, 1.0, 1.005, 1.0), (float("nan"), 0.0, 1.0, 0.0), (0.0, float("inf"), 1.0, 0.0)])
def test_changes_that_do_nothing(spark, draft, to):
    out = wall_moves.reshaped(draft, spark.createDataFrame([(1, 1, *to, False)], CHANGE))
    assert ends(out) == ends(draft) and rings(out) == rings(draft) and {r.element_id: r.accepted for r in out.elements.collect()}[1]


def test_a_moved_selection(spark, draft):
    picked = [(1, "wall", 1, 0.0, 2.0), (2, "space", 2, 1.0, 1.0), (1, "element", 1, 0.0, 2.0), (1, "wall", 2, float("nan"), 2.0)]
    out = wall_moves.moved(draft, spark.createDataFrame(picked, "plane_id long, kind string, id long, dx double, dy double"))
    assert ends(out) == {1: (0.0, 2.0, 10.0, 2.0), 2: (10.0, 2.05, 10.0, 5.0), 3: (5.0, -0.3, 5.0, -4.0), 4: (0.0, 0.0, 10.0, 0.0)}
    assert rings(out) == {1: [(0.0, 2.0), (10.0, 2.0), (10.0, 5.0), (0.0, 5.0)], 2: [(1.0, 1.0), (11.0, 1.0), (11.0, 6.0), (1.0, 6.0)]}
    e = {r.element_id: r for r in out.elements.collect()}
    assert (e[1].y, tuple(e[1].support)) == (2.4, (4.0, 2.0, 6.0, 2.0)) and (e[2].y, e[2].support) == (3.0, None)
