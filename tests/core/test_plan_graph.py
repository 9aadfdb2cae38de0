"""Plan graphs: joints, snapping, chains of stubs, straight walls, faces with a hole and a dangling wall."""

from __future__ import annotations

import math

import pytest

from atrium.operators import plan_graph

STROKE = "plan_id long, stroke_id long, orientation string, offset_px double, start_px double, end_px double, thickness_px double"


def h(i, y, x0, x1, t=4.0, plan=1):
    return (plan, i, "horizontal", float(y), float(x0), float(x1), float(t))


def v(i, x, y0, y1, t=4.0, plan=1):
    return (plan, i, "vertical", float(x), float(y0), float(y1), float(t))


def spans(edges):
    return sorted((round(r.ax, 3), round(r.ay, 3), round(r.bx, 3), round(r.by, 3)) for r in edges.collect())


def graph(spark, strokes):
    return plan_graph.planar_graph(spark.createDataFrame(strokes, STROKE))


def test_joints_of_all_kinds(spark):
    cross = graph(spark, [h(1, 50, 0, 100), v(2, 50, 0, 100)])
    assert spans(cross) == [(0, 50, 50, 50), (50, 0, 50, 50), (50, 50, 50, 100), (50, 50, 100, 50)]
    tee = graph(spark, [h(1, 0, 0, 100), v(2, 40, 2, 60)])  # two pixels short
    assert spans(tee) == [(0, 0, 40, 0.667), (40, 0.667, 40, 60), (40, 0.667, 100, 0)]  # the middle of two ends and one
    corner = graph(spark, [h(1, 0, 0, 100), v(2, 0, 0, 80), h(3, 0, 0, 100, plan=2)])
    assert [r.plan_id for r in corner.orderBy("plan_id").collect()] == [1, 1, 2]
    assert graph(spark, [h(1, 0, 0, 2)]).collect() == []  # both ends are one node
    assert graph(spark, []).collect() == []


def test_equal_edges_are_one_and_the_first_stroke_stays(spark):
    twice = graph(spark, [h(2, 0, 0, 100, 6), h(1, 1, 0, 100, 9), v(3, 0, 0, 50)])
    found = twice.orderBy("bx").collect()
    assert len(found) == 2 and found[1].thickness_px == 9


def test_chains_of_stubs_and_loose_pieces_go(spark):
    room = [h(1, 0, 0, 100), h(2, 100, 0, 100), v(3, 0, 0, 100), v(4, 100, 0, 100)]
    stubs = [h(5, 50, 100, 106), v(6, 106, 50, 55), h(7, 55, 106, 111)]  # three in a row, each short
    far = [h(8, 300, 300, 310), h(9, 400, 300, 390)]
    stay, gone = plan_graph.pruned(graph(spark, room + stubs + far), stub=8, least=20, share=0.1)
    assert spans(stay) == [(0, 0, 0, 100), (0, 0, 100, 0), (0, 100, 100, 100), (100, 0, 100, 50), (100, 50, 100, 100), (300, 400, 390, 400)]
    assert spans(gone) == [(300, 300, 310, 300)]
    stay, gone = plan_graph.pruned(graph(spark, room + far), stub=8, least=20, share=0.5)
    assert spans(gone) == [(300, 300, 310, 300), (300, 400, 390, 400)]


def test_walls_go_straight_on_through_joints(spark):
    walls = plan_graph.straight_walls(graph(spark, [h(1, 0, 0, 100, 4), v(2, 40, 0, 60, 6), h(3, 0, 100, 130, 8), v(4, 130, 0, 1.5)])).collect()
    long, upright = sorted(walls, key=lambda w: w.by)
    assert (long.ax, long.bx, long.edges) == (0, pytest.approx(130, abs=1), 3) and upright.edges == 1
    assert long.thickness_px == pytest.approx((4 * 100 + 8 * 30) / 130, rel=0.02)


def rooms(spark, strokes, least=50.0):
    found = plan_graph.rooms(plan_graph.faces(graph(spark, strokes)), least).collect()
    by_face = {}
    for r in found:
        by_face.setdefault((r.plan_id, r.face), []).append(r)
    for corners in by_face.values():  # places follow each other around the face
        corners.sort(key=lambda r: r.place)
        assert [r.place for r in corners] == list(range(len(corners)))
        ring = [(r.x, r.y) for r in corners]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        assert math.isclose(abs(area), corners[0].area)
    return sorted((c[0].plan_id, len(c), c[0].area) for c in by_face.values())


def test_rooms_are_faces_without_the_outer_one_and_slivers(spark):
    two = [h(1, 0, 0, 200), h(2, 100, 0, 200), v(3, 0, 0, 100), v(4, 100, 0, 100), v(5, 200, 0, 100)]
    assert rooms(spark, two) == [(1, 4, 10_000), (1, 4, 10_000)]
    assert rooms(spark, [*two, v(6, 104, 0, 100)], least=500) == [(1, 4, 9_600), (1, 4, 10_000)]  # a sliver of 4 x 100 goes
    alone = [h(1, 0, 0, 10, plan=7), h(2, 10, 0, 10, plan=7), v(3, 0, 0, 10, plan=7), v(4, 10, 0, 10, plan=7)]
    assert rooms(spark, alone) == [(7, 4, 100)]  # inner and outer face are equally large


def test_a_dangling_wall_and_a_hole(spark):
    outer = [h(1, 0, 0, 200), h(2, 100, 0, 200), v(3, 0, 0, 100), v(4, 200, 0, 100)]
    assert rooms(spark, [*outer, v(5, 50, 0, 40)]) == [(1, 7, 20_000)]  # the dangling wall is walked both ways
    inner = [h(6, 40, 60, 120), h(7, 80, 60, 120), v(8, 60, 40, 80), v(9, 120, 40, 80)]
    # a piece of its own has an inner face and one around it
    assert rooms(spark, outer + inner) == [(1, 4, 2_400), (1, 4, 2_400), (1, 4, 20_000)]


def test_long_rings_and_many_plans(spark):
    strokes = []
    for plan in range(3):
        for k in range(40):
            strokes += [h(k, 0, k * 20, k * 20 + 20, plan=plan), h(100 + k, 50, k * 20, k * 20 + 20, plan=plan)]
        strokes += [v(200, 0, 0, 50, plan=plan), v(201, 800, 0, 50, plan=plan)]
    assert rooms(spark, strokes) == [(p, 82, 40_000) for p in range(3)]


def test_strokes_of_one_line_are_united(spark):
    from atrium.operators import draft

    strokes = [h(1, 10, 0, 99, 4), h(2, 12, 100, 149, 2), h(3, 11, 300, 320), h(4, 20, 0, 50), h(5, 10, 0, 50, plan=2), h(6, 11.6, 0, 50, 1, plan=2), v(7, 10, 0, 99)]
    found = draft.united(spark.createDataFrame(strokes, STROKE), 5.0).collect()
    got = sorted((r.plan_id, r.orientation, round(r.offset_px, 4), r.start_px, r.end_px, r.thickness_px, r.strokes) for r in found)
    assert got == [(1, "horizontal", round((10 * 100 + 12 * 50) / 150, 4), 0, 149, 4, 2), (1, "horizontal", 11, 300, 320, 4, 1), (1, "horizontal", 20, 0, 50, 4, 1), (1, "vertical", 10, 0, 99, 4, 1), (2, "horizontal", 10.8, 0, 50, 4, 2)]
