"""Bulk changes and scores of drafts against plain versions on small fixtures."""

import math
import random

from pyspark.sql import functions as F

from atrium.operators import bulk, imdf, joints, maintain, places, score


def test_matched_points_walk_the_truth_in_order(spark):
    rng = random.Random(5)
    truth = [(k % 3, k, k, rng.uniform(0, 6), rng.uniform(0, 6)) for k in range(90)]
    seen = [(k % 3, k, rng.uniform(0, 6), rng.uniform(0, 6)) for k in range(120)]
    expected, used = set(), set()
    for plan, key, _, x, y in truth:
        near = [(math.sqrt((x - px) ** 2 + (y - py) ** 2), k) for q, k, px, py in seen if q == plan and k not in used]
        near = [n for n in near if n[0] <= 0.8]
        if near:
            used.add(min(near)[1])
            expected.add((key, min(near)[1]))
    got = score.matched_points(spark.createDataFrame(seen, "plan_id int, point_id int, x double, y double"), spark.createDataFrame(truth, "plan_id int, truth_id int, ord int, x double, y double"), 0.8)
    assert {(r.truth_id, r.point_id) for r in got.collect()} == expected and len(expected) > 40


def test_matched_points_of_empty_tables(spark):
    none = spark.createDataFrame([], "plan_id int, point_id int, x double, y double")
    truth = spark.createDataFrame([(1, 1, 1, 0.0, 0.0)], "plan_id int, truth_id int, ord int, x double, y double")
    assert score.matched_points(none, truth, 1.0).count() == 0


def test_links_are_as_if_requested_one_by_one(spark):
    nodes = [(k, k % 2, float(k), 0.0) for k in range(12)]
    links = [("a", 0, 2, "stairs", 2.0), ("b", 4, 6, "stairs", 2.0), ("c", 8, 10, "stairs", 2.0)]
    asked = [(1, 0, 4, "elevator"), (2, 2, 0, "elevator"), (3, 8, None, "elevator"), (4, 1, 2, "elevator"), (5, 99, 10, "elevator"), (6, 3, 5, "stairs")]
    building = {k: b for k, b, _, _ in nodes}
    state = {e: (x, y) for e, x, y, _, _ in links}
    for order, node, target, _ in asked:
        if node not in building:
            continue
        known = target in building and building[target] == building[node]
        ends = {node, target} if known else {node}
        state = {e: xy for e, xy in state.items() if not ends & set(xy)}
        if known:
            state[f"link-{order}"] = (node, target)
    got = bulk.linked_nodes(
        spark.createDataFrame(links, "edge_id string, from_id int, to_id int, type string, distance double"),
        spark.createDataFrame(nodes, "node_id int, building_id int, x double, y double"),
        spark.createDataFrame(asked, "ord int, node_id int, target_id int, type string"),
    )
    assert {r.edge_id: (r.from_id, r.to_id) for r in got.collect()} == state


def test_drawn_walks_lift_the_pen_on_a_second_click(spark):
    nodes = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 5.0, 0.0)], "plane_id int, node_id int, x double, y double")
    way = [("p", 1, 1, 0.1, 0.0), ("p", 2, 1, 0.0, 0.1), ("p", 3, 1, 5.0, 0.0), ("p", 4, 1, 9.0, 0.0), ("q", 1, 1, 9.0, 0.0), ("q", 2, 1, 5.1, 0.0)]
    new, edges = bulk.drawn_walks(spark.createDataFrame(way, "path_id string, ord int, plane_id int, x double, y double"), nodes, 0.5)
    assert [(r.x, r.y) for r in new.collect()] == [(9.0, 0.0)]
    found = {(r.path_id, r.from_id, r.to_id, r.distance) for r in edges.collect()}
    assert found == {("p", "2", "new/1/9.0/0.0", 4.0), ("q", "new/1/9.0/0.0", "2", 4.0)}


def test_ladders_need_four_strokes_in_a_row(spark):
    row = lambda plan, k, at: (plan, k, "horizontal", float(at), 0.0, 40.0, 1.0)
    strokes = [row(1, k, 10 * k) for k in range(4)] + [row(2, k, 10 * k) for k in range(3)] + [row(3, k, at) for k, at in enumerate((0, 10, 20, 45, 49))]
    got = joints.ladders(spark.createDataFrame(strokes, "plan_id int, stroke_id int, orientation string, offset_px double, start_px double, end_px double, thickness_px double"), 8.0, 30.0)
    assert {(r.plan_id, r.stroke_id) for r in got.collect()} == {(1, 0), (1, 1), (1, 2), (1, 3)}


def test_labels_prefer_translations_and_drop_blanks(spark):
    df = spark.sql("select * from values (1, ' Hall ', map('ko', ' 홀 ', 'fr', ' ')), (2, 'Hall', map('en', 'Lobby')), (3, '  ', null), (4, null, map('en', 'X')) as t(id, name, names)")
    got = {r.id: r.m for r in df.select("id", imdf.labels(F.col("name"), F.col("names"), "en").alias("m")).collect()}
    assert got == {1: {"ko": "홀", "en": "Hall"}, 2: {"en": "Lobby"}, 3: None, 4: {"en": "X"}}


def test_accepted_flags_and_defaults(spark):
    entries = spark.createDataFrame([(1, False), (2, False), (3, True)], "entry_id int, accepted boolean")
    ids = spark.createDataFrame([(2,), (2,), (7,)], "entry_id int")
    assert sorted(tuple(r) for r in bulk.accepted(entries, ids).collect()) == [(1, False), (2, True), (3, True)]
    stops = spark.createDataFrame([("ramp", None), ("stairs", True), ("stairs", None)], "type string, accessible boolean")
    assert [r.accessible for r in bulk.with_defaults(stops, "connector").collect()] == [True, True, False]


def test_groups_stops_and_kinds(spark):
    members = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (2, "b", 1)], "group_id int, member_id string, ord int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {(r.id, r.group_id) for r in places.group_of(members, asked).collect()} == {("a", 2), ("b", 2)}
    assert [r.group_id for r in maintain.ungrouped(members, spark.createDataFrame([(2,)], "group_id int")).collect()] == [1]
    stops = spark.createDataFrame([(1, 10), (1, 11)], "connector_id int, node_id int")
    assert [r.node_id for r in maintain.without_stops(stops, spark.createDataFrame([(10,)], "node_id int")).collect()] == [11]
