"""Strict conditions, folded names, host walls, stairs across paths, nearest nodes far away, and solid wall panels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from atrium.functions import geom, text
from atrium.operators import graph, spatial, validate
from atrium.streaming import rules

COND = "array<struct<field:string,operator:string,value:string>>"


@pytest.mark.parametrize(
    ("payload", "condition", "want"),
    [
        ('{"k": 60}', ("k", "equals", "60"), True), ('{"k": "60"}', ("k", "equals", "60"), False), ('{"k": "60"}', ("k", "gt", "50"), False), ('{"k": 60.0}', ("k", "equals", "60"), True),
        ('{"k": "60"}', ("k", "notIn", "60x"), False), ('{"k": "a, b"}', ("k", "in", '["a, b"]'), True), ('{"k": "a"}', ("k", "in", '["a, b"]'), False), ("{}", ("k", "notEquals", "1"), True),
        ("{}", ("k", "equals", "null"), False), ('{"k": null}', ("k", "equals", "null"), True), ('{"k": [1]}', ("k", "equals", "[1]"), False), ('{"a": {"b": true}}', ("a.b", "equals", "true"), True),
        ("no json", ("k", "notIn", "[1]"), True), (None, ("k", "gt", "1"), False), ('{"k": 2}', ("k", "near", "2"), False),
    ],
)
def test_conditions_agree_by_kind(spark, payload, condition, want):
    e = spark.createDataFrame([(1, "click", payload)], "event_id long, event string, payload string")
    rule = spark.createDataFrame([(1, "click", [condition], ["go"])], f"rule_id int, event string, conditions {COND}, actions array<string>")
    assert (rules.matched(e, rule).count() == 1) is want
    assert (rules.matched(e, rule, most_broadcast=0).count() == 1) is want


def test_names_are_folded(spark):
    df = spark.createDataFrame([("ｶﾌｪ",), ("ﬁne Tea",), ("étage",), ("ＡＢ　c",), ("ㅋㅍ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalized(text.fold(F.col("t")))).collect()] == ["カフェ", "finetea", "étage", "abc", "ㅋㅍ", None]


def test_host_walls_by_name_and_reach(spark):
    walls = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0, 0.2, None), (2, 1, 0.0, 0.0, 0.0, 10.0, 3.0, 2.0)], "wall_id long, plane_id long, sx double, sy double, ex double, ey double, thickness double, height double")
    rows = [
        (1, 1, None, 5.0, 0.1, "door", 0.9, None), (2, 1, 1, 5.0, 30.0, "door", 0.9, None), (3, 1, 77, 5.0, 0.0, "door", 0.9, None), (4, 1, None, 1.6, 5.0, "window", None, None), (5, 1, 1, 10.2, 0.0, "door", 1.0, 9.0),
        (6, 1, None, 5.0, 0.0, "elevator", 0.9, None),
    ]
    openings = spark.createDataFrame(rows, "entrance_id long, plane_id long, wall_id long, x double, y double, type string, width double, height double")
    got = {r.entrance_id: (r.wall_id, round(r["from"], 6), round(r["to"], 6), r.bottom, round(r.top, 6)) for r in spatial.host_walls(openings, walls).collect()}
    assert got == {1: (1, 4.55, 5.45, 0.0, 2.1), 4: (2, 4.4, 5.6, 0.9, 2.0), 5: (1, 9.5, 10.0, 0.0, 2.4)}


def test_stairs_close_the_walks_over_them(spark):
    nodes = spark.createDataFrame([(i, 1, x, y, t) for i, x, y, t in [(1, 0.0, 0.0, "normal"), (2, 10.0, 0.0, "normal"), (3, 0.0, 5.0, "stairs"), (4, 10.0, 5.0, "stairs"), (5, 3.0, 0.0, "normal")]], "node_id long, plane_id long, x double, y double, type string")
    edges = spark.createDataFrame([("a", 1, 1, 2, "walk", True), ("b", 1, 3, 4, "walk", True), ("c", 1, 1, 5, "walk", True), ("d", 1, 1, 2, "elevator", True)], "edge_id string, plane_id long, from_id long, to_id long, type string, accessible boolean")
    stairs = spark.createDataFrame([(9, 1, 5.0, 0.0, "escalator", 0.0), (10, 1, 50.0, 0.0, "stairs", 90.0)], "entrance_id long, plane_id long, x double, y double, type string, rotation double")
    square = [(20.0, 20.0), (21.0, 20.0), (21.0, 21.0)]
    spaces = spark.createDataFrame([(1, 0, "stairs", square)], "plane_id long, ord long, type string, polygon array<struct<x:double,y:double>>")
    feet = graph.climb_footprints(stairs, spaces)
    assert feet.count() == 3
    got = {r.edge_id: (r.type, r.accessible) for r in graph.climbing_edges(edges, nodes, feet).collect()}
    assert got == {"a": ("escalator", False), "b": ("stairs", False), "c": ("walk", True), "d": ("elevator", True)}


def test_nearest_node_far_away_and_ties(spark):
    nodes = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 2.0, 0.0), (3, 2, 90_000.0, 0.0)], "node_id long, plane_id long, x double, y double")
    points = spark.createDataFrame([(1, 1, 1.0, 0.0), (2, 1, -300.0, 0.0), (3, 2, 0.0, 0.0), (4, 3, 0.0, 0.0)], "id long, plane_id long, x double, y double")
    assert sorted(map(tuple, spatial.nearest_node(points, nodes, "id").collect())) == [(1, 1, 1.0), (2, 1, 300.0), (3, 3, 90_000.0)]


def test_floors_linked_by_stair_edges(spark):
    floors = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "plane_id long, building_id long")
    stops = spark.createDataFrame([], "connector_id long, plane_id long, space_id long")
    nodes = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "node_id long, plane_id long")
    edges = spark.createDataFrame([(1, 2, "stairs"), (2, 3, "walk")], "from_id long, to_id long, type string")
    assert [r.object_id for r in validate.unconnected_floors(floors, stops, edges, nodes).collect()] in ([3], ["3"])


def test_panels_leave_sills_and_lintels(spark):
    hole = "struct<from:double,to:double,bottom:double,top:double>"
    df = spark.createDataFrame([(4.0, 3.0, [(1.0, 2.0, 1.0, 2.0)]), (4.0, 3.0, []), (4.0, 2.0, [(0.0, 4.0, 0.0, 2.0)])], f"l double, h double, o array<{hole}>")
    got = [[tuple(p) for p in r[0]] for r in df.select(geom.wall_panels(F.col("l"), F.col("h"), F.col("o"))).collect()]
    assert got == [[(0.0, 1.0, 0.0, 3.0), (1.0, 2.0, 0.0, 1.0), (1.0, 2.0, 2.0, 3.0), (2.0, 4.0, 0.0, 3.0)], [(0.0, 4.0, 0.0, 3.0)], []]
