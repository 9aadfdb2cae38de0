"""Doors measure the outlines of rooms whose box is in reach, once each."""

import math

from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import bulk


def test_only_rooms_in_reach_are_measured_once(spark, monkeypatch):
    box = lambda x, y: [(x, y), (x + 0.9, y), (x + 0.9, y + 0.9), (x, y + 0.9)]
    rooms = [(i * 4 + j, 1, i * 4 + j, [{"x": x, "y": y} for x, y in box(0.05 + i, 0.05 + j)]) for i in range(4) for j in range(4)]
    spaces = spark.createDataFrame(rooms, "space_id long, plane_id long, ord long, polygon array<struct<x:double,y:double>>")
    doors = spark.createDataFrame([(7, 1, 1.0, 0.5), (8, 1, 3.5, 3.97), (9, 1, 40.0, 40.0)], "entrance_id long, plane_id long, x double, y double")
    calls = spark.sparkContext.accumulator(0)

    def distance(x, y, ring):
        calls.add(1)
        sides = [abs(y - ring[0].y), abs(y - ring[2].y)] if ring[0].x <= x <= ring[2].x else []
        sides += [abs(x - ring[0].x), abs(x - ring[2].x)] if ring[0].y <= y <= ring[2].y else []
        return min([*sides, *(math.hypot(x - p.x, y - p.y) for p in ring)])

    measured = F.udf(distance, "double").asNondeterministic()
    want = sorted(tuple(r) for r in bulk.door_sides(doors, spaces, 0.1).collect())
    monkeypatch.setattr(geom, "distance_to_ring", lambda x, y, ring: measured(x, y, ring))
    assert sorted(tuple(r) for r in bulk.door_sides(doors, spaces, 0.1).collect()) == want == [(7, 0, 4), (8, 15, None), (9, None, None)]
    assert calls.value == 3
