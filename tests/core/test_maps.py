"""Geometry, joins, rules, routing and documents on literal rows."""

from __future__ import annotations

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from atrium.functions import geom, text
from atrium.operators import draft, graph, maintain, places, routing, spatial, trips, validate
from atrium.sources import documents
from atrium.streaming import guidance, rules

RING = "array<struct<x:double,y:double>>"
L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
BOX = [(0, 0), (4, 0), (4, 4), (0, 4)]


def rings(spark, *shapes):
    rows = [(i, [(float(x), float(y)) for x, y in s]) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, f"id int, p {RING}").orderBy("id")


def test_measures(spark):
    df = rings(spark, L_SHAPE, BOX, BOX[::-1], [(0, 0), (1, 1)], [], [(0, 0), (2, 2), (2, 0), (0, 2)])
    p = F.col("p")
    got = df.select(geom.signed_area(p), geom.centroid(p), geom.self_crossing(p), geom.box(p), geom.oriented(p)).collect()
    assert [r[0] for r in got] == [12.0, 16.0, -16.0, 0.0, 0.0, 0.0]
    assert (round(got[0][1].x, 6), round(got[0][1].y, 6)) == (1.666667, 1.666667) and tuple(got[4][1]) == (0.0, 0.0) and tuple(got[3][1]) == (0.5, 0.5)
    assert [r[2] for r in got] == [False, False, False, False, False, True]
    assert tuple(got[4][3]) == (0.0, 0.0, 0.0, 0.0) and got[2][4] == got[2][4][:-1] + [got[2][4][0]]


def test_inside_and_distance(spark):
    df = rings(spark, L_SHAPE)
    at = lambda x, y: geom.inside(F.lit(float(x)), F.lit(float(y)), F.col("p"))
    assert tuple(df.select(at(1, 1), at(3, 3), at(3, 1), at(9, 1)).first()) == (True, False, True, False)
    near = df.select(geom.nearest_on_ring(F.lit(3.0), F.lit(3.0), F.col("p"))).first()[0]
    assert near.distance == 1.0
    assert df.select(geom.distance_to_segment(*[F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)])).first()[0] == 5.0


def test_hull_and_frames(spark):
    points = [(0, 0), (4, 0), (2, 0), (4, 4), (0, 4), (2, 2), (0, 2), (4, 4)]
    got = rings(spark, points, [(1, 1)], [(0, 0), (1, 0), (2, 0)]).select(geom.hull(F.col("p"))).collect()
    assert [tuple(p) for p in got[0][0]] == [(0, 0), (4, 0), (4, 4), (0, 4)] and len(got[1][0]) == 1 and len(got[2][0]) == 2
    one = spark.range(1).select(geom.to_site(*[F.lit(v) for v in (0.0, 10.0, 5.0, 7.0, 90.0)])).first()[0]
    assert (round(one.x, 9), round(one.y, 9)) == (15.0, 7.0)
    assert spark.range(1).select(geom.to_lng_lat(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None


@pytest.mark.parametrize(("a", "ah", "b", "bh", "area"), [
    (BOX, [], BOX, [], 16.0), (BOX, [], [(4, 0), (8, 0), (8, 4), (4, 4)], [], 0.0), (L_SHAPE, [], [(2, 2), (4, 2), (4, 4), (2, 4)], [], 0.0),
    (BOX, [[(1, 1), (3, 1), (3, 3), (1, 3)]], [(1, 1), (3, 1), (3, 3), (1, 3)], [], 0.0), (BOX, [], [(0, 0), (4, 0), (2, 4)], [], 8.0), (L_SHAPE, [], BOX, [], 12.0),
])
def test_overlap_area(spark, a, ah, b, bh, area):
    f = lambda s: [(float(x), float(y)) for x, y in s]
    df = spark.createDataFrame([(f(a), [f(h) for h in ah], f(b), [f(h) for h in bh])], f"a {RING}, ah array<{RING}>, b {RING}, bh array<{RING}>")
    assert df.select(spatial.overlap_area(*[F.col(c) for c in ("a", "ah", "b", "bh")])).first()[0] == pytest.approx(area, abs=1e-9)


def test_routes_against_dijkstra(spark):
    rng = random.Random(4)
    edges = [(f"e{i}", rng.randrange(40), rng.randrange(40), rng.choice(["walk", "stairs", "elevator"]), rng.random() * 9, rng.random() < 0.8, rng.random() < 0.2, None) for i in range(90)]
    e = spark.createDataFrame(edges, "edge_id string, from_id long, to_id long, type string, distance double, accessible boolean, one_way boolean, duration double")
    nodes = spark.range(40).withColumnRenamed("id", "node_id")
    for options in ({}, {"require_accessible": True}, {"avoid_stairs": True}):
        adjacent = graph.passable(graph.adjacency(e, nodes), **options)
        rows = adjacent.collect()
        got = {(r.search_id, r.node): r.weight for r in routing.searches(spark.createDataFrame([(s, s, 0.0) for s in (0, 7)], "search_id long, node long, extra double"), adjacent).collect()}
        want = {}
        for s in (0, 7):
            heap, done = [(0.0, s)], {}
            while heap:
                d, n = heapq.heappop(heap)
                if n in done:
                    continue
                done[n] = d
                for r in rows:
                    if r.src == n:
                        heapq.heappush(heap, (d + r.weight, r.dst))
            want |= {(s, n): d for n, d in done.items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_path_walk_back(spark):
    e = spark.createDataFrame([("a", 1, 2, "walk", 12.0, True, False, None), ("b", 2, 3, "walk", 12.0, True, False, None), ("c", 1, 3, "walk", 99.0, True, False, None)], "edge_id string, from_id long, to_id long, type string, distance double, accessible boolean, one_way boolean, duration double")
    settled = routing.searches(spark.createDataFrame([(1, 1, 0.5)], "search_id long, node long, extra double"), graph.adjacency(e, spark.range(5).withColumnRenamed("id", "node_id")))
    goals = spark.createDataFrame([(10, 1, 3, 2.0), (11, 1, 4, 0.0)], "query_id long, search_id long, node long, extra double")
    found = routing.routes(settled, goals)
    r = {x.query_id: x for x in found.collect()}
    assert r[10].weight == pytest.approx(22.5) and r[10].metres == 24.0 and r[11].weight is None
    steps = sorted((x.ord, x.node, x.edge_id) for x in routing.paths(settled, found).collect())
    assert steps == [(0, 1, None), (1, 2, "a"), (2, 3, "b")]


def test_search_scores(spark):
    df = spark.createDataFrame([("바다도서관 열람실", "바다도서관열람실"), ("바다도서관 열람실", "바다"), ("바다도서관 열람실", "열람"), ("바다도서관 열람실", "도서"), ("바다도서관 열람실", "ㅂㄷㄷ"), ("Sea Library", "gym"), ("ＡＢＣ", "abc"), (None, "x"), ("", "x")], "c string, q string")
    assert [r[0] for r in df.select(text.score(F.col("c"), F.col("q"))).collect()] == [100, 80, 60, 40, 30, 0, 100, 0, 0]
    names = spark.createDataFrame([({"ko": "가", "en": ""}, "plain")], "n map<string,string>, m string")
    assert tuple(names.select(*[text.localized(F.col("n"), F.col("m"), F.lit(t)) for t in ("ko-KR", "ko", "en", "fr")]).first()) == ("가", "가", "plain", "plain")


def test_ground_floor(spark):
    rows = [(1, "a", -1.0, 0), (1, "b", 2.0, 1), (1, "c", 3.0, 2), (2, "d", 0.0, 0), (2, "e", 1.0, 1), (3, "f", -2.0, 0), (3, "g", -1.0, 1)]
    got = places.ground_floors(spark.createDataFrame(rows, "building_id long, plane_id string, level double, ord int")).collect()
    assert {r.building_id: r.plane_id for r in got} == {1: "b", 2: "e", 3: "f"}


TRACE = [(10, 2, 0), (10, 30, 0), (12, 31, 0), (20, 1, 0), (20, 25, 20), (20, 30, 0), (38, 1, 0), (39, 0, 0)]


def guide(spark):
    pings = spark.createDataFrame([("r", i, i, "f", float(x), float(y), float(a)) for i, (x, y, a) in enumerate(TRACE)], "key string, ping_id int, t long, plane_id string, x double, y double, accuracy double").withColumn("ts", F.timestamp_seconds("t"))
    seg = F.struct(*[F.lit(v).alias(n) for v, n in ((0.0, "ax"), (0.0, "ay"), (40.0, "bx"), (0.0, "by"))])
    routes = spark.range(1).select(F.lit("r").alias("key"), F.lit("f").alias("plane_id"), F.array(seg).alias("segments"), F.struct(F.lit(40.0).alias("x"), F.lit(0.0).alias("y")).alias("end"))
    return pings, routes


WANT = [(1, "route.offRoute", 30.0), (5, "route.offRoute", 30.0), (6, "route.arrived", None)]


def test_guidance_batch(spark):
    got = sorted((r.ping_id, r.kind, r.distance) for r in guidance.alerts(*guide(spark)).collect())
    assert got == WANT


def test_guidance_stream_equals_batch(spark, tmp_path):
    pings, routes = guide(spark)
    pings.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pings.schema).parquet(f"{tmp_path}/in")
    q = guidance.alert_stream(stream, routes).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.ping_id, r.kind, r.distance) for r in spark.sql("select * from alerts").collect()) == WANT


def test_rules(spark):
    events = spark.createDataFrame([(1, "click", '{"k": 60, "p": {"s": "a"}}'), (2, "click", '{"k": "60"}'), (3, "view", "{}")], "event_id long, event string, payload string")
    cond = "array<struct<field:string,operator:string,value:string>>"
    rows = [(1, "click", [("k", "gt", "50")], ["open"]), (2, "click", [("p.s", "in", '["a", "b"]')], ["x", "y"]), (3, "view", [], ["always"]), (4, "click", [("k", "between", "1")], ["never"]), (5, "click", [("k", "equals", "60")], ["strict"])]
    table = spark.createDataFrame(rows, f"rule_id int, event string, conditions {cond}, actions array<string>")
    got = sorted((r.event_id, r.rule_id, r.ord, r.action) for r in rules.matched(events, table).collect())
    assert [g for g in got if g[0] == 2] == []  # the string "60" is neither over 50 nor equal to 60
    assert (1, 1, 0, "open") in got and (1, 5, 0, "strict") in got and (3, 3, 0, "always") in got and (1, 2, 1, "y") in got and not [g for g in got if g[1] == 4]
    bad = {(r.rule_id, r.problem) for r in rules.lint(table, ("click",), ("open", "x", "y", "strict", "never")).collect()}
    assert bad == {(3, "unknown event view"), (3, "unknown action"), (4, "unknown operator")}


def test_trip_points(spark):
    pts = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 0), (3, 0), (3, 4)])], "path_id long, ord int, x double, y double")
    m = trips.arc_lengths(pts)
    assert sorted(r.along for r in m.collect()) == [0.0, 3.0, 7.0]
    asked = spark.createDataFrame([(1, 1, 1.5), (2, 1, 5.0), (3, 1, 99.0), (4, 1, -1.0)], "ask_id long, path_id long, metres double")
    got = {r.ask_id: (r.x, r.y, r.dx, r.dy) for r in trips.places_along(m, asked).collect()}
    assert got == {1: (1.5, 0.0, 1.0, 0.0), 2: (3.0, 2.0, 0.0, 1.0), 3: (3.0, 4.0, 0.0, 1.0), 4: (0.0, 0.0, 1.0, 0.0)}
    assert trips.densified(m, 2.0).count() == 5


def test_draft_fringe_and_fuse(spark):
    rows = [(1, 1, "h", 100.0, 0.0, 99.0, 6.0), (2, 1, "h", 104.0, 10.0, 30.0, 1.0), (3, 1, "h", 140.0, 10.0, 30.0, 1.0), (4, 1, "h", 140.0, 32.0, 50.0, 2.0)]
    s = spark.createDataFrame(rows, "stroke_id long, plan_id long, orientation string, offset_px double, start_px double, end_px double, thickness_px double")
    assert sorted(r.stroke_id for r in draft.without_fringes(s, 1.0).collect()) == [1, 3, 4]
    assert sorted((r.start_px, r.end_px, r.strokes) for r in draft.fused(s, 2.0).collect()) == [(0.0, 99.0, 1), (10.0, 30.0, 1), (10.0, 50.0, 2)]


def test_groups_and_stops(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "d"), ("h", "e"), ("one", "z")], "group_id string, member_id string")
    gone = spark.createDataFrame([("poi", "a"), ("poi", "c")], "kind string, id string")
    assert sorted((r.group_id, r.member_id) for r in maintain.stripped_groups(members, gone).collect()) == [("h", "d"), ("h", "e"), ("one", "z")]
    asked = spark.createDataFrame([("n", "x"), ("n", "y"), ("m", "a"), ("m", "q")], "group_id string, member_id string")
    assert [(r.group_id, r.members) for r in maintain.new_groups(asked, members).collect()] == [("n", ["x", "y"])]


def project(**more):
    nav = {"nodes": [{"id": "n1", "position": {"x": 1, "y": 1}, "type": "normal"}, {"id": "n2", "position": {"x": 2, "y": 1}, "type": "normal"}], "edges": [{"id": "e1", "from": "n1", "to": "n2", "distance": 1}]}
    floor = {"id": "f1", "name": "1F", "level": 1, "elevation": 0, "spaces": [{"id": "s1", "floorId": "f1", "polygon": [{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 4}], "type": "room", "height": 3, "properties": {"name": "A"}}], "walls": [], "entrances": [], "pois": [], "navigation": nav}
    return {"schemaVersion": "1.1.0", "id": "p", "name": "P", "buildings": [{"id": "b", "name": "B", "floors": [floor]}]} | more


def test_documents(spark, tmp_path):
    bad_edge = json.loads(json.dumps(project(id="q")))
    bad_edge["buildings"][0]["floors"][0]["navigation"]["edges"][0]["distance"] = -1
    bad_edge["buildings"][0]["floors"][0]["navigation"]["nodes"][1]["id"] = "n1"
    docs = [project(), project(id="old", schemaVersion="1.0.0"), project(id="new", schemaVersion="2.0.0"), project(id="odd", schemaVersion="x"), project(id="gap", schemaVersion="0.9.0"), bad_edge]
    (tmp_path / "d.json").write_text("\n".join([*map(json.dumps, docs), "not json"]))
    read = documents.gated(documents.read(spark, f"file://{tmp_path}/d.json"))
    assert sorted(r.refused for r in read.filter("refused is not null").collect()) == ["bad-version", "newer-version", "no-migration", "not-a-document"]
    assert {(r.project_id, r.reason) for r in documents.faults(read).collect()} == {("q", "edge distance"), ("q", "repeated id of a node")}
    good = documents.accepted(read)
    tables = documents.flattened(good)
    assert sorted(r.project_id for r in tables["spaces"].collect()) == ["old", "p"]
    edge = tables["edges"].filter("project_id = 'p'").first()
    assert edge.type == "walk" and edge.accessible and not edge.one_way
    again = documents.parsed(documents.written_back(good))
    assert sorted(r[0] for r in again.select("doc.schemaVersion").collect()) == ["1.1.0", "1.1.0"]


def test_validation_literals(spark):
    s = rings(spark, [(0, 0), (1, 0)], [(0, 0), (2, 2), (2, 0), (0, 2)], BOX).select(F.col("id").alias("space_id"), F.lit("f").alias("plane_id"), F.col("id").alias("ord"), F.lit("unknown").alias("type"), F.col("p").alias("polygon"), F.array().cast(f"array<{RING}>").alias("holes"))
    assert [r.object_id for r in validate.too_few_vertices(s).collect()] == ["0"]
    assert [r.object_id for r in validate.self_intersecting(s).collect()] == ["1"]
    e = spark.createDataFrame([(1, -1.0, 3.5), (2, 0.9, 5.0), (3, None, None), (4, float("nan"), None)], "entrance_id int, width double, step_count double")
    assert sorted((r.object_id, r.message) for r in validate.dimensions(e).collect()) == [("1", "step_count"), ("1", "width"), ("4", "width")]
