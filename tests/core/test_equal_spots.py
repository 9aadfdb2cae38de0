"""Spots at the same place ask for their nodes once."""

from atrium.operators import endpoints


def test_equal_spots_walk_once(spark, monkeypatch):
    ring = "array(struct(0.0D as x, 0.0D as y), struct(9.0D as x, 0.0D as y), struct(9.0D as x, 9.0D as y), struct(0.0D as x, 9.0D as y)) polygon"
    room = spark.range(1).selectExpr("id space_id", "1L plane_id", "0 ord", ring, "cast(array() as array<array<struct<x:double,y:double>>>) holes")
    nodes = spark.range(5).selectExpr("id node_id", "1L plane_id", "cast(id + 1 as double) x", "2.0D y")
    walls = spark.createDataFrame([(1, 1, 60.0, 0.0, 60.0, 5.0)], "wall_id long, plane_id long, sx double, sy double, ex double, ey double")
    doors = spark.createDataFrame([], "entrance_id long, plane_id long, wall_id long, x double, y double, width double, type string")
    spots = spark.range(400).selectExpr("id end_id", "1L plane_id", "cast(id % 2 * 30 + 4 as double) x", "4.0D y", "case when id % 4 = 0 then 0L end space_id")
    walks, real = [], endpoints.blocked
    monkeypatch.setattr(endpoints, "blocked", lambda w, *rest: walks.append(w.count()) or real(w, *rest))
    got = endpoints.anchors(spots, room, nodes, walls, doors, "end_id").collect()
    assert sum(walks) <= 20
    by_end = {}
    for r in got:
        by_end.setdefault(r.end_id, set()).add(r.node_id)
    assert len(by_end) == 400 and all(by_end[e] == ({0, 1, 2, 3, 4} if e % 2 == 0 else {4}) for e in by_end)
