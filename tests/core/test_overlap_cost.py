"""The area that two rooms share is computed once for each pair, and only where their boxes share any."""

from atrium.operators import spatial


def _rooms(spark, rows):
    df = spark.createDataFrame(rows, "space_id long, x0 double, y0 double, x1 double, y1 double")
    ring = "array(struct(x0 as x, y0 as y), struct(x1 as x, y0 as y), struct(x1 as x, y1 as y), struct(x0 as x, y1 as y)) polygon"
    return df.selectExpr("space_id", "1L plane_id", "space_id ord", ring, "cast(array() as array<array<struct<x:double,y:double>>>) holes")


def test_area_is_in_the_plan_once(spark):
    pairs = spatial.overlapping(_rooms(spark, [(1, 0.0, 0.0, 1.0, 1.0)]))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1


def test_touching_and_overlapping_rooms(spark):
    rooms = _rooms(spark, [(1, 0.0, 0.0, 4.0, 4.0), (2, 4.0, 0.0, 8.0, 4.0), (3, 3.5, 3.0, 5.0, 9.0), (4, 0.0, 4.0, 3.5, 9.0)])
    got = {(r.space_a, r.space_b): round(r.area, 9) for r in spatial.overlapping(rooms).collect()}
    assert got == {(1, 3): 0.5, (2, 3): 1.0}
