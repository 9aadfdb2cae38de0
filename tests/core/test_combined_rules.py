"""Each rule is written on its own, so what reads all issues holds the plan of none of them."""

from atrium.operators import validate


def test_combined_issues_hold_no_plan_of_a_rule(spark):
    entrances = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], "entrance_id long, plane_id long, wall_id long")
    walls = spark.createDataFrame([(1, 5, 0.0, 0.0, 1.0, 0.0, 0.0)], "plane_id long, wall_id long, sx double, sy double, ex double, ey double, thickness double")
    out = validate.combined([validate.missing_hosts(entrances, walls), validate.walls(walls)])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.type, r.object_id) for r in out.collect()) == [("invalid-wall-thickness", "5"), ("missing-host-wall", "2")]
