"""Walls that share a cell but no line are told apart where they meet; pairs of a dense plan are not kept first."""

import time

from pyspark.sql import functions as F

from atrium.operators import plan_openings


def test_many_walls_in_few_cells(spark):
    """12,000 walls on as many lines within ten metres, and one gap: 10^7 pairs lie in neighbouring cells."""
    k = F.col("id")
    y = (k % 12000) / 1200.0 + F.when(k < 12000, 0.0).otherwise(20.0)
    walls = spark.range(12001).select(F.lit(1).alias("plan_id"), k.alias("wall_id"), F.lit(0.0).alias("ax"), y.alias("ay"), F.lit(2.0).alias("bx"), y.alias("by"), F.lit(0.1).alias("thickness"))
    far = spark.createDataFrame([(1, 20000, 3.0, 20.0, 5.0, 20.0, 0.1)], walls.schema)
    found = plan_openings.candidates(walls.union(far))
    plan = found._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")
    assert plan.count("Join") <= 4  # ends with ends, gaps with ends, and what is free
    start = time.monotonic()
    got = [(r.i, r.j, round(r.x, 6), round(r.width, 6)) for r in found.collect()]
    assert time.monotonic() - start < 40
    assert got == [(12000, 20000, 2.5, 1.0)]
