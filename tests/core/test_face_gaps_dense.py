"""Equal strokes meet once, with their number, and in one piece of the axis."""

import time

from pyspark.sql import functions as F

from atrium.operators import draft


def test_many_equal_strokes(spark):
    """Two faces, each drawn 30,000 times: 9 * 10^8 pairs with a common length of 201 over four pieces."""
    strokes = spark.range(60000).select(
        F.lit(1).alias("plan_id"), F.col("id").alias("stroke_id"), F.lit("horizontal").alias("orientation"), (F.col("id") % 2 * 5).cast("double").alias("offset_px"),
        F.lit(0.0).alias("start_px"), F.lit(200.0).alias("end_px"), F.lit(1.0).alias("thickness_px"),
    )
    start = time.monotonic()
    got = draft.face_gaps(strokes, 12.0, 20.0).collect()
    assert time.monotonic() - start < 30
    assert [(r.plan_id, r.gap, r.weight) for r in got] == [(1, 5, 9e8 * 201)]
