"""Lines of strokes meet as counts, also where all strokes differ; plans off the grid meet stroke by stroke."""

import math
import random
import time

from pyspark.sql import functions as F

from atrium.operators import draft

STROKE = "plan_id long, stroke_id long, orientation string, offset_px double, start_px double, end_px double, thickness_px double"


def _plain(strokes, most, least):
    """All pairs of a plan, as the SQL says."""
    n, total = {}, {}
    for p, _, way, o, a, b, _ in strokes:
        total[p] = total.get(p, 0.0) + b - a + 1
        for q, _, other, u, c, d, _ in strokes:
            shared = min(b, d) - max(a, c) + 1
            if p == q and way == other and 3 <= u - o <= most and shared >= least:
                gap = math.floor(u - o + 0.5)
                n[p, gap] = n.get((p, gap), 0.0) + shared
    weight = {(p, g): sum(n.get((p, g + i), 0.0) for i in (-1, 0, 1)) for p, g in n}
    best = {p: min((-w, g) for (q, g), w in weight.items() if q == p) for p, _ in weight}
    return {p: (g, round(-w, 4)) for p, (w, g) in best.items() if -w >= total[p] * 0.08}


def test_equals_all_pairs(spark):
    pick = random.Random(3)
    strokes = []
    for i in range(900):
        p = pick.randrange(4)
        off = pick.random() if p == 3 else pick.randrange(8) / 8  # one plan is off the grid
        a = pick.randrange(-60, 90) + off
        strokes.append((p, i, pick.choice(["horizontal", "vertical"]), float(pick.randrange(-20, 90)) + pick.randrange(2) / 2, a, a + pick.choice([10, 19, 20, 40, 200]), 1.0))
    strokes += strokes[:50]
    got = {r.plan_id: (r.gap, round(r.weight, 4)) for r in draft.face_gaps(spark.createDataFrame(strokes, STROKE), 12.0, 20.0).collect()}
    assert got == _plain(strokes, 12.0, 20.0) and len(got) == 4


def test_dense_plan_of_different_strokes(spark):
    """400,000 strokes that all differ on 100 lines: about 3 * 10^9 pairs are near and overlap."""
    n = F.col("id")
    strokes = spark.range(400000).select(
        F.lit(1).alias("plan_id"), n.alias("stroke_id"), F.lit("horizontal").alias("orientation"), (n % 100).cast("double").alias("offset_px"),
        (F.floor(n / 100) % 500).cast("double").alias("start_px"), (F.floor(n / 100) % 500 + 29 + F.floor(n / 50000) * 10).cast("double").alias("end_px"), F.lit(1.0).alias("thickness_px"),
    )
    start = time.monotonic()
    got = draft.face_gaps(strokes, 12.0, 20.0).collect()
    assert time.monotonic() - start < 60
    each = [(a, a + 29 + 10 * k) for k in range(8) for a in range(500)]  # the same on every line
    shared = sum(m for a, b in each for c, d in each if (m := min(b, d) - max(a, c) + 1) >= 20)
    assert [(r.gap, r.weight) for r in got] == [(4, shared * (97 + 96 + 95))]
