"""Pairing of wall faces in rounds gives what one walk through all pairs in order gives."""

from __future__ import annotations

import random

import pytest

from atrium.operators import face_pairs

STROKE = "plan_id long, stroke_id long, orientation string, offset_px double, start_px double, end_px double, thickness_px double"


def outside(span, taken):
    pieces = [span]
    for a, b in taken:
        pieces = [q for s, e in pieces for q in ([(s, e)] if b < s or a > e else [x for x, ok in (((s, a - 1), a > s), ((b + 1, e), b < e)) if ok])]
    return pieces


def walk(strokes, gap, least):
    low, high = max(3.0, gap * 0.3), gap * 2.2
    found = []
    for x in strokes:
        for y in strokes:
            if x[0] == y[0] and x[2] == y[2] and x[1] < y[1] and low <= abs(x[3] - y[3]) <= high:
                s, e = max(x[4], y[4]), min(x[5], y[5])
                if e - s + 1 >= max(least, abs(x[3] - y[3]) * 1.5):
                    found.append((abs(x[3] - y[3]), s - e, x[1], y[1], x, y, s, e))
    used, walls = {}, []
    for d, _, _, _, x, y, s, e in sorted(found, key=lambda f: f[:4]):
        a, b = used.setdefault(x[:2], []), used.setdefault(y[:2], [])
        for p, q in outside((s, e), a + b):
            if q - p + 1 >= max(least, d * 1.5):
                walls.append((x[0], x[2], (x[3] + y[3]) / 2, p, q, d + (x[6] + y[6]) / 2))
                a.append((p, q))
                b.append((p, q))
    left = [(x[0], x[1], p, q) for x in strokes for p, q in outside((x[4], x[5]), used.get(x[:2], [])) if q - p + 1 >= least]
    return sorted(walls), sorted(left)


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    strokes = []
    for i in range(70):
        start = float(rng.randrange(0, 200))
        strokes.append((rng.randrange(2), i, rng.choice(["horizontal", "vertical"]), float(rng.randrange(0, 60)), start, start + rng.randrange(5, 120), float(rng.randrange(1, 4))))
    gaps = spark.createDataFrame([(0, 8.0), (1, 8.0)], "plan_id long, gap double")
    walls, left = face_pairs.paired(spark.createDataFrame(strokes, STROKE), gaps, 10.0)
    got = sorted((r.plan_id, r.orientation, r.offset_px, r.start_px, r.end_px, r.thickness_px) for r in walls.collect())
    assert (got, sorted((r.plan_id, r.stroke_id, r.start_px, r.end_px) for r in left.collect())) == walk(strokes, 8.0, 10.0)


def test_nothing_to_pair(spark):
    gaps = spark.createDataFrame([(1, 6.0)], "plan_id long, gap double")
    walls, left = face_pairs.paired(spark.createDataFrame([(1, 1, "vertical", 0.0, 0.0, 50.0, 1.0)], STROKE), gaps, 10.0)
    assert walls.collect() == [] and left.count() == 1
