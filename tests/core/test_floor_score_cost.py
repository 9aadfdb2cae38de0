"""Scores of floors are painted in tiles: they equal a count cell by cell, and cost little for each cell."""

from __future__ import annotations

import random
import time
from collections import Counter

from atrium.operators import score

SPACE = "plan_id long, space_id long, ord long, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"
CELL = 0.25


def inside(x, y, ring):
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def cells(spaces, ox, oy, columns, rows):
    found = {}
    for _, space, _, ring, holes in sorted(spaces, key=lambda s: (s[2], s[1])):
        for i in range(columns):
            for j in range(rows):
                x, y = ox + (i + 0.5) * CELL, oy + (j + 0.5) * CELL
                if len(ring) > 2 and inside(x, y, ring) and not any(len(h) > 2 and inside(x, y, h) for h in holes):
                    found[i, j] = space
    return found


def test_tiles_equal_a_count_of_cells(spark, monkeypatch):
    monkeypatch.setattr(score, "TILE", 16)  # many tiles, and spaces across them
    rng = random.Random(3)

    def some(first):
        out = []
        for k in range(14):
            x, y = rng.uniform(-9, 6), rng.uniform(-9, 6)
            ring = [(x + rng.uniform(0, 6), y + rng.uniform(0, 6)) for _ in range(rng.randrange(2, 7))]
            holes = [[(x + rng.uniform(1, 4), y + rng.uniform(1, 4)) for _ in range(rng.randrange(2, 5))] for _ in range(rng.randrange(3))]
            out.append((1, first + k, rng.randrange(4), ring, holes))
        return out

    predicted, truth = some(100), some(200)
    corners = [p for s in predicted + truth for p in s[3]]
    ox, oy = min(p[0] for p in corners), min(p[1] for p in corners)
    columns, rows = (int((max(p[a] for p in corners) - o) / CELL) + 2 for a, o in ((0, ox), (1, oy)))
    p, t = (cells(s, ox, oy, columns, rows) for s in (predicted, truth))
    want = Counter((p.get(k), t.get(k)) for k in p.keys() | t.keys())
    df = [spark.createDataFrame(s, SPACE) for s in (predicted, truth)]
    got = score.shared_cells(*df, score.origins(*df, CELL, None)).collect()
    assert Counter({(r.p, r.t): r.n for r in got}) == want and len(want) > 20


def test_a_large_floor_keeps_its_cells(spark):
    """20 million cells in 40 rooms of 250 by 125 metres: cell by cell this takes minutes."""
    rooms = [(1, k, k, [(x, y), (x + 250.0, y), (x + 250.0, y + 125.0), (x, y + 125.0)], []) for k in range(40) for x, y in [(k % 4 * 250.0, k // 4 * 125.0)]]
    df = spark.createDataFrame(rooms, SPACE)
    start = time.monotonic()
    (got,) = score.floor_score(df, df, CELL, most=None).collect()
    assert time.monotonic() - start < 45
    assert (got.precision, got.recall, got.iou, got.predicted_area, got.truth_area, got.rooms) == (1.0, 1.0, 1.0, 1250000.0, 1250000.0, 40)


def test_no_rooms(spark):
    none = spark.createDataFrame([], SPACE)
    assert score.floor_score(none, none, CELL).collect() == []
    row = [(1, 1, 1, [(0.0, 0.0), (1.0, 0.0)], [])]
    assert score.floor_score(spark.createDataFrame(row, SPACE), none, CELL).collect() == []
