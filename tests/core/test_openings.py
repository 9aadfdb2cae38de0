"""Openings between walls on one line: rounds give what one walk through all pairs in order gives."""

from __future__ import annotations

import math
import random

import pytest

from atrium.operators import plan_openings

WALL = "plan_id long, wall_id long, ax double, ay double, bx double, by double, thickness double"


def walk(walls):
    found = []
    for a in sorted(walls):
        size = math.dist(a[2:4], a[4:6])
        if size < 0.4:
            continue
        u = ((a[4] - a[2]) / size, (a[5] - a[3]) / size)
        across = lambda x, y: (x - a[2]) * u[1] - (y - a[3]) * u[0]  # noqa: B023, E731
        along = lambda x, y: (x - a[2]) * u[0] + (y - a[3]) * u[1]  # noqa: B023, E731
        for b in sorted(walls):
            if b[0] != a[0] or b[1] <= a[1] or math.dist(b[2:4], b[4:6]) < 0.4 or abs(a[6] - b[6]) > 0.08:
                continue
            if max(abs(across(*b[2:4])), abs(across(*b[4:6]))) > 0.04:
                continue
            low, high = sorted((along(*b[2:4]), along(*b[4:6])))
            gap = (size, low) if low > size else (high, 0.0) if high < 0 else None
            if gap is None or not 0.55 <= gap[1] - gap[0] <= 2.4:
                continue
            stops = [p for k in walls if k[0] == a[0] and k[1] not in (a[1], b[1]) for p in (k[2:4], k[4:6])]
            if any(gap[0] + 0.04 < along(*p) < gap[1] - 0.04 and abs(across(*p)) < 0.15 for p in stops):
                continue
            m = (gap[0] + gap[1]) / 2
            x, y = a[2] + u[0] * m, a[3] + u[1] * m
            if all(f[0] != a[0] or math.dist((x, y), f[3:5]) >= 0.15 for f in found):
                found.append((a[0], a[1], b[1], round(x, 6), round(y, 6), round(gap[1] - gap[0], 6)))
    return sorted(found)


def got(spark, walls):
    out = plan_openings.openings(spark.createDataFrame(walls, WALL))
    return sorted((r.plan_id, r.i, r.j, round(r.x, 6), round(r.y, 6), round(r.width, 6)) for r in out.collect())


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    walls = []
    for i in range(160):
        line, at, size, back = rng.randrange(3), rng.uniform(0, 14), rng.uniform(0.2, 2.0), rng.random() < 0.5
        off, plan = rng.uniform(0, 0.05), rng.randrange(2)
        ends = [(at, off), (at + size, off)] if line == 0 else [(off, at), (off, at + size)] if line == 1 else [(at * 0.6, at * 0.8), ((at + size) * 0.6, (at + size) * 0.8)]
        (ax, ay), (bx, by) = ends[::-1] if back else ends
        if rng.random() < 0.4:  # fewer obstacles: most walls stand on lines of their own
            shift = 3.0 * rng.randrange(1, 9)
            ax, bx, ay, by = ax + shift, bx + shift, ay - shift, by - shift
        walls.append((plan, i, ax, ay, bx, by, rng.choice([0.1, 0.15, 0.2])))
    want = walk(walls)
    assert got(spark, walls) == want and len(want) > 5


def test_gaps_with_something_in_them(spark):
    row = [(1, 1, 0.0, 0.0, 3.0, 0.0, 0.2), (1, 2, 4.0, 0.0, 7.0, 0.0, 0.2), (2, 1, 0.0, 0.0, 3.0, 0.0, 0.2), (2, 2, 4.0, 0.0, 7.0, 0.0, 0.2), (2, 3, 3.5, 0.1, 3.5, 4.0, 0.2)]
    row += [(3, 1, 0.0, 0.0, 3.0, 0.0, 0.1), (3, 2, 4.0, 0.0, 7.0, 0.0, 0.2), (4, 1, 0.0, 0.0, 3.0, 0.0, 0.2), (4, 2, 5.5, 0.0, 7.0, 0.0, 0.2)]
    assert got(spark, row) == [(1, 1, 2, 3.5, 0.0, 1.0)]  # another wall ends in it, another thickness, too wide
    assert got(spark, []) == []


def test_near_openings_are_one_and_what_is_dropped_drops_nothing(spark):
    # three lines 0.1 m apart with the same gap: the second goes, so the third, 0.2 m from the first, stays
    walls = [(1, 2 * n + side, *((-5.0, y, -0.5, y) if side == 0 else (0.5, y, 5.0, y)), 0.1) for n, y in enumerate((0.0, 0.1, 0.2)) for side in range(2)]
    assert plan_openings.candidates(spark.createDataFrame(walls, WALL)).count() == 3
    assert got(spark, walls) == walk(walls) == [(1, 0, 1, 0.0, 0.0, 1.0), (1, 4, 5, 0.0, 0.2, 1.0)]
