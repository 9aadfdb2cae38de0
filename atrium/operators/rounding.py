"""Rounded corners of routes that keep clear of walls and holes."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.functions import geom
from atrium.operators.spatial import at_cell, ring_edges, with_cells
from atrium.operators.trips import SAME, arc_lengths

#: How far back from a corner its curve may start (metres, and as a share of each side), what each retry leaves of that, and how many tries there are.
RADIUS, MOST_SHARE, SHRINK, TRIES = 0.8, 0.45, 0.6, 8
#: Sides whose cosine is below this go straight on; a curve turns by this angle at most from point to point.
STRAIGHT, TURN = -0.9995, pi / 16


def obstacles(walls: DataFrame, spaces: DataFrame) -> DataFrame:
    """plane_id, a, b, clearance: centre lines of walls with half their thickness, and the edges of holes with none."""
    w = walls.select("plane_id", geom.point(F.col("sx"), F.col("sy")).alias("a"), geom.point(F.col("ex"), F.col("ey")).alias("b"), F.greatest(F.lit(0.0), F.col("thickness") / 2).alias("clearance"))
    return w.union(ring_edges(spaces).filter("ring_no > 0").select("plane_id", "a", "b", F.lit(0.0)))


def corners(points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Points (path_id, plane_id, ord, x, y) without repeats; ``corner`` (x, y, the unit vectors u and v along both sides, radius, steps) where a path turns."""
    w = Window.partitionBy("path_id").orderBy("ord")
    p = arc_lengths(points)
    p = p.select("*", *[f(c).over(w).alias(f"{n}{c}") for n, f in (("a", F.lag), ("b", F.lead)) for c in ("x", "y")])
    p = p.withColumn("la", geom.distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y"))).withColumn("lb", geom.distance(F.col("bx"), F.col("by"), F.col("x"), F.col("y")))
    unit = lambda n, c: ((F.col(f"{n}{c}") - F.col(c)) / F.col(f"l{n}"))
    p = p.select("*", unit("a", "x").alias("ux"), unit("a", "y").alias("uy"), unit("b", "x").alias("vx"), unit("b", "y").alias("vy"))
    cosine = F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")
    turn = F.lit(pi) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    reach = F.least(F.lit(float(radius)), F.col("la") * MOST_SHARE, F.col("lb") * MOST_SHARE)
    shape = F.struct("x", "y", "ux", "uy", "vx", "vy", reach.alias("radius"), F.greatest(F.lit(2), F.ceil(turn / TURN).cast("int")).alias("steps"))
    return p.select("path_id", "plane_id", "ord", "x", "y", F.when((cosine >= STRAIGHT) & (reach > SAME), shape).alias("corner"))


def curve(corner: Column, radius: Column) -> Column:
    """The points of a quadratic Bézier curve from ``radius`` before the corner to as far behind it, the corner being its control point."""

    def at(i: Column) -> Column:
        t = i / corner.steps
        before, behind = radius * (1 - t) * (1 - t), radius * t * t
        return geom.point(corner.x + corner.ux * before + corner.vx * behind, corner.y + corner.uy * before + corner.vy * behind)

    return F.transform(F.sequence(F.lit(0), corner.steps), at)


def _apart(px: str, py: str, qx: str, qy: str) -> Column:
    """The distance of segment pq from segment ab; 0 if they meet."""
    p, q = geom.point(F.col(px), F.col(py)), geom.point(F.col(qx), F.col(qy))
    a, b = geom.point(F.col("ax"), F.col("ay")), geom.point(F.col("bx"), F.col("by"))
    far = lambda o, s, e: geom.distance_to_segment(o.x, o.y, s.x, s.y, e.x, e.y)
    return F.when(geom.crossing(p, q, a, b).isNotNull(), 0.0).otherwise(F.least(far(p, a, b), far(q, a, b), far(a, p, q), far(b, p, q)))


def blocked(shapes: DataFrame, barriers: DataFrame, radius: float = RADIUS) -> DataFrame:
    """plane_id, corner, mask: bit k is set if try k of the corner comes too close to something.

    A curve stays within its radius of its corner, so a corner meets only what is as near, and a try what is as near as that try.
    A try is blocked by what it touches and the sharp corner does not, and by what it comes nearer to than its clearance
    and the sharp corner do.  The sides of a curve (from 0 on) and of its sharp corner (-2 and -1) are rows of numbers, so distances are compiled.
    """
    wide = F.struct((F.least("ax", "bx") - F.col("clearance")).alias("x0"), (F.least("ay", "by") - F.col("clearance")).alias("y0"), (F.greatest("ax", "bx") + F.col("clearance")).alias("x1"), (F.greatest("ay", "by") + F.col("clearance")).alias("y1"))
    o = barriers.select("plane_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "clearance").distinct()
    pair = at_cell(shapes.withColumn("x", F.col("corner.x")).withColumn("y", F.col("corner.y"))).join(with_cells(o, wide, radius), ["plane_id", "cx", "cy"])
    pair = pair.select("plane_id", "corner", "corner.*", "ax", "ay", "bx", "by", "clearance").withColumn("off", geom.distance_to_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    tries = pair.filter(F.col("off") <= F.col("radius") + F.col("clearance")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1)))).withColumn("r", F.col("radius") * F.pow(F.lit(SHRINK), F.col("k")))
    sides = tries.filter(F.col("off") <= F.col("r") + F.col("clearance")).withColumn("i", F.explode(F.sequence(F.lit(-2), F.col("steps") - 1)))
    curved = F.col("i") >= 0
    u = lambda i: F.when(curved, (1 - i / F.col("steps")) * (1 - i / F.col("steps"))).otherwise(F.when(i == -2, 1.0).otherwise(0.0))
    v = lambda i: F.when(curved, (i / F.col("steps")) * (i / F.col("steps"))).otherwise(F.when(i == 0, 1.0).otherwise(0.0))
    at = lambda c, i: F.col(c) + F.col("r") * (F.col(f"u{c}") * u(i) + F.col(f"v{c}") * v(i))
    for name, c, i in (("px", "x", F.col("i")), ("py", "y", F.col("i")), ("qx", "x", F.col("i") + 1), ("qy", "y", F.col("i") + 1)):
        sides = sides.withColumn(name, at(c, i))
    sides = sides.withColumn("d", _apart("px", "py", "qx", "qy"))
    each = sides.groupBy("plane_id", "corner", "k", "ax", "ay", "bx", "by", "clearance").agg(F.min(F.when(curved, F.col("d"))).alias("d"), F.min(F.when(~curved, F.col("d"))).alias("before"))
    close = (F.col("d") <= 0) | (F.col("d") < F.col("clearance"))
    bad = each.filter(close & (((F.col("d") <= 0) & (F.col("before") > 0)) | (F.col("d") < F.least("clearance", "before") - SAME)))
    return bad.groupBy("plane_id", "corner").agg(F.expr("bit_or(shiftleft(1, k))").alias("mask"))


def rounded(points: DataFrame, barriers: DataFrame | None = None, radius: float = RADIUS) -> DataFrame:
    """path_id, plane_id, ord, step, x, y, radius: the paths with each corner as a curve of ``radius``; sharp corners and ends have step 0 and no radius.

    A corner takes the first of its tries that is clear, or stays sharp.  Equal corners of many routes are tested once.
    Points equal to the one before are left out; a path of one point stays that point.
    """
    c = corners(points, radius)
    clear = "array_min(filter(sequence(0, {}), k -> (coalesce(mask, 0) & shiftleft(1, k)) = 0 and corner.radius * pow({}, k) > {}))".format(TRIES - 1, SHRINK, SAME)
    if barriers is None:
        c = c.withColumn("mask", F.lit(0))
    else:
        shapes = c.filter("corner is not null").select("plane_id", "corner").distinct()
        c = c.join(blocked(shapes, barriers, radius), ["plane_id", "corner"], "left")
    c = c.withColumn("taken", F.col("corner.radius") * F.pow(F.lit(SHRINK), F.expr(clear)))
    one = F.array(geom.point(F.col("x"), F.col("y")))
    line = F.when(F.col("taken").isNull(), one).otherwise(curve(F.col("corner"), F.col("taken")))
    return c.select("path_id", "plane_id", "ord", "taken", F.posexplode(line).alias("step", "p")).select("path_id", "plane_id", "ord", "step", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("taken").alias("radius"))
