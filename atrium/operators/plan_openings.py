"""Openings of plans: gaps between walls on one line that nothing stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators.routing import written
from atrium.operators.spatial import at_cell, with_cells

#: Fixed values in metres: the narrowest and widest opening, the shortest wall beside one, how far walls of one line differ
#: across it and in thickness, how near to that line and how far inside a gap an end stands in the way, and how near two openings are one.
NARROWEST, WIDEST, SHORTEST, ACROSS, THICKNESS, IN_THE_WAY, INSIDE, SAME_PLACE = 0.55, 2.4, 0.4, 0.04, 0.08, 0.15, 0.04, 0.15


def _along(x: Column, y: Column) -> Column:
    return (x - F.col("ax")) * F.col("ux") + (y - F.col("ay")) * F.col("uy")


def _across(x: Column, y: Column) -> Column:
    return (x - F.col("ax")) * F.col("uy") - (y - F.col("ay")) * F.col("ux")


def candidates(walls: DataFrame, narrowest: float = NARROWEST, widest: float = WIDEST, shortest: float = SHORTEST) -> DataFrame:
    """plan_id, i, j (i < j), x, y, width, degrees, thickness, support (sx, sy, ex, ey): every free gap between two walls on one line.

    ``walls``: plan_id, wall_id, ax, ay, bx, by, thickness in metres, in any direction.  A wall meets the ends that lie ahead of one of its own,
    on its line and within an opening's width, so pairs come from cells of that size and not from whole lines or plans, and what is on no
    common line goes where it is met.
    """
    ends = walls.select("plan_id", F.col("wall_id").alias("k"), F.explode(F.array(geom.point(F.col("ax"), F.col("ay")), geom.point(F.col("bx"), F.col("by")))).alias("p")).select("plan_id", "k", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    long = walls.withColumn("long", geom.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).filter(F.col("long") >= shortest)
    size = widest + 2 * ACROSS
    a = long.select("plan_id", F.col("wall_id").alias("i"), "ax", "ay", "bx", "by", F.col("thickness").alias("thick_i"), "long", ((F.col("bx") - F.col("ax")) / F.col("long")).alias("ux"), ((F.col("by") - F.col("ay")) / F.col("long")).alias("uy"))
    ahead = lambda x, y, way: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(x) + F.col("ux") * way * widest).alias("fx"), (F.col(y) + F.col("uy") * way * widest).alias("fy"))
    a = a.withColumn("p", F.explode(F.array(ahead("bx", "by", 1), ahead("ax", "ay", -1))))
    strip = F.struct(F.least("p.x", "p.fx").alias("x0"), F.least("p.y", "p.fy").alias("y0"), F.greatest("p.x", "p.fx").alias("x1"), F.greatest("p.y", "p.fy").alias("y1"))
    a = with_cells(a, strip, 2 * ACROSS, size).drop("p")
    b = long.select("plan_id", F.col("wall_id").alias("j"), F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"), F.col("thickness").alias("thick_j"))
    b = b.withColumn("p", F.explode(F.array(geom.point(F.col("px"), F.col("py")), geom.point(F.col("qx"), F.col("qy"))))).withColumn("x", F.col("p.x")).withColumn("y", F.col("p.y"))
    pair = a.join(at_cell(b, size).drop("p", "x", "y"), ["plan_id", "cx", "cy"]).filter((F.col("i") < F.col("j")) & (F.abs(F.col("thick_i") - F.col("thick_j")) <= THICKNESS))
    pair = pair.filter(F.greatest(F.abs(_across(F.col("px"), F.col("py"))), F.abs(_across(F.col("qx"), F.col("qy")))) <= ACROSS)
    low, high = F.least(_along(F.col("px"), F.col("py")), _along(F.col("qx"), F.col("qy"))), F.greatest(_along(F.col("px"), F.col("py")), _along(F.col("qx"), F.col("qy")))
    # the gap behind the first wall, or the one before it
    pair = pair.withColumn("from", F.when(low > F.col("long"), F.col("long")).when(high < 0, high)).withColumn("to", F.when(low > F.col("long"), low).when(high < 0, 0.0))
    pair = pair.withColumn("width", F.col("to") - F.col("from")).filter(F.col("width").between(narrowest, widest)).dropDuplicates(["plan_id", "i", "j"])
    on = lambda t: (F.col("ax") + F.col("ux") * F.col(t), F.col("ay") + F.col("uy") * F.col(t))
    (sx, sy), (ex, ey) = on("from"), on("to")
    pair = pair.select("plan_id", "i", "j", "ax", "ay", "ux", "uy", "from", "to", "width", F.struct(sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey")).alias("support"), ((F.col("thick_i") + F.col("thick_j")) / 2).alias("thickness"))
    gap = F.struct(F.least("support.sx", "support.ex").alias("x0"), F.least("support.sy", "support.ey").alias("y0"), F.greatest("support.sx", "support.ex").alias("x1"), F.greatest("support.sy", "support.ey").alias("y1"))
    hit = with_cells(pair, gap, IN_THE_WAY, size).join(at_cell(ends, size), ["plan_id", "cx", "cy"]).filter("k <> i and k <> j")
    t = _along(F.col("x"), F.col("y"))
    hit = hit.filter((t > F.col("from") + INSIDE) & (t < F.col("to") - INSIDE) & (F.abs(_across(F.col("x"), F.col("y"))) < IN_THE_WAY)).select("plan_id", "i", "j").distinct()
    free = pair.join(hit, ["plan_id", "i", "j"], "left_anti")
    middle = lambda s, e: (F.col(f"support.{s}") + F.col(f"support.{e}")) / 2
    return free.select("plan_id", "i", "j", middle("sx", "ex").alias("x"), middle("sy", "ey").alias("y"), "width", F.degrees(F.atan2("uy", "ux")).alias("degrees"), "thickness", "support")


def openings(walls: DataFrame, **limits: float) -> DataFrame:
    """The candidates in the order of (i, j), without those within ``SAME_PLACE`` of one that was taken before.

    A round takes all candidates without an open one before them nearby and drops what is near those, so it gives what one walk
    through the whole order gives.
    """
    found = written(candidates(walls, **limits))
    key = ["plan_id", "i", "j"]
    size = 2 * SAME_PLACE
    point = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    other = found.select("plan_id", F.col("i").alias("i0"), F.col("j").alias("j0"), "x", "y")
    near = with_cells(other, point, SAME_PLACE, size).withColumnRenamed("x", "x0").withColumnRenamed("y", "y0").join(at_cell(found.select(*key, "x", "y"), size), ["plan_id", "cx", "cy"])
    near = near.filter((F.struct("i0", "j0") < F.struct("i", "j")) & (geom.distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0")) < SAME_PLACE))
    near = written(near.select("plan_id", "i0", "j0", "i", "j"))
    waiting = near
    dropped = None
    while not waiting.isEmpty():
        # those that something before them still holds back do not drop anything in this round
        held = waiting.select("plan_id", F.col("i").alias("i0"), F.col("j").alias("j0")).distinct()
        gone = written(waiting.join(held, ["plan_id", "i0", "j0"], "left_anti").select(*key).distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        before = gone.select("plan_id", F.col("i").alias("i0"), F.col("j").alias("j0"))
        waiting = written(waiting.join(gone, key, "left_anti").join(before, ["plan_id", "i0", "j0"], "left_anti"))
    return found if dropped is None else found.join(dropped, key, "left_anti")
