"""Walls of drafts that are reshaped or moved, with what touches them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators.spatial import at_cell, with_cells

#: A point touches a wall within half the wall's thickness, but within these metres at least and at most.
LEAST_TOUCH, MOST_TOUCH = 0.05, 0.15
#: A wall is not reshaped to less than this.
SHORTEST = 0.01


class Draft(NamedTuple):
    """walls: plane_id, wall_id, sx, sy, ex, ey, thickness.  spaces: plane_id, space_id, polygon, holes.  elements: plane_id, element_id, x, y, width, accepted, support (sx, sy, ex, ey or null).  More columns stay."""

    walls: DataFrame
    spaces: DataFrame
    elements: DataFrame


def touch(thickness: Column) -> Column:
    return F.least(F.lit(MOST_TOUCH), F.greatest(F.lit(LEAST_TOUCH), F.coalesce(thickness, F.lit(0.0)) / 2))


def _finite(*columns: Column) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return good


def followers(points: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``points`` (plane_id, x, y, key) with nx, ny, for those that touch a changed wall.

    A point keeps its place along the wall and its offset from it.  Of several changed walls it follows the one with the smallest id.
    """
    c = changed.select("plane_id", F.col("wall_id").alias("w_id"), "sx", "sy", "ex", "ey", "to", touch(F.col("thickness")).alias("touch"))
    box = F.struct((F.least("sx", "ex") - F.col("touch")).alias("x0"), (F.least("sy", "ey") - F.col("touch")).alias("y0"), (F.greatest("sx", "ex") + F.col("touch")).alias("x1"), (F.greatest("sy", "ey") + F.col("touch")).alias("y1"))
    pair = at_cell(points).join(with_cells(c, box), ["plane_id", "cx", "cy"])
    t = geom.foot(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))
    pair = pair.withColumn("t", t).withColumn("fx", F.col("sx") + F.col("t") * (F.col("ex") - F.col("sx"))).withColumn("fy", F.col("sy") + F.col("t") * (F.col("ey") - F.col("sy")))
    pair = pair.filter(geom.distance(F.col("x"), F.col("y"), F.col("fx"), F.col("fy")) <= F.col("touch"))
    to = lambda s, e, x, f: F.col(f"to.{s}") + (F.col(f"to.{e}") - F.col(f"to.{s}")) * F.col("t") + F.col(x) - F.col(f)
    best = pair.groupBy("plane_id", "key").agg(F.min(F.struct("w_id", to("sx", "ex", "x", "fx").alias("nx"), to("sy", "ey", "y", "fy").alias("ny"))).alias("b"))
    return best.select("plane_id", "key", "b.nx", "b.ny")


def _walls(walls: DataFrame, changed: DataFrame, leading: DataFrame) -> DataFrame:
    """Walls with the changed ones in their new place, and the touching ends of the others moved along."""
    new = changed.select("plane_id", "wall_id", "to")
    ends = walls.join(new, ["plane_id", "wall_id"], "left_anti").select("plane_id", F.explode(F.array(*[F.struct(F.struct("wall_id", F.lit(i).alias("i")).alias("key"), F.col(x).alias("x"), F.col(y).alias("y")) for i, x, y in ((0, "sx", "sy"), (1, "ex", "ey"))])).alias("p"))
    moved = followers(ends.select("plane_id", "p.*"), leading)
    of = lambda i: F.min(F.when(F.col("key.i") == i, geom.point(F.col("nx"), F.col("ny"))))
    moved = moved.groupBy("plane_id", F.col("key.wall_id").alias("wall_id")).agg(of(0).alias("_s"), of(1).alias("_e"))
    out = walls.join(new, ["plane_id", "wall_id"], "left").join(moved, ["plane_id", "wall_id"], "left")
    for c, end, axis in (("sx", "_s", "x"), ("sy", "_s", "y"), ("ex", "_e", "x"), ("ey", "_e", "y")):
        out = out.withColumn(c, F.coalesce(f"to.{c}", f"{end}.{axis}", c))
    return out.select(*walls.columns)


def _rooms(spaces: DataFrame, leading: DataFrame) -> DataFrame:
    """Rooms with the corners that touch a changed wall moved along; all others stay as they are."""
    v = spaces.select("plane_id", "space_id", F.posexplode("polygon").alias("i", "p")).select("plane_id", F.struct("space_id", "i").alias("key"), "p.x", "p.y")
    moved = followers(v, leading).groupBy("plane_id", F.col("key.space_id").alias("space_id"))
    moved = moved.agg(F.map_from_entries(F.collect_list(F.struct("key.i", geom.point(F.col("nx"), F.col("ny"))))).alias("_new"))  # the corners of one room
    out = spaces.join(moved, ["plane_id", "space_id"], "left")
    ring = F.when(F.col("_new").isNull(), F.col("polygon")).otherwise(F.transform("polygon", lambda p, i: F.coalesce(F.try_element_at("_new", i), p)))
    return out.withColumn("polygon", ring).select(*spaces.columns)


def reshaped(draft: Draft, changes: DataFrame) -> Draft:
    """The draft after each wall of ``changes`` (plane_id, wall_id, sx, sy, ex, ey, optional detach) has got its new ends.

    Ends of other walls and corners of rooms that touched the wall follow it, unless it is detached.  Accepted elements
    on the old wall go back to review.  Changes to less than a centimetre, to no finite place, or to the same place
    do nothing.  All changes are applied at once, against the draft as it was; several rows for a wall: the smallest.
    """
    ends = ["sx", "sy", "ex", "ey"]
    detach = F.coalesce("detach", F.lit(False)) if "detach" in changes.columns else F.lit(False)
    asked = changes.select("plane_id", "wall_id", F.struct(*ends).alias("to"), detach.alias("detach"))
    good = _finite(*[F.col(f"to.{c}") for c in ends]) & (geom.distance(F.col("to.sx"), F.col("to.sy"), F.col("to.ex"), F.col("to.ey")) >= SHORTEST)
    asked = asked.filter(good).groupBy("plane_id", "wall_id").agg(F.min(F.struct("to", "detach")).alias("a")).select("plane_id", "wall_id", "a.*")
    changed = draft.walls.select("plane_id", "wall_id", *ends, "thickness").join(asked, ["plane_id", "wall_id"]).filter(F.struct(*ends) != F.col("to"))
    leading = changed.filter(~F.col("detach"))
    e = draft.elements.filter("accepted").select("plane_id", "element_id", F.col("x").alias("px"), F.col("y").alias("py"), (F.coalesce("width", F.lit(1.0)) / 2).alias("half"))
    around = F.struct((F.col("px") - F.col("half") - MOST_TOUCH).alias("x0"), (F.col("py") - F.col("half") - MOST_TOUCH).alias("y0"), (F.col("px") + F.col("half") + MOST_TOUCH).alias("x1"), (F.col("py") + F.col("half") + MOST_TOUCH).alias("y1"))
    wall_box = F.struct(F.least("sx", "ex").alias("x0"), F.least("sy", "ey").alias("y0"), F.greatest("sx", "ex").alias("x1"), F.greatest("sy", "ey").alias("y1"))
    hit = with_cells(e, around).join(with_cells(changed.select("plane_id", *ends, "thickness"), wall_box), ["plane_id", "cx", "cy"])
    hit = hit.filter(geom.distance_to_segment(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")) <= F.col("half") + touch(F.col("thickness")))
    back = hit.select("plane_id", "element_id").distinct().withColumn("_back", F.lit(True))
    elements = draft.elements.join(back, ["plane_id", "element_id"], "left").withColumn("accepted", F.col("accepted") & F.col("_back").isNull()).select(*draft.elements.columns)
    return Draft(_walls(draft.walls, changed, leading), _rooms(draft.spaces, leading), elements)


def moved(draft: Draft, picked: DataFrame) -> Draft:
    """The draft after the ``picked`` entries (plane_id, kind: wall, space or element, id, dx, dy) have been moved.

    Other walls' ends and other rooms' corners that touch a moved wall move with it; a moved room takes its holes along,
    a moved element the piece of wall that it brings.  The entries of a plane move by one distance; rows without finite numbers do nothing.
    """
    p = picked.filter(_finite(F.col("dx"), F.col("dy"))).groupBy("plane_id", "kind", "id").agg(F.min(F.struct("dx", "dy")).alias("by"))
    of = lambda kind, key: p.filter(F.col("kind") == kind).select("plane_id", F.col("id").alias(key), "by")
    to = F.struct(*[(F.col(c) + F.col(f"by.{d}")).alias(c) for c, d in (("sx", "dx"), ("sy", "dy"), ("ex", "dx"), ("ey", "dy"))])
    changed = draft.walls.select("plane_id", "wall_id", "sx", "sy", "ex", "ey", "thickness").join(of("wall", "wall_id"), ["plane_id", "wall_id"]).withColumn("to", to)
    rooms = draft.spaces.join(of("space", "space_id"), ["plane_id", "space_id"], "left")
    still = _rooms(rooms.filter("by is null").select(*draft.spaces.columns), changed)
    go = lambda ring: geom.moved(ring, F.col("by.dx"), F.col("by.dy"))
    gone = rooms.filter("by is not null").withColumn("polygon", go(F.col("polygon"))).withColumn("holes", F.transform("holes", go)).select(*draft.spaces.columns)
    e = draft.elements.join(of("element", "element_id"), ["plane_id", "element_id"], "left")
    shift = lambda c, d: F.coalesce(F.col(c) + F.col(f"by.{d}"), F.col(c))
    support = F.struct(*[shift(f"support.{c}", d).alias(c) for c, d in (("sx", "dx"), ("sy", "dy"), ("ex", "dx"), ("ey", "dy"))])
    e = e.withColumn("x", shift("x", "dx")).withColumn("y", shift("y", "dy")).withColumn("support", F.when(F.col("support").isNotNull(), support)).select(*draft.elements.columns)
    return Draft(_walls(draft.walls, changed, changed), still.union(gone), e)
