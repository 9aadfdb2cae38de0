"""Snapping of points to corners, the grid, edges, and lines through a reference point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators.spatial import at_cell, with_cells

#: Metres within which a corner, an edge, and a line through the reference point attract.
VERTEX, EDGE, ORTHOGONAL = 0.2, 0.15, 0.15
CELL = 2.0
AXIS = 1e-9


def on_grid(value: Column, grid: float | None) -> Column:
    """The nearest multiple of the grid, halves upwards; the value itself without a grid."""
    return F.floor(value / grid + 0.5) * F.lit(float(grid)) if grid else value


def lines(spaces: DataFrame, walls: DataFrame) -> DataFrame:
    """plane_id, owner, rank, a, b: the outline edges of rooms (rooms in order, then edges in order), then walls."""
    none = F.lit(None).cast("long")
    e = spaces.filter(F.size("polygon") >= 2).select("plane_id", "space_id", "ord", F.posexplode(geom.edges(F.col("polygon"))).alias("i", "e"))
    rooms = e.select("plane_id", F.concat(F.lit("space-"), F.col("space_id")).alias("owner"), F.struct(F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), F.col("space_id").alias("id"), F.col("i").alias("i")).alias("rank"), "e.a", "e.b")
    return rooms.union(walls.select("plane_id", F.concat(F.lit("wall-"), F.col("wall_id")), F.struct(F.lit(1), none, F.col("wall_id"), F.lit(0)), geom.point(F.col("sx"), F.col("sy")), geom.point(F.col("ex"), F.col("ey"))))


def corners(spaces: DataFrame, walls: DataFrame) -> DataFrame:
    """plane_id, owner, rank, a: the corners of rooms, then the ends of walls."""
    none = F.lit(None).cast("long")
    v = spaces.select("plane_id", "space_id", "ord", F.posexplode("polygon").alias("i", "a"))
    rooms = v.select("plane_id", F.concat(F.lit("space-"), F.col("space_id")).alias("owner"), F.struct(F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), F.col("space_id").alias("id"), F.col("i").alias("i")).alias("rank"), "a")
    w = walls.select("plane_id", "wall_id", F.posexplode(F.array(geom.point(F.col("sx"), F.col("sy")), geom.point(F.col("ex"), F.col("ey")))).alias("i", "a"))
    return rooms.union(w.select("plane_id", F.concat(F.lit("wall-"), F.col("wall_id")), F.struct(F.lit(1), none, F.col("wall_id"), F.col("i")), "a"))


def _on_edge(grid: float | None) -> Column:
    """The point of edge ab nearest to x, y; on an edge along an axis moved to the grid, within the edge."""
    t = geom.foot(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    hit = geom.point(F.col("a.x") + t * (F.col("b.x") - F.col("a.x")), F.col("a.y") + t * (F.col("b.y") - F.col("a.y")))
    if not grid:
        return hit
    held = lambda v, c: F.least(F.greatest(f"a.{c}", f"b.{c}"), F.greatest(F.least(f"a.{c}", f"b.{c}"), on_grid(v, grid)))
    flat, upright = F.abs(F.col("a.y") - F.col("b.y")) < AXIS, F.abs(F.col("a.x") - F.col("b.x")) < AXIS
    return F.when(flat, geom.point(held(hit.x, "x"), F.col("a.y"))).when(upright, geom.point(F.col("a.x"), held(hit.y, "y"))).otherwise(hit)


def snapped(points: DataFrame, spaces: DataFrame, walls: DataFrame, grid: float | None = None, vertex: float = VERTEX, edge: float = EDGE, orthogonal: float = ORTHOGONAL) -> DataFrame:
    """point_id, kind, x, y: where each point goes, and by what (vertex, grid, edge, orthogonal; null: it stays).

    Points (point_id, plane_id, x, y) may have a reference point (rx, ry) and an object that doesn't attract them
    (excluded: ``space-1``, ``wall-2``).  The kind whose place is nearest wins, in the order above on ties; within a kind the nearest
    object, the first one on ties.  With a ``grid`` every point without something nearer goes to the grid, and what is free
    along an edge or a line goes to the grid too.  Points meet what attracts them by cells.
    """
    p = points
    for name, kind in (("rx", "double"), ("ry", "double"), ("excluded", "string")):
        p = p if name in p.columns else p.withColumn(name, F.lit(None).cast(kind))
    p = p.select("point_id", "plane_id", "x", "y", "rx", "ry", "excluded")
    seen = lambda pair: pair.filter(F.col("excluded").isNull() | (F.col("excluded") != F.col("owner")))
    at = F.struct(F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("a.x").alias("x1"), F.col("a.y").alias("y1"))
    v = seen(at_cell(p, CELL).join(with_cells(corners(spaces, walls), at, vertex, CELL), ["plane_id", "cx", "cy"])).withColumn("d", geom.distance(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y")))
    v = v.filter(F.col("d") < vertex).groupBy("point_id").agg(F.min(F.struct("d", "rank", F.col("a").alias("to"))).alias("vertex"))
    box = F.struct(F.least("a.x", "b.x").alias("x0"), F.least("a.y", "b.y").alias("y0"), F.greatest("a.x", "b.x").alias("x1"), F.greatest("a.y", "b.y").alias("y1"))
    e = seen(at_cell(p, CELL).join(with_cells(lines(spaces, walls), box, edge, CELL), ["plane_id", "cx", "cy"]))
    e = e.withColumn("d", geom.distance_to_segment(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))).filter(F.col("d") < edge)
    e = e.groupBy("point_id").agg(F.min(F.struct("d", "rank", _on_edge(grid).alias("to"))).alias("edge"))
    dx, dy = F.abs(F.col("x") - F.col("rx")), F.abs(F.col("y") - F.col("ry"))
    line = F.when((dx <= orthogonal) & (dx <= dy), geom.point(F.col("rx"), on_grid(F.col("y"), grid))).when((dy <= orthogonal) & (dy < dx), geom.point(on_grid(F.col("x"), grid), F.col("ry")))
    cross = geom.point(on_grid(F.col("x"), grid), on_grid(F.col("y"), grid)) if grid else F.lit(None).cast("struct<x:double,y:double>")
    far = lambda to: geom.distance(F.col("x"), F.col("y"), to.x, to.y)
    offer = lambda rank, kind, to: F.when(to.isNotNull(), F.struct(far(to).alias("d"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), to.x.alias("x"), to.y.alias("y")))
    out = p.join(v, "point_id", "left").join(e, "point_id", "left")
    best = F.array_min(F.array_compact(F.array(offer(0, "vertex", F.col("vertex.to")), offer(1, "grid", cross), offer(2, "edge", F.col("edge.to")), offer(3, "orthogonal", line))))
    out = out.select("point_id", best.alias("to"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return out.select("point_id", "to.kind", F.coalesce("to.x", "ox").alias("x"), F.coalesce("to.y", "oy").alias("y"))
