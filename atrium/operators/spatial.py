"""Spatial joins on (plane, grid cell) keys, so that each is an equi join with an exact test behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators.routing import written

CELL = 5.0
EPSILON = 1e-9


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float = CELL) -> Column:
    """The grid cells that a box touches, as an array of structs cx, cy."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(x0, x1), lambda cx: F.transform(span(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def with_cells(df: DataFrame, box: Column, margin: float = 0.0, size: float = CELL) -> DataFrame:
    """``df`` once for each cell that its box (widened by ``margin``) touches; adds cx, cy."""
    out = df.withColumn("_box", box)
    grid = cells(F.col("_box.x0") - margin, F.col("_box.y0") - margin, F.col("_box.x1") + margin, F.col("_box.y1") + margin, size)
    return out.withColumn("_cell", F.explode(grid)).select("*", F.col("_cell.cx").alias("cx"), F.col("_cell.cy").alias("cy")).drop("_cell", "_box")


def at_cell(df: DataFrame, size: float = CELL) -> DataFrame:
    """``df`` of points x, y with their one cell."""
    return df.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))


def containing(points: DataFrame, spaces: DataFrame) -> DataFrame:
    """Every (point row, space that contains it): the columns of ``points`` (with plane_id, x, y), space_id, space_ord."""
    rooms = with_cells(spaces.select("plane_id", "space_id", F.col("ord").alias("space_ord"), "polygon", "holes"), geom.box(F.col("polygon")))
    hit = at_cell(points).join(rooms, ["plane_id", "cx", "cy"]).filter(geom.inside_with_holes(F.col("x"), F.col("y"), F.col("polygon"), F.col("holes")))
    return hit.drop("cx", "cy", "polygon", "holes")


def first_space(points: DataFrame, spaces: DataFrame, key: str, last: bool = False) -> DataFrame:
    """key, space_id: the first (or last) space in order that contains each point; points outside have no row."""
    pick = F.max_by if last else F.min_by
    return containing(points, spaces).groupBy(key).agg(pick("space_id", F.struct("space_ord", "space_id")).alias("space_id"))


def nearest_node(points: DataFrame, nodes: DataFrame, key: str, size: float = CELL, growth: float = 4.0, most: float = 5000.0) -> DataFrame:
    """key, node_id, distance: the nearest node on the point's plane, the smallest id on ties.

    A point looks into its own cell and the eight around it; what lies within a cell's width there is nearest.  Points
    without such a node look again in wider cells, and only those that nothing is near up to ``most`` metres meet all nodes of their plane.
    """
    p = points.select(key, "plane_id", "x", "y")
    n = nodes.select("plane_id", "node_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    d = geom.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    best = lambda pair: pair.groupBy(key).agg(F.min(F.struct(d.alias("distance"), "node_id")).alias("best"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    found = None
    while size <= most:
        at = n.withColumn("i", steps).withColumn("j", steps).withColumn("cx", F.floor(F.col("nx") / size) + F.col("i")).withColumn("cy", F.floor(F.col("ny") / size) + F.col("j"))
        near = written(best(at_cell(p, size).join(at, ["plane_id", "cx", "cy"])).filter(F.col("best.distance") <= size))
        found = near if found is None else found.union(near)
        p = written(p.join(near.select(key), key, "left_anti"))
        if p.isEmpty():
            break
        size *= growth
    else:
        found = found.union(best(p.join(n, "plane_id")))
    return found.select(key, F.col("best.node_id").alias("node_id"), F.col("best.distance").alias("distance"))


#: About how many points one fold of a hull takes.
PART = 512


def hulls(points: DataFrame, *keys: str) -> DataFrame:
    """keys, hull: the convex hull of the points ``p`` of each key, as ``geom.hull`` gives it for all of them.

    A vertex is the lowest or highest point at its x and the first or last one at its y; only those are kept, by partial
    aggregates.  They shrink to hulls of parts of a bounded size before the parts of a key meet.
    """
    p = points.filter("p is not null").select(*keys, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    ends = lambda name: F.explode(F.array_distinct(F.array(f"{name}0", f"{name}1"))).alias(name)
    for name, other in (("x", "y"), ("y", "x")):
        p = p.groupBy(*keys, name).agg(F.min(other).alias(f"{other}0"), F.max(other).alias(f"{other}1")).select(*keys, name, ends(other))
    p = written(p)
    p = p.join(p.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts")), list(keys)).withColumn("_part", F.pmod(F.xxhash64("x", "y"), "_parts"))
    fold = lambda df, *by: df.groupBy(*by).agg(geom.hull(F.array_sort(F.collect_list("p"))).alias("hull"))
    parts = fold(p.select(*keys, "_part", geom.point(F.col("x"), F.col("y")).alias("p")), *keys, "_part")
    return fold(parts.select(*keys, F.explode("hull").alias("p")), *keys)


def ring_edges(spaces: DataFrame) -> DataFrame:
    """One row per ring edge: space_id, plane_id, ring_no (0: outer), a, b."""
    rings = spaces.select("space_id", "plane_id", F.posexplode(F.concat(F.array("polygon"), "holes")).alias("ring_no", "ring"))
    return rings.select("space_id", "plane_id", "ring_no", F.explode(geom.edges(F.col("ring"))).alias("e")).select("space_id", "plane_id", "ring_no", "e.a", "e.b")


def nodes_of_spaces(spaces: DataFrame, nodes: DataFrame, stops: DataFrame | None = None, reach: float = 0.5) -> DataFrame:
    """space_id, node_id: nodes inside a space, within ``reach`` of one of its rings, or stops that name it."""
    inside = containing(nodes, spaces).select("space_id", "node_id")
    e = ring_edges(spaces)
    edge_box = F.struct(F.least("a.x", "b.x").alias("x0"), F.least("a.y", "b.y").alias("y0"), F.greatest("a.x", "b.x").alias("x1"), F.greatest("a.y", "b.y").alias("y1"))
    near = at_cell(nodes).join(with_cells(e, edge_box, reach), ["plane_id", "cx", "cy"])
    near = near.filter(geom.distance_to_segment(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) <= reach).select("space_id", "node_id")
    both = inside.union(near)
    if stops is not None:
        both = both.union(stops.filter("space_id is not null").select("space_id", "node_id"))
    return both.distinct()


def hits(clicks: DataFrame, pois: DataFrame, spaces: DataFrame, key: str, radius: float) -> DataFrame:
    """key, kind, id: what a click finds: the first POI within ``radius``, else the last space in order."""
    shown = with_cells(pois.select("plane_id", "poi_id", F.col("x").alias("px"), F.col("y").alias("py")), F.struct(F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1")), radius)
    d = geom.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    found = at_cell(clicks).join(shown, ["plane_id", "cx", "cy"]).filter(d <= radius).groupBy(key).agg(F.min("poi_id").alias("id"))
    poi = found.select(key, F.lit(0).alias("rank"), F.lit("poi").alias("kind"), "id")
    space = first_space(clicks, spaces, key, last=True).select(key, F.lit(1).alias("rank"), F.lit("space").alias("kind"), F.col("space_id").alias("id"))
    best = poi.union(space).groupBy(key).agg(F.min(F.struct("rank", "kind", "id")).alias("b"))
    return best.select(key, "b.kind", "b.id")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def overlap_area(a: Column, a_holes: Column, b: Column, b_holes: Column) -> Column:
    """The area that two holed polygons share, by slabs between vertex and crossing heights.

    Inside a slab every edge is straight, so the shared length at half height times the slab's height is exact.
    """
    solid = lambda holes: F.filter(holes, lambda h: F.size(h) >= 3)
    all_edges = lambda p, holes: F.concat(geom.edges(p), F.flatten(F.transform(solid(holes), geom.edges)))

    def shared(s: Column) -> Column:
        ends = F.transform(F.concat(s.ea, s.eb), lambda e: e.a.y)
        meets = F.flatten(F.transform(s.ea, lambda p: F.transform(s.eb, lambda q: geom.crossing(p.a, p.b, q.a, q.b).y)))

        def spans(edges: Column, y: Column) -> Column:
            crossed = F.filter(edges, lambda e: (e.a.y > y) != (e.b.y > y))
            xs = F.array_sort(F.transform(crossed, lambda e: F.try_divide((e.b.x - e.a.x) * (y - e.a.y), e.b.y - e.a.y) + e.a.x))

            def pairs(xs: Column) -> Column:
                starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xs) - 2, F.lit(0))), lambda i: (i % 2 == 0) & (F.size(xs) >= 2))
                return F.transform(starts, lambda i: F.struct(F.get(xs, i).alias("l"), F.get(xs, i + 1).alias("r")))

            return _once(xs, pairs)

        def length(y: Column) -> Column:
            both = F.struct(spans(s.ea, y).alias("a"), spans(s.eb, y).alias("b"))
            shared_x = lambda t: F.flatten(F.transform(t.a, lambda p: F.transform(t.b, lambda q: F.greatest(F.lit(0.0), F.least(p.r, q.r) - F.greatest(p.l, q.l)))))
            return F.aggregate(_once(both, shared_x), F.lit(0.0), lambda t, v: t + v)

        def slabs(levels: Column) -> Column:
            return F.zip_with(F.slice(levels, 1, F.size(levels) - 1), F.slice(levels, 2, F.size(levels) - 1), lambda lo, hi: F.struct(((lo + hi) / 2).alias("y"), (hi - lo).alias("h")))

        levels = F.array_sort(F.array_distinct(F.concat(ends, F.array_compact(meets))))
        return F.aggregate(_once(levels, slabs), F.lit(0.0), lambda t, v: t + length(v.y) * v.h)

    sides = F.struct(all_edges(a, a_holes).alias("ea"), all_edges(b, b_holes).alias("eb"))
    return _once(sides, shared)


def overlapping(spaces: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """space_a, space_b (in order), area: pairs on a plane that share a positive area; touching is none.

    A pair meets in the first cell that both boxes touch only, so it is tested once.  What two boxes share bounds what the
    polygons share; the area itself is computed once for each pair, not again by a filter.
    """
    s = spaces.filter(F.size("polygon") >= 3).withColumn("box", geom.box(F.col("polygon")))
    cell = with_cells(s, F.col("box"))
    side = lambda n: cell.select("plane_id", "cx", "cy", *[F.col(c).alias(f"{c}_{n}") for c in ("space_id", "ord", "polygon", "holes", "box")])
    pair = side("a").join(side("b"), ["plane_id", "cx", "cy"])
    pair = pair.filter((F.struct("ord_a", "space_id_a") < F.struct("ord_b", "space_id_b")) & geom.boxes_meet(F.col("box_a"), F.col("box_b")))
    once = (F.col("cx") == F.floor(F.greatest("box_a.x0", "box_b.x0") / CELL)) & (F.col("cy") == F.floor(F.greatest("box_a.y0", "box_b.y0") / CELL))
    side_of = lambda axis: F.least(f"box_a.{axis}1", f"box_b.{axis}1") - F.greatest(f"box_a.{axis}0", f"box_b.{axis}0")
    area = overlap_area(F.col("polygon_a"), F.col("holes_a"), F.col("polygon_b"), F.col("holes_b"))
    some = F.filter(F.array(area), lambda v: v > epsilon)
    return pair.filter(once & (side_of("x") * side_of("y") > epsilon)).select(F.col("space_id_a").alias("space_a"), F.col("space_id_b").alias("space_b"), F.explode(some).alias("area"))


def hole_problems(spaces: DataFrame) -> DataFrame:
    """space_id, hole_no, problem: too few points, self-crossing, outside the outline, or meeting another hole; the first that applies."""
    h = spaces.select("space_id", "polygon", "holes", F.posexplode("holes").alias("hole_no", "hole"))
    outside = F.exists("hole", lambda p: ~geom.inside(p.x, p.y, F.col("polygon")) & (geom.distance_to_ring(p.x, p.y, F.col("polygon")) > EPSILON))
    crosses = F.exists(geom.edges(F.col("hole")), lambda e: F.exists(geom.edges(F.col("polygon")), lambda o: geom.crossing(e.a, e.b, o.a, o.b).isNotNull()))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    before = F.filter(F.slice("holes", F.lit(1), F.col("hole_no")), lambda o: (F.size(o) >= 3) & (overlap_area(F.col("hole"), none, o, none) > EPSILON))
    problem = F.when(F.size("hole") < 3, "too-few-vertices").when(geom.self_crossing(F.col("hole")), "self-intersecting").when(outside & ~crosses | outside, "outside").when(F.size(before) > 0, "overlapping")
    return h.select("space_id", "hole_no", problem.alias("problem")).filter("problem is not null")


#: What stands for a missing or unusable size of a door or opening, and of a window (metres).
OPENING = {"door": (0.9, 0.0, 2.1), "window": (1.2, 0.9, 1.2)}
WALL_THICKNESS, WALL_HEIGHT = 0.2, 2.4


def host_walls(openings: DataFrame, walls: DataFrame, slack: float = 0.2) -> DataFrame:
    """Doors, windows and openings with the wall that each cuts: entrance_id, wall_id, distance, from, to, bottom, top.

    Candidates are the named wall, or all if none is named, within half their thickness and ``slack``; the nearest is
    taken.  An opening without a candidate, or without an extent on its wall, has no row.
    """
    size = lambda c, default: F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c).otherwise(default)
    column = lambda df, name: F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
    w = walls.select("plane_id", F.col("wall_id").alias("w_id"), "sx", "sy", "ex", "ey", size(F.col("thickness"), F.lit(WALL_THICKNESS)).alias("thick"), size(column(walls, "height"), F.lit(WALL_HEIGHT)).alias("wall_height"))
    w = w.withColumn("reach", F.col("thick") / 2 + slack)
    box = F.struct((F.least("sx", "ex") - F.col("reach")).alias("x0"), (F.least("sy", "ey") - F.col("reach")).alias("y0"), (F.greatest("sx", "ex") + F.col("reach")).alias("x1"), (F.greatest("sy", "ey") + F.col("reach")).alias("y1"))
    o = openings.filter(F.col("type").isin("door", "window", "opening")) if "type" in openings.columns else openings.withColumn("type", F.lit("door"))
    window = F.col("type") == "window"
    of = lambda i: F.when(window, F.lit(OPENING["window"][i])).otherwise(F.lit(OPENING["door"][i]))
    sill = column(o, "sill_height")
    sill = F.when(window, F.greatest(F.lit(0.0), F.when(~F.isnan(sill) & (F.abs(sill) < float("inf")), sill).otherwise(of(1)))).otherwise(F.lit(0.0))
    o = o.select("entrance_id", "plane_id", "wall_id", "x", "y", size(column(o, "width"), of(0)).alias("width"), sill.alias("sill"), size(column(o, "height"), of(2)).alias("tall"))
    d = geom.distance_to_segment(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))
    near = at_cell(o).join(with_cells(w, box), ["plane_id", "cx", "cy"]).withColumn("distance", d)
    near = near.filter((F.col("distance") <= F.col("reach")) & (F.col("wall_id").isNull() | (F.col("wall_id") == F.col("w_id"))))
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    long = F.sqrt(dx * dx + dy * dy)
    along = F.greatest(F.lit(0.0), F.least(long, ((F.col("x") - F.col("sx")) * dx + (F.col("y") - F.col("sy")) * dy) / F.when(long > 0, long)))
    near = near.withColumn("long", long).withColumn("along", F.coalesce(along, F.lit(0.0)))
    best = near.groupBy("entrance_id").agg(F.min(F.struct("distance", "w_id", "long", "along", "width", "sill", "tall", "wall_height")).alias("b")).select("entrance_id", "b.*")
    cut = best.select(
        "entrance_id", F.col("w_id").alias("wall_id"), "distance", F.greatest(F.lit(0.0), F.col("along") - F.col("width") / 2).alias("from"), F.least("long", F.col("along") + F.col("width") / 2).alias("to"),
        F.col("sill").alias("bottom"), F.least("wall_height", F.col("sill") + F.col("tall")).alias("top"), "long",
    )
    return cut.filter((F.col("long") >= 0.01) & (F.col("top") > F.col("bottom")) & (F.col("to") - F.col("from") > 0.01)).drop("long")
