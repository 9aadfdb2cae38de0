"""Where routes start and end: nodes from which a spot can be walked to without crossing a wall or a hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import spatial
from atrium.operators.routing import written

#: Crossings so near to an end of a walk do not count; doors are so wide where no width is given.
END, PASSAGE, BESIDE, SPARE = 0.05, 0.9, 0.3, 0.05


def _span(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.struct(F.least(ax, bx).alias("x0"), F.least(ay, by).alias("y0"), F.greatest(ax, bx).alias("x1"), F.greatest(ay, by).alias("y1"))


def blocked(walks: DataFrame, walls: DataFrame, entrances: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """walk_id of walks (walk_id, plane_id, ax, ay, bx, by, and space_id if holes count) that cross a wall outside a doorway, or a hole of their space."""
    end = lambda x, y: (geom.distance(x, y, F.col("ax"), F.col("ay")) <= END) | (geom.distance(x, y, F.col("bx"), F.col("by")) <= END)
    a, b = geom.point(F.col("ax"), F.col("ay")), geom.point(F.col("bx"), F.col("by"))
    w = spatial.with_cells(walls.select("plane_id", "wall_id", "sx", "sy", "ex", "ey"), _span("sx", "sy", "ex", "ey"))
    pair = spatial.with_cells(walks, _span("ax", "ay", "bx", "by")).join(w, ["plane_id", "cx", "cy"])
    hit = pair.withColumn("p", geom.crossing(a, b, geom.point(F.col("sx"), F.col("sy")), geom.point(F.col("ex"), F.col("ey")))).filter("p is not null").filter(~end(F.col("p.x"), F.col("p.y")))
    hit = hit.select("walk_id", "plane_id", F.col("wall_id").alias("crossed"), "sx", "sy", "ex", "ey", "p").dropDuplicates(["walk_id", "crossed"])
    hit = spatial.at_cell(hit.withColumn("x", F.col("p.x")).withColumn("y", F.col("p.y")))
    reach = F.coalesce("width", F.lit(PASSAGE)) / 2 + SPARE
    around = F.struct((F.col("x") - reach).alias("x0"), (F.col("y") - reach).alias("y0"), (F.col("x") + reach).alias("x1"), (F.col("y") + reach).alias("y1"))
    door = spatial.with_cells(entrances.filter("type <> 'window'"), around).select(F.col("plane_id").alias("d_plane"), F.col("cx").alias("d_cx"), F.col("cy").alias("d_cy"), F.col("wall_id").alias("d_wall"), F.col("x").alias("dx"), F.col("y").alias("dy"), (F.coalesce("width", F.lit(PASSAGE)) / 2 + SPARE).alias("reach"))
    on_wall = (F.col("d_wall") == F.col("crossed")) | (geom.distance_to_segment(F.col("dx"), F.col("dy"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")) < BESIDE)
    through = (F.col("plane_id") == F.col("d_plane")) & (F.col("cx") == F.col("d_cx")) & (F.col("cy") == F.col("d_cy")) & (geom.distance(F.col("dx"), F.col("dy"), F.col("p.x"), F.col("p.y")) <= F.col("reach")) & F.coalesce(on_wall, F.lit(False))
    out = hit.join(door, through, "left_anti").select("walk_id")
    if spaces is not None:
        holes = spaces.filter(F.size("holes") > 0).select("space_id", F.flatten(F.transform("holes", geom.edges)).alias("edges"))
        meets = F.exists("edges", lambda e: F.coalesce(~end(geom.crossing(a, b, e.a, e.b).x, geom.crossing(a, b, e.a, e.b).y), F.lit(False)))
        out = out.union(walks.join(holes, "space_id").filter(meets).select("walk_id"))
    return out.distinct()


def walks_within(spots: DataFrame, nodes: DataFrame, key: str, reach: float) -> DataFrame:
    """walk_id (key, node_id), plane_id, ax, ay, bx, by: a walk from each node to each spot (key, plane_id, x, y) at most ``reach`` away; they meet in cells as wide."""
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = nodes.select("plane_id", "node_id", F.col("x").alias("ax"), F.col("y").alias("ay")).withColumn("i", steps).withColumn("j", steps)
    around = around.withColumn("cx", F.floor(F.col("ax") / reach) + F.col("i")).withColumn("cy", F.floor(F.col("ay") / reach) + F.col("j")).drop("i", "j")
    near = spatial.at_cell(spots.select(key, "plane_id", "x", "y"), reach).join(around, ["plane_id", "cx", "cy"]).filter(geom.distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay")) <= reach)
    return written(near.select(F.struct(key, "node_id").alias("walk_id"), "plane_id", "ax", "ay", F.col("x").alias("bx"), F.col("y").alias("by")))


def anchors(spots: DataFrame, spaces: DataFrame, nodes: DataFrame, walls: DataFrame, entrances: DataFrame, key: str, reach: float = 8.0, most: float = 5000.0) -> DataFrame:
    """key, node_id, distance: the clear nodes of the space of a spot, else the nearest clear node of its plane (the smallest id on ties).

    The space is the one that the spot states (``space_id``, if there is such a column and the plane has that space), else the first that
    contains it.  For the nearest clear node a spot looks at the nodes within ``reach`` first; spots that find none look again
    four times as far, up to ``most`` metres.  Spots at the same place that state the same space ask once.
    """
    named = F.col("space_id") if "space_id" in spots.columns else F.lit(None).cast(spaces.schema["space_id"].dataType)
    every = written(spots.select(key, "plane_id", "x", "y", named.alias("stated")))
    one = written(every.groupBy("plane_id", "x", "y", "stated").agg(F.min(key).alias("one")))
    e, o = every.alias("e"), one.alias("o")
    same = (F.col("e.stated").eqNullSafe(F.col("o.stated"))) & (F.col("e.plane_id") == F.col("o.plane_id")) & (F.col("e.x") == F.col("o.x")) & (F.col("e.y") == F.col("o.y"))
    found = _anchors(one.withColumnRenamed("one", key), spaces, nodes, walls, entrances, key, reach, most).withColumnRenamed(key, "one")
    return e.join(o, same).select(key, "one").join(found, "one").select(key, "node_id", "distance")


def _anchors(spots: DataFrame, spaces: DataFrame, nodes: DataFrame, walls: DataFrame, entrances: DataFrame, key: str, reach: float, most: float) -> DataFrame:
    """``anchors`` of spots (key, plane_id, x, y, stated) that all differ."""
    known = spaces.select("plane_id", F.col("space_id").alias("stated"), F.col("space_id").alias("own"))
    home = spatial.first_space(spots.drop("stated"), spaces, key)
    placed = spots.join(known, ["plane_id", "stated"], "left").join(home, key, "left").select(key, "plane_id", "x", "y", F.coalesce("own", "space_id").alias("space_id"))
    at = nodes.select("plane_id", "node_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    ident = F.struct(F.col(key), F.col("node_id"))
    far = geom.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))

    def clear(pairs: DataFrame) -> DataFrame:
        w = pairs.select(ident.alias("walk_id"), "plane_id", "space_id", F.col("nx").alias("ax"), F.col("ny").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
        gone = blocked(w, walls, entrances, spaces).select(F.col("walk_id")[key].alias(key), F.col("walk_id.node_id").alias("node_id"))
        return pairs.join(gone, [key, "node_id"], "left_anti").select(key, "node_id", far.alias("distance"))

    placed = written(placed)
    homes = spaces.join(placed.select("space_id").distinct(), "space_id", "left_semi")
    of_space = spatial.nodes_of_spaces(homes, nodes.select("plane_id", "node_id", "x", "y"))
    found = written(clear(placed.join(of_space, "space_id").join(at, ["plane_id", "node_id"])))
    left = written(placed.join(found.select(key).distinct(), key, "left_anti"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while reach <= most and not left.isEmpty():
        around = at.withColumn("i", steps).withColumn("j", steps).withColumn("cx", F.floor(F.col("nx") / reach) + F.col("i")).withColumn("cy", F.floor(F.col("ny") / reach) + F.col("j"))
        near = clear(spatial.at_cell(left, reach).join(around, ["plane_id", "cx", "cy"]).filter(far <= reach))
        best = written(near.groupBy(key).agg(F.min(F.struct("distance", "node_id")).alias("b")).select(key, "b.node_id", "b.distance"))
        found = found.unionByName(best)
        left = written(left.join(best.select(key), key, "left_anti").join(at.select("plane_id").distinct(), "plane_id", "left_semi"))
        reach *= 4
    return found


def resolved(ends: DataFrame, pois: DataFrame, spaces: DataFrame, nodes: DataFrame, walls: DataFrame, entrances: DataFrame, stops: DataFrame | None = None, key: str = "end_id") -> DataFrame:
    """key, node_id, distance: where a route may begin or end, for ends of four kinds (columns key, kind, ref_id, plane_id, x, y).

    ``node``: the node itself.  ``poi``: the clear nodes of the space that it states or stands in, else the nearest clear one.  ``space``:
    its nodes at no cost, else as for its middle.  ``position``: like a POI that states no space.  What does not exist has no row.
    """
    of = lambda kind: ends.filter(F.col("kind") == kind)
    node = of("node").join(nodes.select(F.col("node_id").alias("ref_id")), "ref_id").select(key, F.col("ref_id").alias("node_id"), F.lit(0.0).alias("distance"))
    room = of("space").select(key, F.col("ref_id").alias("space_id")).join(spaces.select("space_id", "plane_id", "polygon"), "space_id")
    own = room.join(spatial.nodes_of_spaces(spaces, nodes.select("plane_id", "node_id", "x", "y"), stops), "space_id").select(key, "node_id", F.lit(0.0).alias("distance"))
    own = written(own)
    mid = geom.centroid(F.col("polygon"))
    none = F.lit(None).cast(spaces.schema["space_id"].dataType)
    middle = room.join(own.select(key).distinct(), key, "left_anti").select(key, "plane_id", mid.x.alias("x"), mid.y.alias("y"), none.alias("space_id"))
    stated = F.col("space_id") if "space_id" in pois.columns else none
    at_poi = of("poi").select(key, F.col("ref_id").alias("poi_id")).join(pois.select("poi_id", "plane_id", "x", "y", stated.alias("space_id")), "poi_id").drop("poi_id")
    free = of("position").select(key, "plane_id", "x", "y", none.alias("space_id"))
    spots = at_poi.unionByName(free).unionByName(middle)
    return node.unionByName(own).unionByName(anchors(spots, spaces, nodes, walls, entrances, key))
