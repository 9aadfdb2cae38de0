"""The routing graph as edge tables: connectors become timed edges, outdoor links are measured, and all are directed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.functions import geom
from atrium.operators import spatial
from atrium.operators.routing import written

#: Walking speed (m/s), storey height (m), and speed, wait and boarding time of each connector type.
WALKING_SPEED, STOREY_HEIGHT = 1.2, 4.0
TIMING = {"elevator": (1.5, 30.0, 10.0), "escalator": (0.5, 0.0, 0.0), "stairs": (0.4, 0.0, 0.0), "ramp": (None, 0.0, 0.0)}


def usable(value: Column | None, zero: bool = False) -> Column:
    """``value`` where it is a positive finite number (or 0, with ``zero``), else null."""
    if value is None:
        return F.lit(None).cast("double")
    good = ((value >= 0) if zero else (value > 0)) & ~F.isnan(value) & (value != float("inf"))
    return F.when(good, value)


def walking_speed(asked: float | None) -> float:
    return asked if asked is not None and 0 < asked < float("inf") else WALKING_SPEED


def timing(df: DataFrame, asked_speed: float | None = None, defaults: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds speed, wait, boarding: the connector's own (spec_speed, spec_wait, spec_boarding), else the caller's, else built-in."""
    walk = walking_speed(asked_speed)
    for i, (out, own, key) in enumerate((("speed", "spec_speed", "speed"), ("wait", "spec_wait", "averageWait"), ("boarding", "spec_boarding", "boardingTime"))):
        built_in, caller = F.lit(None).cast("double"), F.lit(None).cast("double")
        for kind, values in TIMING.items():
            built_in = F.when(F.col("type") == kind, F.lit(walk if values[i] is None else values[i])).otherwise(built_in)
            given = (defaults or {}).get(kind, {}).get(key)
            if given is not None:
                caller = F.when(F.col("type") == kind, F.lit(float(given))).otherwise(caller)
        value = F.col(own).cast("double") if own in df.columns else None
        df = df.withColumn(out, F.coalesce(usable(value, i > 0), usable(caller, i > 0), built_in))
    return df


def vertical_gap(a_elevation: Column, a_level: Column, b_elevation: Column, b_level: Column) -> Column:
    rise = F.abs(b_elevation - a_elevation)
    return F.when(rise > 0, rise).otherwise(F.abs(b_level - a_level) * STOREY_HEIGHT)


def connector_edges(stops: DataFrame, asked_speed: float | None = None, defaults: dict | None = None) -> DataFrame:
    """Edges of connectors from stops (connector_id, project_id, type, plane_id, node_id, x, y, elevation, level, ord, accessible, direction).

    Elevators join every pair of stops; other types join neighbours by elevation.  The first stop of a floor counts.
    """
    walk = walking_speed(asked_speed)
    first = Window.partitionBy("connector_id", "plane_id").orderBy("ord")
    rank = Window.partitionBy("connector_id").orderBy("elevation", "level", "ord")
    s = stops.withColumn("k", F.row_number().over(first)).filter("k = 1").withColumn("rank", F.row_number().over(rank))
    s = timing(s, asked_speed, defaults)
    b = s.select("connector_id", *[F.col(c).alias(f"b_{c}") for c in ("node_id", "x", "y", "elevation", "level", "rank")])
    near = (F.col("type") == "elevator") & (F.col("b_rank") > F.col("rank")) | (F.col("type") != "elevator") & (F.col("b_rank") == F.col("rank") + 1)
    pair = s.join(b, "connector_id").filter(near)
    up = vertical_gap(F.col("elevation"), F.col("level"), F.col("b_elevation"), F.col("b_level"))
    flat = geom.distance(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))
    pair = pair.withColumn("up", up).withColumn("flat", flat).withColumn("incline", F.sqrt(F.col("flat") * F.col("flat") + F.col("up") * F.col("up")))
    seconds = (
        F.when(F.col("type") == "elevator", F.col("wait") + F.col("boarding") + F.col("up") / F.col("speed"))
        .when(F.col("type") == "stairs", F.col("boarding") + F.col("up") / F.col("speed") + F.col("flat") / walk)
        .otherwise(F.col("wait") + F.col("boarding") + F.col("incline") / F.col("speed"))
    )
    down = (F.col("type") == "escalator") & (F.col("direction") == "down")
    ends = (F.when(down, F.col("b_node_id")).otherwise(F.col("node_id")), F.when(down, F.col("node_id")).otherwise(F.col("b_node_id")))
    return pair.select(
        "project_id", F.concat(F.col("connector_id").cast("string"), F.lit(":"), ends[0].cast("string"), F.lit("->"), ends[1].cast("string")).alias("edge_id"), ends[0].alias("from_id"), ends[1].alias("to_id"),
        F.when(F.col("type") == "ramp", F.lit("walk")).otherwise(F.col("type")).alias("type"), F.when(F.col("type") == "elevator", F.col("up")).otherwise(F.col("incline")).alias("distance"), "accessible",
        ((F.col("type") == "escalator") & F.col("direction").isin("up", "down")).alias("one_way"), seconds.alias("duration"),
    )


def site_edges(edges: DataFrame, site_nodes: DataFrame, nodes: DataFrame, floors: DataFrame) -> DataFrame:
    """Outdoor edges; where an end is a building node the length is measured in the site frame."""
    placed = nodes.join(floors.select("plane_id", "ox", "oy", "bearing"), "plane_id").withColumn("s", geom.to_site(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), F.col("bearing")))
    at = site_nodes.select("node_id", "x", "y", F.lit(True).alias("outdoor")).union(placed.select("node_id", "s.x", "s.y", F.lit(False)))
    side = lambda n, end: at.toDF(end, f"{n}x", f"{n}y", f"{n}out")
    e = edges.join(side("a", "from_id"), "from_id", "left").join(side("b", "to_id"), "to_id", "left")
    real = geom.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    length = F.when(F.col("aout") & F.col("bout"), F.col("distance")).otherwise(F.coalesce(real, F.col("distance")))
    return e.withColumn("distance", length).drop("ax", "ay", "aout", "bx", "by", "bout")


def climb_footprints(entrances: DataFrame, spaces: DataFrame) -> DataFrame:
    """plane_id, kind, ord, polygon: where one can only climb: the plans of stairs and escalators (turned rectangles), then stair rooms."""
    e = entrances.filter(F.col("type").isin("stairs", "escalator"))
    number = lambda name, default: F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in e.columns else F.lit(default)
    turn = F.radians(number("rotation", 0.0))
    half = (number("depth", 4.0) / 2, number("width", 1.2) / 2)
    corner = lambda a, b: F.struct((F.col("x") + F.cos(turn) * half[0] * a - F.sin(turn) * half[1] * b).alias("x"), (F.col("y") + F.sin(turn) * half[0] * a + F.cos(turn) * half[1] * b).alias("y"))
    plans = e.select("plane_id", F.col("type").alias("kind"), F.struct(F.lit(0).alias("rank"), F.col("entrance_id").cast("long").alias("id")).alias("ord"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("polygon"))
    rooms = spaces.filter((F.col("type") == "stairs") & (F.size("polygon") >= 3))
    return plans.union(rooms.select("plane_id", F.lit("stairs"), F.struct(F.lit(1).alias("rank"), F.col("ord").cast("long").alias("id")), "polygon"))


def climbing_edges(edges: DataFrame, nodes: DataFrame, footprints: DataFrame, every: float = 0.1) -> DataFrame:
    """``edges`` with those walk edges that run through a footprint, or join two stair nodes, as stairs or escalator and not accessible.

    An edge is looked at every ``every`` metres between its ends; the first place in a footprint decides, there the first footprint.
    """
    at = nodes.select("node_id", "plane_id", "x", "y", "type")
    side = lambda n, end: at.select(F.col("node_id").alias(end), F.col("plane_id").alias(f"{n}plane"), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), F.col("type").alias(f"{n}type"))
    walks = edges.filter("type = 'walk'").select("edge_id", "plane_id", "from_id", "to_id").join(side("a", "from_id"), "from_id").join(side("b", "to_id"), "to_id")
    stairs = walks.filter("atype = 'stairs' and btype = 'stairs'").select("edge_id", F.lit("stairs").alias("climb"), F.lit(0).alias("i"), F.lit(None).cast("struct<rank:int,id:bigint>").alias("ord"))
    box = F.struct(F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))
    # an edge meets a footprint in the cells of both boxes; samples are made for such pairs only
    pair = spatial.with_cells(walks, box).join(spatial.with_cells(footprints, geom.box(F.col("polygon"))), ["plane_id", "cx", "cy"]).dropDuplicates(["edge_id", "ord"])
    steps = F.greatest(F.lit(2), F.ceil(geom.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) / every).cast("int"))
    tried = pair.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("steps") - 1)))
    spot = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") / F.col("steps"))
    crossed = tried.filter(geom.inside(spot("ax", "bx"), spot("ay", "by"), F.col("polygon"))).select("edge_id", F.col("kind").alias("climb"), "i", "ord")
    first = stairs.union(crossed).groupBy("edge_id").agg(F.min(F.struct("i", "ord", "climb")).alias("f")).select("edge_id", "f.climb")
    out = edges.join(first, "edge_id", "left")
    typed = {"type": F.coalesce("climb", "type"), "accessible": F.when(F.col("climb").isNotNull(), False).otherwise(F.col("accessible"))}
    return out.withColumns(typed).drop("climb")


EDGE = ["project_id", "edge_id", "from_id", "to_id", "type", "distance", "accessible", "one_way", "duration"]


def routing_graph(walks: DataFrame, outdoor: DataFrame, connectors: DataFrame) -> DataFrame:
    """All edges of all projects."""
    plain = lambda df: df.withColumn("duration", F.lit(None).cast("double")).select(*EDGE)
    return plain(walks).unionByName(plain(outdoor)).unionByName(connectors.select(*EDGE))


def adjacency(edges: DataFrame, node_ids: DataFrame, asked_speed: float | None = None, prefer_elevator: bool = False) -> DataFrame:
    """Directed edges between known nodes: src, dst, edge_id, type, metres, seconds, weight (elevators at half when preferred).

    The edges are written before their ends are looked up, and those that stay once more: otherwise each kind of edge, in each direction, is made and
    looked up on its own, all within one task of the union.
    """
    ids = written(node_ids.select("node_id").distinct())
    known = written(written(edges).join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi"))
    seconds = F.coalesce("duration", F.col("distance") / walking_speed(asked_speed))
    weight = F.when((F.col("type") == "elevator") & F.lit(prefer_elevator), seconds / 2).otherwise(seconds)
    one = known.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_id", "type", "accessible", F.col("distance").alias("metres"), seconds.alias("seconds"), weight.alias("weight"), "one_way")
    back = one.filter(~F.col("one_way")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in one.columns if c not in ("src", "dst")])
    return one.union(back).drop("one_way")


def passable(adjacent: DataFrame, require_accessible: bool = False, avoid_stairs: bool = False) -> DataFrame:
    out = adjacent.filter("accessible") if require_accessible else adjacent
    return out.filter("type <> 'stairs'") if avoid_stairs else out
