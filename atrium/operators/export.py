"""GeoJSON and IMDF features, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import spatial

#: IMDF categories of room types.
UNIT_CATEGORY = {"room": "room", "store": "room", "corridor": "walkway", "lobby": "lobby", "stairs": "stairs", "elevator": "elevator", "restricted": "nonpublic", "unknown": "unspecified"}


def uuid_of(*seed: Column) -> Column:
    """A UUID-shaped id: the same seed gives the same id."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *seed).cast("binary")), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-a$4-$5")


def pairs(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p.x, p.y))


def geometry(kind: str, coordinates: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))


def polygon(ring: Column, holes: Column) -> Column:
    """Outline counter-clockwise, holes clockwise, all closed; holes under three points left out."""
    inner = F.transform(F.filter(holes, lambda h: F.size(h) >= 3), lambda h: pairs(geom.oriented(h, clockwise=True)))
    return geometry("Polygon", F.concat(F.array(pairs(geom.oriented(ring))), inner))


def feature(df: DataFrame, kind: str, ident: str, shape: Column, properties: Column) -> DataFrame:
    whole = F.struct(F.lit("Feature").alias("type"), F.col(ident).cast("string").alias("id"), shape.alias("geometry"), properties.alias("properties"))
    return df.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), F.col("plane_id"), F.to_json(whole).alias("feature"))


def geojson(spaces: DataFrame, walls: DataFrame, entrances: DataFrame, pois: DataFrame) -> DataFrame:
    """kind, id, plane_id, feature (JSON) of every room, wall, entrance and POI."""
    at = geometry("Point", F.array("x", "y"))
    line = geometry("LineString", F.array(F.array("sx", "sy"), F.array("ex", "ey")))
    rows = [
        feature(spaces, "space", "space_id", polygon(F.col("polygon"), F.col("holes")), F.struct(F.lit("space").alias("kind"), "name", "type", "code")),
        feature(walls, "wall", "wall_id", line, F.struct(F.lit("wall").alias("kind"), "thickness", "height")),
        feature(entrances, "entrance", "entrance_id", at, F.struct(F.lit("entrance").alias("kind"), "type", "width")),
        feature(pois, "poi", "poi_id", at, F.struct(F.lit("poi").alias("kind"), "name")),
    ]
    return reduce(DataFrame.unionByName, rows)


def units(spaces: DataFrame, levels: DataFrame) -> DataFrame:
    """IMDF units on emitted levels (plane_id): id, level_id, category, geometry."""
    category = F.lit("unspecified")
    for kind, value in UNIT_CATEGORY.items():
        category = F.when(F.col("type") == kind, value).otherwise(category)
    return spaces.join(levels.select("plane_id"), "plane_id", "left_semi").select(uuid_of(F.lit("unit"), F.col("space_id")).alias("id"), uuid_of(F.lit("level"), F.col("plane_id")).alias("level_id"), category.alias("category"), F.to_json(polygon(F.col("polygon"), F.col("holes"))).alias("geometry"))


def levels(floors: DataFrame, spaces: DataFrame) -> DataFrame:
    """IMDF levels: the hull of each floor with rooms, its ordinal (0 at the ground) and what was skipped as empty."""
    corners = spatial.hulls(spaces.select("plane_id", F.explode("polygon").alias("p")), "plane_id").withColumnRenamed("hull", "outline")
    zero = floors.groupBy("building_id").agg(F.bool_or(F.col("level") == 0).alias("has_zero"))
    f = floors.join(zero, "building_id").join(corners, "plane_id", "left")
    ordinal = F.when(F.col("has_zero") | (F.col("level") < 1), F.col("level")).otherwise(F.col("level") - 1)
    return f.select("plane_id", "building_id", uuid_of(F.lit("level"), F.col("plane_id")).alias("id"), ordinal.alias("ordinal"), "outline", F.col("outline").isNull().alias("empty"))


def relationships(stops: DataFrame) -> DataFrame:
    """IMDF relationships of connectors: an elevator is one row, other types one for each pair of neighbours."""
    line = stops.groupBy("connector_id", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("elevation", "level", "node_id"))), lambda s: s.node_id).alias("nodes")).filter(F.size("nodes") >= 2)
    lift = line.filter("type = 'elevator'").select("connector_id", "type", F.get("nodes", F.lit(0)).alias("origin"), F.slice("nodes", 2, F.size("nodes") - 2).alias("between"), F.element_at("nodes", -1).alias("destination"))
    other = line.filter("type <> 'elevator'").select("connector_id", "type", F.explode(F.zip_with(F.slice("nodes", 1, F.size("nodes") - 1), F.slice("nodes", 2, F.size("nodes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return lift.union(other.select("connector_id", "type", "p.a", F.slice(F.array("p.a"), 1, 0), "p.b"))


def navigation_features(nodes: DataFrame, edges: DataFrame, lookup: DataFrame) -> DataFrame:
    """kind, id, plane_id, feature of nodes (points) and edges (lines).  ``lookup`` (node_id, x, y) has the ends; an edge without both is left out."""
    at = geometry("Point", F.array("x", "y"))
    points = feature(nodes, "navigationNode", "node_id", at, F.struct(F.lit("navigationNode").alias("kind"), F.col("node_id").cast("string").alias("id"), F.col("type").alias("nodeType")))
    side = lambda n, end: lookup.select(F.col("node_id").alias(end), F.array("x", "y").alias(n))
    lines = edges.join(side("a", "from_id"), "from_id").join(side("b", "to_id"), "to_id")
    one_way = F.when(F.col("one_way"), F.lit(True)).alias("oneWay")  # absent where it is not so
    about = F.struct(F.lit("navigationEdge").alias("kind"), F.col("edge_id").cast("string").alias("id"), F.col("type").alias("edgeType"), "distance", "accessible", one_way)
    return points.unionByName(feature(lines, "navigationEdge", "edge_id", geometry("LineString", F.array("a", "b")), about))


def placed(points: DataFrame, floors: DataFrame, sites: DataFrame, mode: str = "auto") -> DataFrame:
    """``points`` (plane_id, x, y) with ``coordinates`` by ``mode``: local, site, wgs84, or auto (wgs84 with a geographic anchor, else site).

    ``floors``: plane_id, project_id, ox, oy, bearing; ``sites``: project_id, lon, lat (null: no anchor).  Without an anchor wgs84 is
    refused: ``coordinates`` is null and ``refused`` true.
    """
    df = points.join(floors.select("plane_id", "project_id", "ox", "oy", "bearing"), "plane_id").join(sites.select("project_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), "project_id")
    df = df.withColumn("_s", geom.to_site(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), F.col("bearing")))
    df = df.withColumn("_g", geom.to_lng_lat(F.col("_s.x"), F.col("_s.y"), F.col("_lon"), F.col("_lat")))
    local, site, globe = F.array("x", "y"), F.array("_s.x", "_s.y"), F.when(F.col("_g").isNotNull(), F.array("_g.lon", "_g.lat"))
    out = {"local": local, "site": site, "wgs84": globe, "auto": F.coalesce(globe, site)}[mode]
    return df.withColumn("coordinates", out).withColumn("refused", out.isNull()).drop("_s", "_g", "_lon", "_lat", "ox", "oy", "bearing", "project_id")
