"""Map validation: one DataFrame of issues for each rule, joined by a union.

Every rule gives severity, type, object_id (string) and message; ids of issues are hashes of those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.functions import geom
from atrium.operators import spatial
from atrium.operators.routing import written

#: Heights that apply where none is given, in metres.
WALL_HEIGHT, DOOR_HEIGHT, WINDOW_HEIGHT, WINDOW_SILL = 2.4, 2.1, 1.2, 0.9


def issue(df: DataFrame, severity: str, kind: str, object_id: Column | str, message: Column | str = "") -> DataFrame:
    ident = (F.col(object_id) if isinstance(object_id, str) else object_id).cast("string")
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), ident.alias("object_id"), text.alias("message"))


def combined(issues: list[DataFrame]) -> DataFrame:
    """All issues with their ids.  Each rule runs and is written on its own, so that the driver holds the plan and the broadcast tables of one rule and not of all."""
    out = reduce(DataFrame.unionByName, [written(rule) for rule in issues])
    return out.withColumn("issue_id", F.xxhash64("type", "object_id", "message"))


def too_few_vertices(spaces: DataFrame) -> DataFrame:
    return issue(spaces.filter(F.size("polygon") < 3), "error", "invalid-polygon", "space_id")


def self_intersecting(spaces: DataFrame) -> DataFrame:
    return issue(spaces.filter(geom.self_crossing(F.col("polygon"))), "error", "self-intersecting-polygon", "space_id")


def bad_holes(spaces: DataFrame) -> DataFrame:
    found = spatial.hole_problems(spaces.filter(F.size("polygon") >= 3))
    return issue(found, "error", "invalid-hole", "space_id", F.concat_ws(" ", F.lit("hole"), "hole_no", "problem"))


def unknown_type(spaces: DataFrame) -> DataFrame:
    return issue(spaces.filter((F.size("polygon") >= 3) & (F.col("type") == "unknown")), "warning", "unknown-space-type", "space_id")


def overlaps(spaces: DataFrame) -> DataFrame:
    pairs = spatial.overlapping(spaces)
    both = pairs.select(F.explode(F.array(F.struct(F.col("space_a").alias("id"), F.col("space_b").alias("other")), F.struct(F.col("space_b").alias("id"), F.col("space_a").alias("other")))).alias("p"))
    return issue(both, "error", "overlapping-spaces", "p.id", F.concat(F.lit("overlaps "), F.col("p.other").cast("string")))


def walls(df: DataFrame) -> DataFrame:
    length = geom.distance(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))
    return issue(df.filter(length < 0.01), "error", "degenerate-wall", "wall_id").union(issue(df.filter("thickness <= 0"), "error", "invalid-wall-thickness", "wall_id"))


def dimensions(entrances: DataFrame) -> DataFrame:
    """Sizes that are not positive or not finite, step counts outside 2 to 200, negative sills and landings, angles that are not finite."""
    has = set(entrances.columns)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    tests = []
    for name in ("width", "height", "depth"):
        tests.append((name, lambda v: ~finite(v) | (v <= 0)))
    tests.append(("step_count", lambda v: ~finite(v) | (v != F.floor(v)) | (v < 2) | (v > 200)))
    for name in ("sill_height", "landing_depth"):
        tests.append((name, lambda v: ~finite(v) | (v < 0)))
    for name in ("rotation", "door_open_angle"):
        tests.append((name, lambda v: ~finite(v)))
    bad = [F.when(F.coalesce(test(F.col(n).cast("double")), F.lit(False)), F.lit(n)) for n, test in tests if n in has]
    rows = entrances.withColumn("_bad", F.explode(F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")))
    return issue(rows, "error", "invalid-element-dimension", "entrance_id", F.col("_bad"))


def missing_hosts(entrances: DataFrame, walls: DataFrame) -> DataFrame:
    gone = entrances.filter("wall_id is not null").join(walls.select("plane_id", "wall_id"), ["plane_id", "wall_id"], "left_anti")
    return issue(gone, "warning", "missing-host-wall", "entrance_id")


def above_walls(entrances: DataFrame, walls: DataFrame) -> DataFrame:
    w = walls.select("plane_id", "wall_id", F.coalesce("height", F.lit(WALL_HEIGHT)).alias("wall_height"))
    window = F.col("type") == "window"
    own = F.coalesce("height", F.when(window, WINDOW_HEIGHT).otherwise(DOOR_HEIGHT))
    sill = F.coalesce("sill_height", F.lit(WINDOW_SILL)) if "sill_height" in entrances.columns else F.lit(WINDOW_SILL)
    top = own + F.when(window, sill).otherwise(0.0)
    return issue(entrances.join(w, ["plane_id", "wall_id"]).filter(top > F.col("wall_height")), "warning", "opening-above-wall", "entrance_id")


def disconnected_entrances(entrances: DataFrame, spaces: DataFrame) -> DataFrame:
    sides = [c for c in ("space_a", "space_b") if c in entrances.columns]
    ids = spaces.select("plane_id", F.col("space_id").alias("side"))
    named = [entrances.select("entrance_id", "plane_id", F.col(c).alias("side")).filter("side is not null").join(ids, ["plane_id", "side"], "left_anti") for c in sides]
    bare = entrances.filter(F.coalesce(*sides).isNull() & (F.col("type") != "window"))
    return issue(reduce(DataFrame.union, named), "error", "disconnected-entrance", "entrance_id").union(issue(bare, "warning", "disconnected-entrance", "entrance_id"))


def dangling(df: DataFrame, kind: str, key: str, spaces: DataFrame) -> DataFrame:
    """POIs or furniture that name a space that is not on their plane."""
    gone = df.filter("space_id is not null").join(spaces.select("plane_id", "space_id"), ["plane_id", "space_id"], "left_anti")
    return issue(gone, "error", kind, key)


def dangling_members(members: DataFrame, objects: DataFrame) -> DataFrame:
    """Group members (group_id, plane_id, member_id) among no object (plane_id, object_id) of their floor."""
    gone = members.join(objects.select("plane_id", F.col("object_id").alias("member_id")), ["plane_id", "member_id"], "left_anti")
    return issue(gone, "warning", "dangling-group-member", "group_id", F.col("member_id").cast("string"))


def broken_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among no node (node_id); the message names the first missing end."""
    n = nodes.select("node_id").distinct()
    a, b = n.select(F.col("node_id").alias("from_id"), F.lit(True).alias("has_from")), n.select(F.col("node_id").alias("to_id"), F.lit(True).alias("has_to"))
    found = edges.join(a, "from_id", "left").join(b, "to_id", "left").filter("has_from is null or has_to is null")
    return issue(found, "error", "broken-navigation-edge", "edge_id", F.when(F.col("has_from").isNull(), F.col("from_id")).otherwise(F.col("to_id")).cast("string"))


def inaccurate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges on one plane whose stored length is off by more than a fifth of the real one and more than a metre."""
    n = nodes.select("node_id", "plane_id", "x", "y")
    a, b = n.toDF("from_id", "plane_a", "ax", "ay"), n.toDF("to_id", "plane_b", "bx", "by")
    real = geom.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    off = edges.join(a, "from_id").join(b, "to_id").filter("plane_a = plane_b").filter(F.abs(F.col("distance") - real) > F.greatest(real * 0.2, F.lit(1.0)))
    return issue(off, "warning", "inaccurate-edge-distance", "edge_id")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    pair = Window.partitionBy("plane_id", F.least("from_id", "to_id"), F.greatest("from_id", "to_id"))
    return issue(edges.withColumn("n", F.count(F.lit(1)).over(pair)).filter("n > 1"), "warning", "duplicate-navigation-edge", "edge_id")


def lonely_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes on no link (node ids ``from_id``, ``to_id``) on floors with more than one node."""
    used = links.select(F.col("from_id").alias("node_id")).union(links.select("to_id")).distinct()
    crowd = nodes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("plane_id"))).filter("n > 1")
    return issue(crowd.join(used, "node_id", "left_anti"), "warning", "disconnected-navigation-node", "node_id")


def unconnected_floors(floors: DataFrame, stops: DataFrame, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Floors of buildings with two or more that neither a connector with a second floor nor a stairs, elevator or escalator edge to a node elsewhere links."""
    many = floors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("building_id"))).filter("n > 1")
    joined = stops.withColumn("k", F.size(F.collect_set("plane_id").over(Window.partitionBy("connector_id")))).filter("k > 1").select("plane_id")
    if edges is not None:
        at = nodes.select("node_id", "plane_id")
        climbs = edges.filter(F.col("type").isin("stairs", "elevator", "escalator")).select("from_id", "to_id")
        ends = climbs.join(at.toDF("from_id", "from_plane"), "from_id").join(at.toDF("to_id", "to_plane"), "to_id").filter("from_plane <> to_plane")
        joined = joined.union(ends.select("from_plane")).union(ends.select("to_plane"))
    return issue(many.join(joined.distinct(), "plane_id", "left_anti"), "warning", "missing-floor-connection", "plane_id")


def stops_without_space(stops: DataFrame, floors: DataFrame, spaces: DataFrame) -> DataFrame:
    """Stops that name a space (space_id) which is missing, on floors that are there."""
    named = stops.filter("space_id is not null").join(floors.select("plane_id"), "plane_id", "left_semi")
    return issue(named.join(spaces.select("space_id"), "space_id", "left_anti"), "warning", "connector-missing-space", "connector_id")


def connector_stops(connectors: DataFrame, stops: DataFrame, floors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Too few stops, a second stop on a floor, and stops whose floor or node is missing."""
    counted = connectors.join(stops.groupBy("connector_id").agg(F.count(F.lit(1)).alias("n")), "connector_id", "left")
    few = issue(counted.filter("coalesce(n, 0) < 2"), "warning", "connector-too-few-stops", "connector_id")
    order = Window.partitionBy("connector_id", "plane_id").orderBy("ord")
    again = issue(stops.withColumn("k", F.row_number().over(order)).filter("k > 1"), "warning", "connector-duplicate-floor", "connector_id", F.col("plane_id").cast("string"))
    lost = stops.join(floors.select("plane_id"), "plane_id", "left_anti")
    here = stops.join(floors.select("plane_id"), "plane_id", "left_semi").join(nodes.select("plane_id", "node_id"), ["plane_id", "node_id"], "left_anti")
    return reduce(DataFrame.union, [few, again, issue(lost, "error", "connector-missing-floor", "connector_id"), issue(here, "error", "connector-missing-node", "connector_id")])


def wrong_plane(site_nodes: DataFrame) -> DataFrame:
    """Outdoor nodes (node_id, plane_id, site_id) that do not carry the site's plane."""
    return issue(site_nodes.filter(~F.col("plane_id").eqNullSafe(F.col("site_id"))), "error", "site-node-wrong-plane", "node_id")


def duplicate_external_ids(objects: DataFrame) -> DataFrame:
    """Every owner (project_id, object_id, external_id) of an external id that is used twice in a project."""
    named = objects.filter("external_id is not null and external_id <> ''")
    shared = named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("project_id", "external_id"))).filter("n > 1")
    return issue(shared, "warning", "duplicate-external-id", "object_id", F.col("external_id").cast("string"))


def duplicate_floor_links(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Edges whose two ends are stops of one connector; the message names the first such connector."""
    s = stops.select("connector_id", "node_id")
    a, b = s.toDF("connector_id", "from_id"), s.toDF("connector_id", "to_id")
    found = edges.join(a, "from_id").join(b, ["connector_id", "to_id"]).groupBy("edge_id").agg(F.min("connector_id").alias("connector_id"))
    return issue(found, "warning", "duplicate-floor-link", "edge_id", F.col("connector_id").cast("string"))
