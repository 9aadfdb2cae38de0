"""Bulk changes of the map's networks: floors cleared, links over floors and outdoors, buildings moved, walks drawn, doors given their sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.functions import geom
from atrium.operators import graph, maintain, spatial


def cleared_floors(tables: dict[str, DataFrame], floors: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table once the floors (plane_id) are emptied.

    Rows on the floors go, and with the floors' nodes each edge that ends at one, wherever the edge is kept.
    """
    emptied = floors.select("plane_id").distinct()
    gone = tables["nodes"].join(emptied, "plane_id", "left_semi").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    out = {}
    for name, df in tables.items():
        left = df.join(emptied, "plane_id", "left_anti") if "plane_id" in df.columns else df
        for end in ("from_id", "to_id"):
            if end in df.columns:
                left = maintain.without(left, gone, end, "node")
        out[name] = left
    return out


def cross_floor_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` whose ends stand on different floors, with from_plane and to_plane."""
    side = lambda end, plane: nodes.select(F.col("node_id").alias(end), F.col("plane_id").alias(plane))
    return edges.join(side("from_id", "from_plane"), "from_id").join(side("to_id", "to_plane"), "to_id").filter("from_plane <> to_plane")


def linked_nodes(links: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Links over floors (edge_id, from_id, to_id, type, distance) after ``asked`` (ord, node_id, target_id, type) took effect in order.

    A node has one such link at most, so a request drops the links of both its nodes, and what stays of the requests are those after
    which neither node was named again: no replay is needed.  Without a target (null, or in no floor of the node's building) the
    node's link only goes.  The length is measured in plan; requests of unknown nodes do nothing.
    """
    at = nodes.select("node_id", "building_id", "x", "y")
    a = asked.join(at, "node_id")
    t = at.select(F.col("node_id").alias("target_id"), F.col("building_id").alias("t_building"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    a = a.join(t, "target_id", "left").withColumn("known", F.coalesce(F.col("t_building") == F.col("building_id"), F.lit(False)))
    touched = a.select("node_id", "ord").union(a.filter("known").select("target_id", "ord")).groupBy("node_id").agg(F.max("ord").alias("last"))
    last = lambda key, name: touched.select(F.col("node_id").alias(key), F.col("last").alias(name))
    made = a.filter("known").join(last("node_id", "l1"), "node_id").join(last("target_id", "l2"), "target_id").filter("l1 = ord and l2 = ord")
    made = made.select(F.concat(F.lit("link-"), F.col("ord")).alias("edge_id"), F.col("node_id").alias("from_id"), F.col("target_id").alias("to_id"), "type", geom.distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")).alias("distance"))
    old = links.select(*made.columns)
    for end in ("from_id", "to_id"):
        old = old.join(touched.select(F.col("node_id").alias(end)), end, "left_anti")
    return old.select(*made.columns).unionByName(made)


def replaced_buildings(floors: DataFrame, placements: DataFrame) -> DataFrame:
    """``floors`` with the new origin and bearing of the buildings in ``placements`` (building_id, ox, oy, bearing; nulls: back to 0)."""
    new = placements.select("building_id", *[F.coalesce(n, F.lit(0.0)).alias(f"_{n}") for n in ("ox", "oy", "bearing")], F.lit(True).alias("_moved"))
    both = floors.join(new, "building_id", "left")
    return both.select(*[F.when(F.col("_moved"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) if n in ("ox", "oy", "bearing") else F.col(n) for n in floors.columns])


def outdoor_links(site_edges: DataFrame, site_nodes: DataFrame) -> DataFrame:
    """edge_id, site_node_id, node_id of outdoor edges between an outdoor and a building node, whichever end is which."""
    out = site_nodes.select("node_id")
    at = lambda a, b: site_edges.select("edge_id", F.col(a).alias("site_node_id"), F.col(b).alias("node_id"))
    every = at("from_id", "to_id").union(at("to_id", "from_id"))
    return every.join(out.withColumnRenamed("node_id", "site_node_id"), "site_node_id", "left_semi").join(out, "node_id", "left_anti").select("edge_id", "site_node_id", "node_id")


def link_targets(nodes: DataFrame, floors: DataFrame) -> DataFrame:
    """node_id, building_id, label, type of all building nodes.  ``nodes`` may have a name; ``floors``: plane_id, building_name, floor_name."""
    own = F.nullif(F.trim("name"), F.lit("")) if "name" in nodes.columns else F.lit(None).cast("string")
    label = F.concat_ws(" · ", "building_name", "floor_name", F.coalesce(own, F.substring(F.col("node_id").cast("string"), 1, 6)))
    return nodes.join(floors.select("plane_id", "building_name", "floor_name"), "plane_id").select("node_id", "building_id", label.alias("label"), "type")


def new_outdoor_links(asked: DataFrame, site_edges: DataFrame, site_nodes: DataFrame, nodes: DataFrame, floors: DataFrame) -> DataFrame:
    """New outdoor edges for the pairs ``asked`` (site_node_id, node_id) that have none yet, measured in the site frame; unknown nodes drop out."""
    there = outdoor_links(site_edges, site_nodes).select("site_node_id", "node_id")
    new = asked.select("site_node_id", "node_id").distinct().join(there, ["site_node_id", "node_id"], "left_anti")
    new = new.join(site_nodes.select(F.col("node_id").alias("site_node_id")), "site_node_id", "left_semi").join(nodes.select("node_id"), "node_id", "left_semi")
    edge = new.select(F.concat_ws("-", F.lit("out"), "site_node_id", "node_id").alias("edge_id"), F.col("site_node_id").alias("from_id"), F.col("node_id").alias("to_id"), F.lit("walk").alias("type"), F.lit(None).cast("double").alias("distance"), F.lit(True).alias("accessible"))
    return graph.site_edges(edge, site_nodes, nodes, floors)


def drawn_walks(waypoints: DataFrame, nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges of walks drawn point by point: ``waypoints`` has path_id, ord, plane_id, x, y.

    A waypoint within ``reach`` of a node takes it (the smallest id), any other is a node of its own, one for each place.
    Neighbours in a path are joined by an edge of measured length.  Naming the same node again lifts the pen and a third time sets it
    down, so a run of an even number of equal nodes is not joined to what follows.  Nodes: node_id, plane_id, x, y;
    edges: path_id, ord, from_id, to_id, distance.
    """
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = nodes.select("plane_id", "node_id", F.col("x").alias("nx"), F.col("y").alias("ny")).withColumn("i", step).withColumn("j", step)
    near = near.select("plane_id", "node_id", "nx", "ny", (F.floor(F.col("nx") / reach) + F.col("i")).alias("cx"), (F.floor(F.col("ny") / reach) + F.col("j")).alias("cy"))
    places = waypoints.select("plane_id", "x", "y").distinct()
    hit = spatial.at_cell(places, reach).join(near, ["plane_id", "cx", "cy"]).filter(geom.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")) <= reach)
    hit = hit.groupBy("plane_id", "x", "y").agg(F.min(F.struct("node_id", "nx", "ny")).alias("n"))
    at = places.join(hit, ["plane_id", "x", "y"], "left")
    own = F.concat_ws("/", F.lit("new"), "plane_id", "x", "y")
    at = at.select("plane_id", "x", "y", F.coalesce(F.col("n.node_id").cast("string"), own).alias("node_id"), F.coalesce("n.nx", "x").alias("px"), F.coalesce("n.ny", "y").alias("py"), F.col("n").isNull().alias("new"))
    w = Window.partitionBy("path_id").orderBy("ord")
    row = waypoints.join(at, ["plane_id", "x", "y"]).withColumn("first", F.coalesce(F.lag("node_id").over(w) != F.col("node_id"), F.lit(True)))
    row = row.withColumn("run", F.sum(F.col("first").cast("int")).over(w))
    runs = row.groupBy("path_id", "run").agg(F.max("ord").alias("ord"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("plane_id", "node_id", "px", "py")])
    v = Window.partitionBy("path_id").orderBy("run")
    before = {c: F.lag(c).over(v).alias(f"b_{c}") for c in ("plane_id", "node_id", "px", "py", "n")}
    joined = runs.select("*", *before.values()).filter((F.col("b_n") % 2 == 1) & (F.col("b_plane_id") == F.col("plane_id")))
    length = geom.distance(F.col("b_px"), F.col("b_py"), F.col("px"), F.col("py"))
    edges = joined.select("path_id", "ord", F.col("b_node_id").alias("from_id"), F.col("node_id").alias("to_id"), length.alias("distance"))
    return at.filter("new").select("node_id", "plane_id", "x", "y"), edges


def door_sides(doors: DataFrame, spaces: DataFrame, reach: float = 0.3) -> DataFrame:
    """entrance_id, space_a, space_b: the nearest and the second nearest space whose outline is within ``reach`` of the door (ties by order)."""
    rooms = spaces.select("plane_id", "space_id", F.col("ord").alias("space_ord"), "polygon", geom.box(F.col("polygon")).alias("box"))
    rooms = spatial.with_cells(rooms, F.col("box"), reach)
    near = spatial.at_cell(doors.select("entrance_id", "plane_id", "x", "y")).join(rooms, ["plane_id", "cx", "cy"])
    slack = reach + spatial.EPSILON
    near = near.filter(F.col("x").between(F.col("box.x0") - slack, F.col("box.x1") + slack) & F.col("y").between(F.col("box.y0") - slack, F.col("box.y1") + slack))
    # the distance is computed once for each pair whose box is in reach, not again by a filter
    near = near.withColumn("d", F.explode(F.filter(F.array(geom.distance_to_ring(F.col("x"), F.col("y"), F.col("polygon"))), lambda d: d <= reach)))
    order = Window.partitionBy("entrance_id").orderBy("d", "space_ord", "space_id")
    two = near.select("entrance_id", "space_id", "space_ord", "d").withColumn("k", F.row_number().over(order)).filter("k <= 2")
    side = lambda k: F.max(F.when(F.col("k") == k, F.col("space_id")))
    return doors.select("entrance_id").join(two.groupBy("entrance_id").agg(side(1).alias("space_a"), side(2).alias("space_b")), "entrance_id", "left")


def accepted(entries: DataFrame, ids: DataFrame, yes: bool = True) -> DataFrame:
    """Draft ``entries`` (entry_id, accepted) with the flag of those in ``ids`` (entry_id) set."""
    named = ids.select("entry_id", F.lit(True).alias("_named")).distinct()
    return entries.join(named, "entry_id", "left").withColumn("accepted", F.when(F.col("_named"), F.lit(yes)).otherwise(F.col("accepted"))).select(*entries.columns)


#: What a sparse row of each kind takes where it says nothing.
DEFAULTS = {
    "space": {"height": 3.0, "type": "unknown"},
    "wall": {"thickness": 0.2},
    "entrance": {"type": "door"},
    "poi": {"name": "New POI", "type": "custom"},
    "furniture": {"type": "desk"},
    "node": {"type": "normal"},
    "edge": {"type": "walk", "accessible": True},
    "floor": {"elevation": 0.0},
}


def with_defaults(df: DataFrame, kind: str) -> DataFrame:
    """Sparse rows of one kind with their defaults; a connector is accessible by its type (elevators and ramps are) unless it says so itself."""
    if kind == "connector":
        by_type = F.col("type").isin("elevator", "ramp")
        return df.withColumn("accessible", F.coalesce("accessible", by_type) if "accessible" in df.columns else by_type)
    for name, value in DEFAULTS[kind].items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df
