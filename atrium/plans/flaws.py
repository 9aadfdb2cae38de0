"""Validation rules over a campus with flaws: some objects of every kind are spoilt by their ids, and each rule must find exactly those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import validate as v
from atrium.plans.registry import query
from atrium.plans.validation import _links, _out, row
from atrium.sources.campus import Campus


def rule(name: str, sql: str) -> Callable:
    """Registers a rule under a name of its own; it gives the columns of issues."""

    def register(f: Callable[[Campus], DataFrame]) -> None:
        def run(c: Campus) -> DataFrame:
            return _out(f(c))

        run.__name__ = name
        query(sql)(run)

    return register


def _every(n: int, key: str = "space_id", rest: int = 0):
    return F.col(key) % n == rest


def _outlines(c: Campus) -> DataFrame:
    """Spaces: every 71st is a bow tie, every 73rd has two corners, and some of the 13th's holes are spoilt."""
    p = F.col("polygon")
    tied = F.array(F.get(p, 0), F.get(p, 2), F.get(p, 1), F.get(p, 3))
    hole = F.get("holes", 0)
    away = F.transform(hole, lambda q: F.struct((q.x + 100).alias("x"), q.y.alias("y")))
    bent = F.array(F.get(hole, 0), F.get(hole, 2), F.get(hole, 1), F.get(hole, 3))
    holes = F.when(_every(26), F.array(away)).when(_every(39), F.array(F.slice(hole, 1, 2))).when(_every(65), F.array(bent)).when(_every(91), F.array(hole, hole)).otherwise(F.col("holes"))
    s = c.spaces().withColumn("holes", F.when(_every(13), holes).otherwise(F.col("holes")))
    return s.withColumn("polygon", F.when(_every(71), tied).when(_every(73), F.slice(p, 1, 2)).otherwise(p))


@rule("v1_too_few_corners", f"select {row('error', 'invalid-polygon', 'space_id')} from c_space where space_id % 73 = 0 and space_id % 71 <> 0")
def _(c: Campus) -> DataFrame:
    return v.too_few_vertices(_outlines(c))


@rule("v2_bow_ties", f"select {row('error', 'self-intersecting-polygon', 'space_id')} from c_space where space_id % 71 = 0")
def _(c: Campus) -> DataFrame:
    return v.self_intersecting(_outlines(c))


@rule("v3_spoilt_holes", f"""select {row('error', 'invalid-hole', 'space_id', "'hole ' || case when space_id % 26 <> 0 and space_id % 39 <> 0 and space_id % 65 <> 0 then '1' else '0' end || case when space_id % 26 = 0 then ' outside' when space_id % 39 = 0 then ' too-few-vertices' when space_id % 65 = 0 then ' self-intersecting' else ' overlapping' end")}
 from c_space where (space_id % 26 = 0 or space_id % 39 = 0 or space_id % 65 = 0 or space_id % 91 = 0) and space_id % 71 <> 0 and space_id % 73 <> 0""")
def _(c: Campus) -> DataFrame:
    return v.bad_holes(_outlines(c).filter(~_every(71)))


def _openings(c: Campus) -> DataFrame:
    """Doors: sizes, steps, angles and sills out of range, and walls that are not there."""
    e = c.entrances().withColumn("width", F.when(_every(43, "entrance_id"), -F.col("width")).otherwise(F.col("width")))
    e = e.withColumn("step_count", F.when(_every(47, "entrance_id"), F.lit(1.5)).when(_every(47, "entrance_id", 1), F.lit(201.0)).when(_every(47, "entrance_id", 2), F.lit(200.0)))
    e = e.withColumn("rotation", F.when(_every(53, "entrance_id"), F.lit(float("nan"))).otherwise(F.lit(-30.0))).withColumn("sill_height", F.when(_every(61, "entrance_id"), F.lit(-0.1)).otherwise(F.lit(0.0)))
    return e.withColumn("wall_id", F.when(_every(67, "entrance_id"), F.lit(-5)).when(_every(67, "entrance_id", 1), F.lit(None)).otherwise(F.col("wall_id")))


_BAD_SIZES = " union all ".join(f"select {row('error', 'invalid-element-dimension', 'entrance_id', repr(name))} from c_entrance where {test}" for name, test in (("width", "entrance_id % 43 = 0"), ("step_count", "entrance_id % 47 in (0, 1)"), ("rotation", "entrance_id % 53 = 0"), ("sill_height", "entrance_id % 61 = 0")))


@rule("v7_sizes_out_of_range", _BAD_SIZES)
def _(c: Campus) -> DataFrame:
    return v.dimensions(_openings(c))


@rule("v8_walls_not_there", f"select {row('warning', 'missing-host-wall', 'entrance_id')} from c_entrance where entrance_id % 67 = 0")
def _(c: Campus) -> DataFrame:
    return v.missing_hosts(_openings(c), c.walls())


@rule("v11_places_of_no_room", f"select {row('error', 'invalid-poi', 'poi_id')} from c_place where poi_id % 10 = 0")
def _(c: Campus) -> DataFrame:
    """Every tenth place states a room of another floor, or none that there is."""
    places = c.view("c_place").withColumnRenamed("floor_id", "plane_id")
    stated = F.when(_every(20, "poi_id"), -F.col("poi_id") - 1).when(_every(10, "poi_id"), F.lit(10**9)).otherwise(F.col("space_id"))
    return v.dangling(places.withColumn("space_id", stated), "invalid-poi", "poi_id", c.spaces())


@rule("v12_furniture_of_no_room", f"select {row('error', 'invalid-furniture', 'furniture_id')} from c_furniture where home is not null and not exists (select 1 from c_space s where s.space_id = home and s.floor_id = c_furniture.floor_id)")
def _(c: Campus) -> DataFrame:
    return v.dangling(c.view("c_furniture").withColumnsRenamed({"floor_id": "plane_id", "home": "space_id"}), "invalid-furniture", "furniture_id", c.spaces())


@rule("v13_members_not_there", f"""select {row('warning', 'dangling-group-member', 'group_id', 'member_id')} from c_member m where not exists (select 1 from (select floor_id, 'space-' || space_id id from c_space union all select floor_id, 'wall-' || wall_id from c_wall union all select floor_id, 'entrance-' || entrance_id from c_entrance
  union all select floor_id, 'poi-' || poi_id from c_poi union all select floor_id, 'node-' || node_id from c_nav_node union all select floor_id, 'edge-' || edge_id from c_nav_edge union all select floor_id, 'furniture-' || furniture_id from c_furniture) o where o.floor_id = m.floor_id and o.id = m.member_id)""")
def _(c: Campus) -> DataFrame:
    kinds = {"space": "c_space", "wall": "c_wall", "entrance": "c_entrance", "poi": "c_poi", "node": "c_nav_node", "edge": "c_nav_edge", "furniture": "c_furniture"}
    objects = None
    for kind, view in kinds.items():
        rows = c.view(view).select(F.col("floor_id").alias("plane_id"), F.concat(F.lit(f"{kind}-"), F.col(f"{kind}_id").cast("string")).alias("object_id"))
        objects = rows if objects is None else objects.union(rows)
    return v.dangling_members(c.view("c_member").withColumnRenamed("floor_id", "plane_id"), objects)


def _walks(c: Campus) -> DataFrame:
    """Edges: some end nowhere, and some are there twice, once the other way round."""
    e = c.edges().withColumn("n", F.substring("edge_id", 2, 20).cast("long"))
    e = e.withColumn("to_id", F.when(_every(33, "n"), F.lit(-999)).otherwise(F.col("to_id"))).withColumn("from_id", F.when(_every(66, "n"), F.lit(-998)).otherwise(F.col("from_id")))
    again = e.filter(_every(37, "n") & ~_every(33, "n")).withColumn("edge_id", F.concat(F.lit("again-"), "edge_id"))
    back = again.withColumn("turn", F.struct("from_id", "to_id")).withColumn("from_id", F.col("turn.to_id")).withColumn("to_id", F.col("turn.from_id")).drop("turn")
    return e.unionByName(back)


_TOLD = "cast(substr(edge_id, 2) as bigint)"


@rule("v14_edges_to_nowhere", f"select {row('error', 'broken-navigation-edge', 'edge_id', f'case when {_TOLD} % 66 = 0 then cast(-998 as varchar) else cast(-999 as varchar) end')} from c_nav_edge where {_TOLD} % 33 = 0")
def _(c: Campus) -> DataFrame:
    return v.broken_edges(_walks(c), c.nodes().select("node_id").union(c.site_nodes().select("node_id")))


@rule("v16_edges_twice", f"select {row('warning', 'duplicate-navigation-edge', 'unnest([edge_id, ' + repr('again-') + ' || edge_id])')} from c_nav_edge where {_TOLD} % 37 = 0 and {_TOLD} % 33 <> 0")
def _(c: Campus) -> DataFrame:
    return v.duplicate_edges(_walks(c).filter(~_every(33, "n")))  # those of nowhere would be one pair


@rule("v17_nodes_on_no_edge", f"select {row('warning', 'disconnected-navigation-node', 'floor_id + 10000000')} from c_floor where floor_id in (select floor_id from c_nav_node)")
def _(c: Campus) -> DataFrame:
    """Every floor has one more node, which nothing joins."""
    lonely = c.view("c_floor").select((F.col("floor_id") + 10_000_000).alias("node_id"), F.col("floor_id").alias("plane_id"))
    return v.lonely_nodes(c.nodes().select("node_id", "plane_id").union(lonely), _links(c))


@rule("v18_floors_apart", f"select {row('warning', 'missing-floor-connection', 'floor_id')} from c_floor where level = 3 and building_id % 4 = 1 and building_id % 8 <> 1 or building_id % 9 = 2")
def _(c: Campus) -> DataFrame:
    """Some buildings have no connector at their third floor, one in two of them a stairs edge instead, and some have none at all."""
    b = F.floor(F.col("plane_id") / 10)
    stops = c.stops().filter(~((b % 4 == 1) & (F.col("level") == 3)) & (b % 9 != 2))
    at = c.view("c_stop").filter("kind = 1 and building_id % 8 = 1 and building_id % 9 <> 2")
    low, high = at.filter("level = 2").select("building_id", F.col("node_id").alias("from_id")), at.filter("level = 3").select("building_id", F.col("node_id").alias("to_id"))
    climbs = low.join(high, "building_id").select("from_id", "to_id", F.lit("stairs").alias("type"))
    return v.unconnected_floors(c.floors(), stops, climbs, c.nodes())


def _stops(c: Campus) -> DataFrame:
    """Connectors by building: one stop only, a second stop on a floor, a floor or a node that is not there, or a room that is not there."""
    b = F.col("building_id") % 5
    s = c.stops().withColumn("ord", F.col("level")).withColumn("space_id", F.lit(None).cast("long")).filter(~((b == 0) & (F.col("level") > 1)))
    twice = s.filter((b == 1) & (F.col("level") == 2)).withColumn("ord", F.lit(9))
    lost = (b == 2) & (F.col("level") == 3)
    s = s.withColumn("plane_id", F.when(lost, F.lit(99_999)).otherwise(F.col("plane_id"))).withColumn("node_id", F.when((b == 3) & (F.col("level") == 2), F.lit(-7)).otherwise(F.col("node_id")))
    return s.withColumn("space_id", F.when((b == 4) & (F.col("level") == 1), F.lit(424_242_424)).when(lost, F.lit(424_242_424))).unionByName(twice)


@rule("v19_v20_v21_stops", f"""select {row('warning', 'connector-too-few-stops', 'connector_id')} from c_stop where building_id % 5 = 0 and level = 1 union all select {row('warning', 'connector-duplicate-floor', 'connector_id', 'cast(floor_id as varchar)')} from c_stop where building_id % 5 = 1 and level = 2
 union all select {row('error', 'connector-missing-floor', 'connector_id')} from c_stop where building_id % 5 = 2 and level = 3 union all select {row('error', 'connector-missing-node', 'connector_id')} from c_stop where building_id % 5 = 3 and level = 2""")
def _(c: Campus) -> DataFrame:
    return v.connector_stops(c.stops().select("connector_id").distinct(), _stops(c), c.floors(), c.nodes())


@rule("v22_stops_in_no_room", f"select {row('warning', 'connector-missing-space', 'connector_id')} from c_stop where building_id % 5 = 4 and level = 1")
def _(c: Campus) -> DataFrame:
    return v.stops_without_space(_stops(c), c.floors(), c.spaces())


@rule("v23_outdoor_nodes_of_other_planes", f"select {row('error', 'site-node-wrong-plane', 'node_id')} from c_site_node where building_id % 3 = 0")
def _(c: Campus) -> DataFrame:
    site = F.concat(F.lit("site-"), F.col("project_id").cast("string"))
    plane = F.when(_every(6, "building_id"), F.lit(None)).when(_every(3, "building_id"), F.lit("elsewhere")).otherwise(site)
    return v.wrong_plane(c.site_nodes().withColumn("site_id", site).withColumn("plane_id", plane))


@rule("v24_outdoor_edges_to_nowhere", f"select {row('error', 'broken-navigation-edge', 'edge_id', 'cast(-from_id as varchar)')} from c_site_edge where {_TOLD} % 4 = 0")
def _(c: Campus) -> DataFrame:
    e = c.site_edges().withColumn("n", F.substring("edge_id", 2, 20).cast("long"))
    gone = F.when(_every(4, "n"), -F.col("from_id")).otherwise(F.col("from_id"))
    return v.broken_edges(e.withColumn("from_id", gone), c.nodes().select("node_id").filter("node_id > 1000").union(c.site_nodes().select("node_id")).union(c.site_edges().select("to_id")))


@rule("v26_links_beside_connectors", f"select {row('warning', 'duplicate-floor-link', repr('x') + ' || a.connector_id', 'cast(a.connector_id as varchar)')} from c_stop a join c_stop b on a.connector_id = b.connector_id and a.level = 1 and b.level = 3 where a.building_id % 2 = 0")
def _(c: Campus) -> DataFrame:
    """Every second building has edges drawn beside its connectors, from the first floor to the third."""
    low, high = c.view("c_stop").filter("level = 1 and building_id % 2 = 0"), c.view("c_stop").filter("level = 3")
    drawn = low.select("connector_id", F.col("node_id").alias("from_id")).join(high.select("connector_id", F.col("node_id").alias("to_id")), "connector_id")
    return v.duplicate_floor_links(drawn.select(F.concat(F.lit("x"), F.col("connector_id").cast("string")).alias("edge_id"), "from_id", "to_id"), c.stops())


@query("""select p.event_id, min(f.furniture_id) furniture_id from c_ping p join c_furniture f using (floor_id) where abs((p.x-f.x)*cos(radians(f.turn)) + (p.y-f.y)*sin(radians(f.turn))) <= f.width/2 and abs(-(p.x-f.x)*sin(radians(f.turn)) + (p.y-f.y)*cos(radians(f.turn))) <= f.depth/2 group by 1""")
def g20_positions_on_furniture(c: Campus) -> DataFrame:
    """The first piece of furniture that each position of a user lies on."""
    from atrium.operators import spatial

    f = c.view("c_furniture").withColumnRenamed("floor_id", "plane_id")
    reach = F.sqrt(F.col("width") * F.col("width") + F.col("depth") * F.col("depth")) / 2
    box = F.struct((F.col("x") - reach).alias("x0"), (F.col("y") - reach).alias("y0"), (F.col("x") + reach).alias("x1"), (F.col("y") + reach).alias("y1"))
    there = spatial.with_cells(f.select("plane_id", "furniture_id", F.col("x").alias("fx"), F.col("y").alias("fy"), "turn", "width", "depth", "x", "y"), box).drop("x", "y")
    on = geom.on_turned_box(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"), F.col("width"), F.col("depth"), F.col("turn"))
    return spatial.at_cell(c.pings().select("event_id", "plane_id", "x", "y")).join(there, ["plane_id", "cx", "cy"]).filter(on).groupBy("event_id").agg(F.min("furniture_id").alias("furniture_id"))
