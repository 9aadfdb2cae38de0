"""Queries of the routing graph and of routes over the campus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import graph, routing
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(c, 6)

CONNECTORS = """, st as (select s.*, n.x, n.y, row_number() over (partition by connector_id order by s.elevation, s.level) k from c_stop s join c_nav_node n using (node_id)),
 ce as (select a.connector_id, a.node_id from_id, b.node_id to_id, a.kind, case when abs(b.elevation-a.elevation) > 0 then abs(b.elevation-a.elevation) else abs(b.level-a.level)*4.0 end up,
   sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) flat from st a join st b on a.connector_id = b.connector_id and (a.kind = 1 and b.k > a.k or a.kind = 2 and b.k = a.k + 1)),
 cr as (select connector_id || ':' || from_id || '->' || to_id edge_id, from_id, to_id, case when kind = 1 then 'elevator' else 'stairs' end type,
   case when kind = 1 then up else sqrt(up*up+flat*flat) end distance, kind = 1 accessible, case when kind = 1 then 40 + up/1.5 else up/0.4 + flat/1.2 end duration from ce)
"""
SITE = """, sp as (select node_id, x, y, true outdoor from c_site_node union all select n.node_id, b.ox + n.x*cos(radians(b.bearing)) + n.y*sin(radians(b.bearing)), b.oy - n.x*sin(radians(b.bearing)) + n.y*cos(radians(b.bearing)), false
   from c_nav_node n join c_floor f using (floor_id) join c_building b on b.building_id = f.building_id),
 se as (select e.edge_id, e.from_id, e.to_id, e.type, case when a.outdoor and b.outdoor then e.distance else sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) end distance, e.accessible from c_site_edge e join sp a on a.node_id = e.from_id join sp b on b.node_id = e.to_id)
"""
GRAPH = CONNECTORS + SITE + """, ge as (select edge_id, from_id, to_id, type, distance, accessible, cast(null as double) duration from c_nav_edge
   union all select edge_id, from_id, to_id, type, distance, accessible, null from se union all select * from cr)
"""


def _stops(c: Campus) -> DataFrame:
    n = c.nodes().select("node_id", "x", "y", "project_id")
    s = c.stops().withColumn("ord", F.col("level")).join(n, "node_id")
    return s.withColumn("accessible", F.col("type") == "elevator").withColumn("direction", F.lit(None).cast("string"))


def edges(c: Campus) -> DataFrame:
    outdoor = graph.site_edges(c.site_edges(), c.site_nodes(), c.nodes(), c.floors())
    walks = graph.climbing_edges(c.edges(), c.nodes(), graph.climb_footprints(c.entrances(), c.spaces()))
    return graph.routing_graph(walks, outdoor, graph.connector_edges(_stops(c)))


def _nodes(c: Campus) -> DataFrame:
    return c.nodes().select("node_id").union(c.site_nodes().select("node_id"))


@query(CONNECTORS + "select edge_id, from_id, to_id, type, round(distance, 6) distance, accessible, round(duration, 6) duration from cr")
def n6_connector_edges(c: Campus) -> DataFrame:
    e = graph.connector_edges(_stops(c))
    return e.select("edge_id", "from_id", "to_id", "type", r(F.col("distance")).alias("distance"), "accessible", r(F.col("duration")).alias("duration"))


@query(SITE + "select edge_id, round(distance, 6) distance from se")
def n8_site_edges(c: Campus) -> DataFrame:
    return graph.site_edges(c.site_edges(), c.site_nodes(), c.nodes(), c.floors()).select("edge_id", r(F.col("distance")).alias("distance"))


@query(GRAPH + "select type, accessible, count(*) edges, round(sum(distance), 3) metres, round(sum(coalesce(duration, distance/1.2)), 3) as seconds from ge group by 1, 2")
def n9_routing_graph(c: Campus) -> DataFrame:
    seconds = F.coalesce("duration", F.col("distance") / graph.WALKING_SPEED)
    return edges(c).groupBy("type", "accessible").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("distance"), 3).alias("metres"), F.round(F.sum(seconds), 3).alias("seconds"))


@query(GRAPH + """select src, count(*) edges, round(min(w), 6) shortest from (select from_id src, coalesce(duration, distance/1.2) w from ge union all select to_id, coalesce(duration, distance/1.2) from ge) group by 1""")
def n10_adjacency(c: Campus) -> DataFrame:
    return graph.adjacency(edges(c), _nodes(c)).groupBy("src").agg(F.count(F.lit(1)).alias("edges"), r(F.min("weight")).alias("shortest"))


@query(GRAPH + """select type, count(*) edges from ge where accessible and type <> 'stairs' group by 1""")
def n12_step_free_edges(c: Campus) -> DataFrame:
    adjacent = graph.passable(graph.adjacency(edges(c), _nodes(c)), require_accessible=True, avoid_stairs=True)
    return adjacent.groupBy("type").agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"))


def places(c: Campus) -> DataFrame:
    """node, plane_id, x, y of all nodes; those of a site are on a plane of their own."""
    outdoor = c.site_nodes().select("node_id", (-F.col("project_id") - 1).alias("plane_id"), "x", "y")
    return c.nodes().select("node_id", "plane_id", "x", "y").unionByName(outdoor).withColumnRenamed("node_id", "node")


def _gates(c: Campus) -> DataFrame:
    return c.site_nodes().select(F.col("node_id").alias("search_id"), F.col("node_id").alias("node"), F.lit(0.0).alias("extra"))


def _entered(c: Campus, **options) -> routing.Entered:
    adjacent = routing.written(graph.adjacency(edges(c), _nodes(c)))
    return routing.Entered(_gates(c), graph.passable(adjacent, **options), routing.blocks(places(c)))


def _settled(c: Campus, **options) -> DataFrame:
    return _entered(c, **options).labels()


@query()
def n14_fastest_routes(c: Campus) -> DataFrame:
    """From each outdoor gate to every node that it reaches: the cost of the fastest route."""
    return _settled(c).select("search_id", "node", r(F.col("weight")).alias("weight"), r(F.col("metres")).alias("metres"))


@query()
def n16_nearest_gate(c: Campus) -> DataFrame:
    """The gate from which each indoor node is reached soonest without a step."""
    done = _settled(c, require_accessible=True, avoid_stairs=True).filter("node >= 0")
    best = done.groupBy("node").agg(F.min(F.struct("weight", "search_id")).alias("b"))
    return best.select("node", F.col("b.search_id").alias("gate"), r(F.col("b.weight")).alias("seconds"))


def _trips(c: Campus) -> DataFrame:
    """query_id, plane_id, x, y of each trip's destination POI, and the gate of its building."""
    poi = c.pois().select(F.col("poi_id").alias("to_poi"), "plane_id", "x", "y")
    f = c.floors().select("plane_id", "building_id")
    return c.view("c_trip").select("query_id", "to_poi").join(poi, "to_poi").join(f, "plane_id")


@query()
def n15_gate_to_poi_paths(c: Campus) -> DataFrame:
    """The steps of the fastest route from each building's gate to the node nearest to each of its POIs."""
    from atrium.operators import spatial

    poi = spatial.nearest_node(c.pois(), c.nodes(), "poi_id").join(c.pois().select("poi_id", "plane_id"), "poi_id").join(c.floors().select("plane_id", "building_id"), "plane_id")
    goals = poi.select(F.col("poi_id").alias("query_id"), (-1 - F.col("building_id")).alias("search_id"), F.col("node_id").alias("node"), (F.col("distance") / graph.WALKING_SPEED).alias("extra"))
    goals, entered = routing.written(goals), _entered(c)
    found = routing.routes(entered.labels(goals), goals)
    return entered.paths(found).groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("ord").alias("hops"))


@query(""", e as (select entrance_id, floor_id, case entrance_id % 11 when 0 then 'stairs' else 'escalator' end kind, x, y, case when entrance_id % 2 = 0 then 2 else width/2 end hx, case when entrance_id % 2 = 0 then width/2 else 2 end hy from c_entrance where entrance_id % 11 in (0, 1)),
 w as (select d.edge_id, d.floor_id, d.from_id, d.to_id, a.x ax, a.y ay, b.x bx, b.y by_ from c_nav_edge d join c_nav_node a on a.node_id = d.from_id join c_nav_node b on b.node_id = d.to_id),
 n as (select *, unnest(generate_series(1, greatest(2, ceil(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_))/0.1::double))::bigint - 1)) i, greatest(2, ceil(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_))/0.1::double)) steps from w),
 h as (select n.edge_id, e.kind, row_number() over (partition by n.edge_id order by n.i, e.entrance_id) k from n join e on e.floor_id = n.floor_id and abs(ax+(bx-ax)*(i/steps) - e.x) < hx and abs(ay+(by_-ay)*(i/steps) - e.y) < hy)
select d.edge_id, case when d.from_id % 14 in (0, 1) and d.to_id % 14 in (0, 1) then 'stairs' else coalesce(h.kind, d.type) end type, d.accessible and not (d.from_id % 14 in (0, 1) and d.to_id % 14 in (0, 1)) and h.kind is null accessible
 from c_nav_edge d left join h on h.edge_id = d.edge_id and h.k = 1""")
def n3_climbing_edges(c: Campus) -> DataFrame:
    """Every eleventh door is a staircase or an escalator, upright or turned, and every seventh room has stair nodes."""
    n = F.col("entrance_id") % 11
    climbs = c.entrances().filter(n < 2).withColumn("type", F.when(n == 0, "stairs").otherwise("escalator")).withColumn("rotation", (F.col("entrance_id") % 2) * 90)
    nodes = c.nodes().withColumn("type", F.when(F.col("node_id") % 14 < 2, "stairs").otherwise(F.col("type")))
    feet = graph.climb_footprints(climbs, c.spaces())
    return graph.climbing_edges(c.edges(), nodes, feet).select("edge_id", "type", "accessible")


@query(""", e as (select entrance_id, floor_id, x, y, 2.0::double hx, width/2 hy from c_entrance where entrance_id % 5 = 0)
select floor_id plane_id, count(*) footprints, round(sum(4*hx*hy), 4) area, round(min(x - hx), 6) x0, round(max(y + hy), 6) y1 from e group by 1""")
def n2_climb_footprints(c: Campus) -> DataFrame:
    feet = graph.climb_footprints(c.entrances().filter("entrance_id % 5 = 0").withColumn("type", F.lit("stairs")), c.spaces())
    box = geom.box(F.col("polygon"))
    return feet.groupBy("plane_id").agg(F.count(F.lit(1)).alias("footprints"), F.round(F.sum(geom.signed_area(F.col("polygon"))), 4).alias("area"), r(F.min(box.x0)).alias("x0"), r(F.max(box.y1)).alias("y1"))
