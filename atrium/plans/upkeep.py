"""Queries of bulk changes: floors cleared, links over floors and outdoors, moved buildings, drawn walks, sides of doors, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import bulk, places
from atrium.operators import graph as net
from atrium.plans.graph import SITE
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(c, 6)


@query(""", gone as (select floor_id from c_floor where floor_id % 4 = 1), gn as (select node_id from c_nav_node semi join gone using (floor_id)),
 e as (select edge_id, floor_id plane_id, from_id, to_id from c_nav_edge anti join gone using (floor_id) union all select edge_id, null, from_id, to_id from c_site_edge)
select 'edge' kind, edge_id id from e where from_id not in (select node_id from gn) and to_id not in (select node_id from gn)
 union all select 'node', node_id::varchar from c_nav_node anti join gone using (floor_id) union all select 'space', space_id::varchar from c_space anti join gone using (floor_id)
 union all select 'stop', connector_id || '/' || floor_id from c_stop anti join gone using (floor_id)""")
def b4_cleared_floors(c: Campus) -> DataFrame:
    tables = {"spaces": c.spaces(), "nodes": c.nodes(), "edges": c.edges(), "outdoor": c.site_edges(), "stops": c.stops()}
    left = bulk.cleared_floors(tables, c.floors().filter("plane_id % 4 = 1"))
    of = lambda name, kind, key: left[name].select(F.lit(kind).alias("kind"), key.cast("string").alias("id"))
    return of("edges", "edge", F.col("edge_id")).union(of("outdoor", "edge", F.col("edge_id"))).union(of("nodes", "node", F.col("node_id"))).union(of("spaces", "space", F.col("space_id"))).union(of("stops", "stop", F.concat_ws("/", "connector_id", "plane_id")))


#: Links between rooms of equal place on neighbouring floors, and requests that compete for them.
LINKS = """, fs as (select s.space_id, s.ord, s.x0, s.y0, f.building_id, f.level from c_space s join c_floor f using (floor_id)),
 lk as (select 'x' || a.space_id edge_id, a.space_id * 2 from_id, b.space_id * 2 to_id, 'stairs' type, sqrt((a.x0-b.x0)*(a.x0-b.x0)+(a.y0-b.y0)*(a.y0-b.y0)) distance from fs a join fs b on a.building_id = b.building_id and a.ord = b.ord and a.level = 2 and b.level = 3),
 ask as (select a.space_id ord, a.space_id * 2 node_id, case when a.ord % 7 = 0 then null else b.space_id * 2 end target_id, 'elevator' type from fs a join fs b on a.building_id = b.building_id and b.ord = a.ord // 2 and a.level = 1 and b.level = 2 where a.ord % 5 < 3)
"""


def _links(c: Campus) -> tuple[DataFrame, DataFrame]:
    s = c.spaces().join(c.floors().select("plane_id", "building_id", "level"), "plane_id").select("building_id", "level", "ord", "space_id", F.col("polygon")[0].x.alias("x"), F.col("polygon")[0].y.alias("y"))
    a, b = s.alias("a"), s.alias("b")
    same = F.col("a.building_id") == F.col("b.building_id")
    far = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    old = a.join(b, same & (F.col("a.ord") == F.col("b.ord")) & (F.col("a.level") == 2) & (F.col("b.level") == 3))
    old = old.select(F.concat(F.lit("x"), "a.space_id").alias("edge_id"), (F.col("a.space_id") * 2).alias("from_id"), (F.col("b.space_id") * 2).alias("to_id"), F.lit("stairs").alias("type"), far.alias("distance"))
    asked = a.join(b, same & (F.col("b.ord") == F.floor(F.col("a.ord") / 2)) & (F.col("a.level") == 1) & (F.col("b.level") == 2)).filter("a.ord % 5 < 3")
    asked = asked.select(F.col("a.space_id").alias("ord"), (F.col("a.space_id") * 2).alias("node_id"), F.when(F.col("a.ord") % 7 != 0, F.col("b.space_id") * 2).alias("target_id"), F.lit("elevator").alias("type"))
    return old, asked


@query(LINKS + """, t as (select node_id, max(ord) last from (select node_id, ord from ask union all select target_id, ord from ask where target_id is not null) group by 1)
select edge_id, from_id, to_id, type, round(distance, 6) distance from lk where from_id not in (select node_id from t) and to_id not in (select node_id from t)
 union all select 'link-' || ord, ask.node_id, target_id, ask.type, round(sqrt((n.x-m.x)*(n.x-m.x)+(n.y-m.y)*(n.y-m.y)), 6) from ask join c_nav_node n on n.node_id = ask.node_id join c_nav_node m on m.node_id = target_id
  where ord = (select last from t where t.node_id = ask.node_id) and ord = (select last from t where t.node_id = ask.target_id)""")
def b5_linked_nodes(c: Campus) -> DataFrame:
    old, asked = _links(c)
    return bulk.linked_nodes(old, c.nodes(), asked).withColumn("distance", r(F.col("distance")))


@query(LINKS + """, e as (select edge_id, from_id, to_id from lk union all select edge_id, from_id, to_id from c_nav_edge)
select edge_id, a.floor_id from_plane, b.floor_id to_plane from e join c_nav_node a on a.node_id = from_id join c_nav_node b on b.node_id = to_id where a.floor_id <> b.floor_id""")
def j11_cross_floor_edges(c: Campus) -> DataFrame:
    every = _links(c)[0].select("edge_id", "from_id", "to_id").union(c.edges().select("edge_id", "from_id", "to_id"))
    return bulk.cross_floor_edges(every, c.nodes()).select("edge_id", "from_plane", "to_plane")


MOVED = SITE.replace("join c_building b on", "join mv b on").replace(", sp as", ", mv as (select building_id, case when building_id % 2 = 0 then ox + 20 else ox end ox, case when building_id % 2 = 0 then oy - 10 else oy end oy, case when building_id % 2 = 0 then bearing + 15 else bearing end bearing from c_building), sp as", 1)


@query(MOVED + "select edge_id, round(distance, 6) distance from se")
def b7_moved_buildings(c: Campus) -> DataFrame:
    new = c.view("c_building").filter("building_id % 2 = 0").select("building_id", (F.col("ox") + 20).alias("ox"), (F.col("oy") - 10).alias("oy"), (F.col("bearing") + 15).alias("bearing"))
    floors = bulk.replaced_buildings(c.floors(), new)
    return net.site_edges(c.site_edges(), c.site_nodes(), c.nodes(), floors).select("edge_id", r(F.col("distance")).alias("distance"))


@query(SITE + """, ask as (select -1 - f.building_id site_node_id, s.space_id * 2 node_id from c_space s join c_floor f using (floor_id) where f.level = 1 and s.ord % 4 = 0)
select concat('out-', site_node_id, '-', ask.node_id) edge_id, site_node_id from_id, ask.node_id to_id, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) distance from ask join sp a on a.node_id = site_node_id join sp b on b.node_id = ask.node_id
 where not exists (select 1 from c_site_edge e where e.from_id = site_node_id and e.to_id = ask.node_id or e.to_id = site_node_id and e.from_id = ask.node_id)""")
def b8_new_outdoor_links(c: Campus) -> DataFrame:
    at = c.spaces().join(c.floors().filter("level = 1").select("plane_id", "building_id"), "plane_id").filter("ord % 4 = 0")
    asked = at.select((-1 - F.col("building_id")).alias("site_node_id"), (F.col("space_id") * 2).alias("node_id"))
    new = bulk.new_outdoor_links(asked, c.site_edges(), c.site_nodes(), c.nodes(), c.floors())
    return new.select("edge_id", "from_id", "to_id", r(F.col("distance")).alias("distance"))


@query("""select 'link' kind, edge_id || '' id, from_id site_node_id, to_id node_id, cast(null as varchar) label from c_site_edge where to_id >= 0
 union all select 'target', '', null, node_id, b.name || ' · ' || f.level || 'F · ' || substr(node_id::varchar, 1, 6) from c_nav_node join c_floor f using (floor_id) join c_building b on b.building_id = f.building_id""")
def p14_outdoor_links(c: Campus) -> DataFrame:
    links = bulk.outdoor_links(c.site_edges(), c.site_nodes()).select(F.lit("link").alias("kind"), F.col("edge_id").alias("id"), "site_node_id", "node_id", F.lit(None).cast("string").alias("label"))
    named = c.floors().join(c.view("c_building").select("building_id", F.col("name").alias("building_name")), "building_id").withColumn("floor_name", F.concat("level", F.lit("F")))
    targets = bulk.link_targets(c.nodes(), named).select(F.lit("target"), F.lit(""), F.lit(None).cast("long"), "node_id", "label")
    return links.union(targets)


@query(""", hit as (select event_id, min(node_id) node_id from c_ping p join c_nav_node n using (floor_id) where sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)) <= 1.5 group by 1),
 wp as (select p.user_id path_id, p.event_id ord, p.floor_id plane_id, coalesce(n.node_id::varchar, concat(p.floor_id, '/', p.x, '/', p.y)) id, coalesce(n.x, p.x) x, coalesce(n.y, p.y) y from c_ping p left join hit using (event_id) left join c_nav_node n using (node_id)),
 f as (select *, case when lag(id) over w = id then 0 else 1 end first from wp window w as (partition by path_id order by ord)),
 g as (select *, sum(first) over (partition by path_id order by ord) run from f),
 u as (select path_id, run, max(ord) ord, count(*) n, any_value(plane_id) plane_id, any_value(x) x, any_value(y) y from g group by 1, 2),
 e as (select *, lag(plane_id) over w bp, lag(x) over w bx, lag(y) over w by_, lag(n) over w bn from u window w as (partition by path_id order by run))
select path_id, count(*) edges, round(sum(sqrt((x-bx)*(x-bx)+(y-by_)*(y-by_))), 4) metres from e where bn % 2 = 1 and bp = plane_id group by 1""")
def b15_drawn_walks(c: Campus) -> DataFrame:
    way = c.pings().select(F.col("user_id").alias("path_id"), F.col("event_id").alias("ord"), "plane_id", "x", "y")
    _, edges = bulk.drawn_walks(way, c.nodes().select("plane_id", "node_id", "x", "y"), 1.5)
    return edges.groupBy("path_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("distance"), 4).alias("metres"))


@query(""", d as (select e.entrance_id, s.space_id, s.ord, case when e.x between x0 and x1 and e.y between y0 and y1 then least(e.x-x0, x1-e.x, e.y-y0, y1-e.y) else sqrt(power(greatest(x0-e.x, 0, e.x-x1), 2)+power(greatest(y0-e.y, 0, e.y-y1), 2)) end d from c_entrance e join c_space s using (floor_id)),
 k as (select *, row_number() over (partition by entrance_id order by round(d, 9), ord, space_id) k from d where d <= 1.2)
select e.entrance_id, max(case when k = 1 then space_id end) space_a, max(case when k = 2 then space_id end) space_b from c_entrance e left join k using (entrance_id) group by 1""")
def j17_door_sides(c: Campus) -> DataFrame:
    return bulk.door_sides(c.entrances(), c.spaces(), 1.2)


@query("""select wall_id id, 'wall' kind, case when wall_id % 3 = 0 then 0.2 else thickness end value from c_wall union all select connector_id * 10 + level, 'connector', case when kind = 1 then 1.0 else 0.0 end from c_stop
 union all select space_id, 'space', 3.0 from c_space""")
def s17_defaults(c: Campus) -> DataFrame:
    walls = bulk.with_defaults(c.walls().withColumn("thickness", F.when(F.col("wall_id") % 3 != 0, F.col("thickness"))), "wall")
    stops = bulk.with_defaults(c.stops(), "connector")
    spaces = bulk.with_defaults(c.spaces(), "space")
    out = walls.select(F.col("wall_id").alias("id"), F.lit("wall").alias("kind"), F.col("thickness").alias("value"))
    out = out.union(stops.select(F.col("connector_id") * 10 + F.col("level"), F.lit("connector"), F.col("accessible").cast("double")))
    return out.union(spaces.select("space_id", F.lit("space"), "height"))


@query(""", i as (select 's' || space_id id, 'space' kind, floor_id from c_space union all select 'p' || poi_id, 'poi', floor_id from c_poi union all select 'n' || node_id, 'node', floor_id from c_nav_node),
 a as (select 's' || o_custkey id from orders union select 'p' || o_custkey from orders union select 'n' || (o_custkey * 3) from orders)
select id, kind, floor_id plane_id from a left join i using (id)""")
def p11_object_kinds(c: Campus) -> DataFrame:
    """Ids named by trips, of which some exist."""
    tag = lambda df, key, letter: df.withColumn("_id", F.concat(F.lit(letter), key))
    tables = {"space": (tag(c.spaces(), "space_id", "s"), "_id"), "poi": (tag(c.pois(), "poi_id", "p"), "_id"), "node": (tag(c.nodes(), "node_id", "n"), "_id")}
    k = F.col("from_poi")
    asked = c.view("c_trip").select(F.explode(F.array(F.concat(F.lit("s"), k), F.concat(F.lit("p"), k), F.concat(F.lit("n"), k * 3))).alias("id"))
    return places.object_kinds(tables, asked)
