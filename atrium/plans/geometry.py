"""Queries of geometry and spatial joins over the campus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import spatial
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(c, 6)


@query("""
select space_id, round((x1-x0)*(y1-y0), 6) area, round((x1-x0)*(y1-y0) - case when space_id % 13 = 0 then 1.0 else 0.0 end, 6) net_area,
  round((x0+x1)/2, 6) cx, round((y0+y1)/2, 6) cy, x0, y0, x1, y1 from c_space""")
def g1_space_measures(c: Campus) -> DataFrame:
    p, box, mid = F.col("polygon"), geom.box(F.col("polygon")), geom.centroid(F.col("polygon"))
    return c.spaces().select("space_id", r(geom.signed_area(p)).alias("area"), r(geom.net_area(p, F.col("holes"))).alias("net_area"), r(mid.x).alias("cx"), r(mid.y).alias("cy"), box.x0.alias("x0"), box.y0.alias("y0"), box.x1.alias("x1"), box.y1.alias("y1"))


VISITS = """, hit as (select p.event_id, p.user_id, s.space_id, row_number() over (partition by p.event_id order by s.ord, s.space_id) k
  from c_ping p join c_space s on s.floor_id = p.floor_id and p.x >= s.x0 and p.x < s.x1 and p.y >= s.y0 and p.y < s.y1
  left join c_hole h on h.space_id = s.space_id and p.x >= h.hx0 and p.x < h.hx1 and p.y >= h.hy0 and p.y < h.hy1 where h.space_id is null)
"""


@query(VISITS + "select space_id, count(*) visits, count(distinct user_id) visitors from hit where k = 1 group by space_id")
def j1_visitors_per_space(c: Campus) -> DataFrame:
    pings = c.pings().select("event_id", "user_id", "plane_id", "x", "y")
    hit = spatial.containing(pings, c.spaces()).groupBy("event_id", "user_id").agg(F.min_by("space_id", F.struct("space_ord", "space_id")).alias("space_id"))
    return hit.groupBy("space_id").agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("user_id").alias("visitors"))


@query(VISITS.replace("order by s.ord, s.space_id", "order by s.ord desc, s.space_id desc") + """
, poi as (select p.event_id, min(q.poi_id) poi_id from c_ping p join c_poi q on q.floor_id = p.floor_id and abs(q.x-p.x) <= 0.5 and abs(q.y-p.y) <= 0.5 and sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) <= 0.5 group by 1)
select p.event_id, case when poi.poi_id is not null then 'poi' else 'space' end kind, coalesce(poi.poi_id, hit.space_id) id
from c_ping p left join poi using (event_id) left join (select * from hit where k = 1) hit using (event_id) where poi.poi_id is not null or hit.space_id is not null""")
def j3_click_hits(c: Campus) -> DataFrame:
    return spatial.hits(c.pings().select("event_id", "plane_id", "x", "y"), c.pois(), c.spaces(), "event_id", 0.5)


@query("""
select poi_id, node_id, round(d, 6) distance from (select p.poi_id, n.node_id, sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)) d,
  row_number() over (partition by p.poi_id order by sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)), n.node_id) k
  from c_poi p join c_nav_node n on n.floor_id = p.floor_id) where k = 1""")
def j4_nearest_node(c: Campus) -> DataFrame:
    return spatial.nearest_node(c.pois(), c.nodes(), "poi_id").select("poi_id", "node_id", r(F.col("distance")).alias("distance"))


@query(""", n as (select s.space_id, n.node_id, n.x, n.y, s.x0, s.y0, s.x1, s.y1, h.hx0, h.hy0, h.hx1, h.hy1 from c_nav_node n join c_space s on s.floor_id = n.floor_id left join c_hole h on h.space_id = s.space_id
   where n.x >= s.x0 - 1 and n.x <= s.x1 + 1 and n.y >= s.y0 - 1 and n.y <= s.y1 + 1),
 d as (select *, case when x >= x0 and x <= x1 and y >= y0 and y <= y1 then least(x-x0, x1-x, y-y0, y1-y) else sqrt(power(greatest(x0-x, 0, x-x1), 2) + power(greatest(y0-y, 0, y-y1), 2)) end outer_d,
   case when hx0 is null then 1e9 when x >= hx0 and x <= hx1 and y >= hy0 and y <= hy1 then least(x-hx0, hx1-x, y-hy0, hy1-y) else sqrt(power(greatest(hx0-x, 0, x-hx1), 2) + power(greatest(hy0-y, 0, y-hy1), 2)) end hole_d from n)
select distinct space_id, node_id from d where outer_d <= 0.5 or hole_d <= 0.5 or (x >= x0 and x < x1 and y >= y0 and y < y1 and not (hx0 is not null and x >= hx0 and x < hx1 and y >= hy0 and y < hy1))""")
def j5_nodes_of_spaces(c: Campus) -> DataFrame:
    return spatial.nodes_of_spaces(c.spaces(), c.nodes().select("plane_id", "node_id", "x", "y"))


OVERLAPS = """, boxes as (select space_id, floor_id, ord, x0 ax0, y0 ay0, x1 ax1, y1 ay1, case when hx0 is null then 0.0 else hx0 end hx0, case when hx0 is null then 0.0 else hy0 end hy0,
   case when hx0 is null then 0.0 else hx1 end hx1, case when hx0 is null then 0.0 else hy1 end hy1 from c_space left join c_hole using (space_id)),
 o as (select a.space_id space_a, b.space_id space_b,
  greatest(0.0, least(a.ax1,b.ax1)-greatest(a.ax0,b.ax0)) * greatest(0.0, least(a.ay1,b.ay1)-greatest(a.ay0,b.ay0))
  - greatest(0.0, least(a.hx1,b.ax1)-greatest(a.hx0,b.ax0)) * greatest(0.0, least(a.hy1,b.ay1)-greatest(a.hy0,b.ay0))
  - greatest(0.0, least(b.hx1,a.ax1)-greatest(b.hx0,a.ax0)) * greatest(0.0, least(b.hy1,a.ay1)-greatest(b.hy0,a.ay0))
  + greatest(0.0, least(a.hx1,b.hx1)-greatest(a.hx0,b.hx0)) * greatest(0.0, least(a.hy1,b.hy1)-greatest(a.hy0,b.hy0)) area
  from boxes a join boxes b on a.floor_id = b.floor_id and a.ord < b.ord and a.ax0 <= b.ax1 and b.ax0 <= a.ax1 and a.ay0 <= b.ay1 and b.ay0 <= a.ay1)
"""


@query(OVERLAPS + "select space_a, space_b, round(area, 6) area from o where area > 1e-9")
def j8_overlapping_spaces(c: Campus) -> DataFrame:
    return spatial.overlapping(c.spaces()).select("space_a", "space_b", r(F.col("area")).alias("area"))


@query("""
select poi_id, space_id, round(d, 6) distance from (select p.poi_id, s.space_id, case when p.x >= s.x0 and p.x <= s.x1 and p.y >= s.y0 and p.y <= s.y1 then least(p.x-s.x0, s.x1-p.x, p.y-s.y0, s.y1-p.y)
   else sqrt(power(greatest(s.x0-p.x, 0, p.x-s.x1), 2) + power(greatest(s.y0-p.y, 0, p.y-s.y1), 2)) end d from c_poi p join c_space s on s.floor_id = p.floor_id
   where p.x >= s.x0 - 2 and p.x <= s.x1 + 2 and p.y >= s.y0 - 2 and p.y <= s.y1 + 2) where d <= 1.5""")
def g10_outline_distance(c: Campus) -> DataFrame:
    rooms = spatial.with_cells(c.spaces().select("plane_id", "space_id", "polygon"), geom.box(F.col("polygon")), 1.5)
    near = spatial.at_cell(c.pois().select("plane_id", "poi_id", "x", "y")).join(rooms, ["plane_id", "cx", "cy"])
    d = geom.nearest_on_ring(F.col("x"), F.col("y"), F.col("polygon")).distance
    return near.withColumn("d", d).filter("d <= 1.5").select("poi_id", "space_id", r(F.col("d")).alias("distance"))


@query("""
select n.node_id, round(b.ox + n.x*cos(radians(b.bearing)) + n.y*sin(radians(b.bearing)), 6) site_x, round(b.oy - n.x*sin(radians(b.bearing)) + n.y*cos(radians(b.bearing)), 6) site_y,
  n.x back_x, n.y back_y from c_nav_node n join c_floor f using (floor_id) join c_building b on b.building_id = f.building_id""")
def g15_node_site_position(c: Campus) -> DataFrame:
    b = [F.col("ox"), F.col("oy"), F.col("bearing")]
    n = c.nodes().select("node_id", "plane_id", "x", "y").join(c.floors().select("plane_id", "ox", "oy", "bearing"), "plane_id").withColumn("s", geom.to_site(F.col("x"), F.col("y"), *b))
    back = geom.to_building(F.col("s.x"), F.col("s.y"), *b)
    return n.select("node_id", r(F.col("s.x")).alias("site_x"), r(F.col("s.y")).alias("site_y"), r(back.x).alias("back_x"), r(back.y).alias("back_y"))


@query(""", w as (select b.building_id, b.ox, b.oy, s.lon, s.lat, 1 - 6.69437999014e-3*sin(radians(s.lat))*sin(radians(s.lat)) w from c_building b join c_site s using (project_id))
select building_id, round(lon + degrees(ox/(6378137.0/sqrt(w)*cos(radians(lat)))), 6) lon, round(lat + degrees(oy/(6378137.0*(1-6.69437999014e-3)/(w*sqrt(w)))), 6) lat,
  case when lon is not null then round(ox, 6) end back_x, case when lon is not null then round(oy, 6) end back_y from w""")
def g16_building_wgs84(c: Campus) -> DataFrame:
    b = c.view("c_building").join(c.view("c_site").select("project_id", F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat")), "project_id")
    b = b.withColumn("g", geom.to_lng_lat(F.col("ox"), F.col("oy"), F.col("a_lon"), F.col("a_lat")))
    back = geom.from_lng_lat(F.col("g.lon"), F.col("g.lat"), F.col("a_lon"), F.col("a_lat"))
    return b.select("building_id", r(F.col("g.lon")).alias("lon"), r(F.col("g.lat")).alias("lat"), r(back.x).alias("back_x"), r(back.y).alias("back_y"))


@query("""
select floor_id plane_id, count(*) spaces, round((max(x1)-min(x0))*(max(y1)-min(y0)), 6) box_area, round(sum((x1-x0)*(y1-y0)), 6) gross_area from c_space group by floor_id""")
def g4_floor_boxes(c: Campus) -> DataFrame:
    s = c.spaces().select("plane_id", geom.box(F.col("polygon")).alias("b"), geom.signed_area(F.col("polygon")).alias("a"))
    area = (F.max("b.x1") - F.min("b.x0")) * (F.max("b.y1") - F.min("b.y0"))
    return s.groupBy("plane_id").agg(F.count(F.lit(1)).alias("spaces"), r(area).alias("box_area"), r(F.sum("a")).alias("gross_area"))


@query(""", o as (select entrance_id, floor_id, type, x, y + (entrance_id % 4) * 0.15::double y, case entrance_id % 6 when 0 then null when 1 then -5 else wall_id end wall_id, width, case type when 'window' then 0.9 else 0 end::double sill,
   coalesce(height, case type when 'window' then 1.2 else 2.1 end)::double tall from c_entrance),
 w as (select *, (ex-sx)*(ex-sx)+(ey-sy)*(ey-sy) l2, case when thickness > 0 then thickness else 0.2 end::double thick, coalesce(height, 2.4)::double wall_height from c_wall),
 k as (select o.entrance_id, w.wall_id, o.width, o.sill, o.tall, w.wall_height, w.thick, sqrt(l2) len, o.x, o.y, sx, sy, ex, ey, case when l2 = 0 then 0 else greatest(0, least(1, ((o.x-sx)*(ex-sx)+(o.y-sy)*(ey-sy))/l2)) end t
   from o join w on w.floor_id = o.floor_id and (o.wall_id is null or o.wall_id = w.wall_id)),
 d as (select *, sqrt(power(x-sx-t*(ex-sx), 2) + power(y-sy-t*(ey-sy), 2)) distance from k),
 b as (select *, row_number() over (partition by entrance_id order by distance, wall_id) n from d where distance <= thick/2 + 0.2::double),
 e as (select entrance_id, wall_id, distance, greatest(0, t*len - width/2) f, least(len, t*len + width/2) g, sill, least(wall_height, sill + tall) top, len from b where n = 1)
select entrance_id, wall_id, round(distance, 6) distance, round(f, 6) from_m, round(g, 6) to_m, round(sill, 6) bottom, round(top, 6) top from e where len >= 0.01 and top > sill and g - f > 0.01""")
def j16_host_walls(c: Campus) -> DataFrame:
    """Doors moved off their walls by up to 45 cm; every sixth names no wall and every sixth one that is missing."""
    n = F.col("entrance_id") % 6
    o = c.entrances().withColumn("y", F.col("y") + (F.col("entrance_id") % 4) * F.lit(0.15)).withColumn("wall_id", F.when(n == 1, -5).when(n != 0, F.col("wall_id")).cast("long"))
    cut = spatial.host_walls(o, c.walls())
    return cut.select("entrance_id", "wall_id", r(F.col("distance")).alias("distance"), r(F.col("from")).alias("from_m"), r(F.col("to")).alias("to_m"), r(F.col("bottom")).alias("bottom"), r(F.col("top")).alias("top"))
