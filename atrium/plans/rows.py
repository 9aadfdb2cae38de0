"""Queries that compare rows: calibration, wall panels, face gaps, map features and route choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import draft, export
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(c, 6)


@query(""", p as (select event_id, x, y, (x-1)/0.05::double px, (60-y)/0.05::double py, (accuracy+1)/100 scale from c_ping)
select event_id, round(px, 6) px, round(py, 6) py, round(scale, 6) metres_per_pixel, round(x - px*scale, 6) ox, round(y + py*scale, 6) oy from p""")
def g18_calibrated_plans(c: Campus) -> DataFrame:
    """Every position and the point 3 m right and 4 m up of it are said to be ``accuracy`` + 1 metres apart."""
    state = (F.lit(1.0), F.lit(60.0), F.lit(0.05))
    x, y = F.col("x"), F.col("y")
    new, at = geom.calibrated(x, y, x + 3, y + 4, F.col("accuracy") + 1, *state), geom.world_to_pixel(x, y, *state)
    return c.pings().select("event_id", r(at.x).alias("px"), r(at.y).alias("py"), r(new.metres_per_pixel).alias("metres_per_pixel"), r(new.ox).alias("ox"), r(new.oy).alias("oy"))


@query(""", w as (select wall_id, ex - sx len, coalesce(height, 2.4)::double h, wall_id % 3 <> 0 twice from c_wall where sy = ey and ex - sx > 3.1)
select wall_id, case when h > 2.2 then case when twice then 6 else 3 end else case when twice then 3 else 2 end end panels,
 round(len*h - least(h, 2.1) - case when twice then 0.5*(least(h, 2.2)-least(h, 2.1)) + least(h, 2.2) - 0.9 else 0 end, 6) area from w""")
def g21_wall_panels(c: Campus) -> DataFrame:
    """Each long wall has a door; two of three have a window that overlaps it."""
    hole = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("from", "to", "bottom", "top"), strict=True)])
    holes = F.when(F.col("wall_id") % 3 != 0, F.array(hole(1.5, 3, 0.9, 2.2), hole(1, 2, 0, 2.1))).otherwise(F.array(hole(1, 2, 0, 2.1)))
    w = c.walls().filter("sy = ey and ex - sx > 3.1").withColumn("p", geom.wall_panels(F.col("ex") - F.col("sx"), F.coalesce("height", F.lit(2.4)).cast("double"), holes))
    area = F.aggregate("p", F.lit(0.0), lambda a, p: a + (p["to"] - p["from"]) * (p.top - p.bottom))
    return w.select("wall_id", F.size("p").alias("panels"), r(area).alias("area"))


@query(""", h as (select a.plan_id, floor(b.offset_px - a.offset_px + 0.5)::bigint gap, sum(least(a.end_px, b.end_px) - greatest(a.start_px, b.start_px) + 1) n from c_stroke a join c_stroke b on a.plan_id = b.plan_id and a.orientation = b.orientation
   and b.offset_px - a.offset_px between 3 and 12 where least(a.end_px, b.end_px) - greatest(a.start_px, b.start_px) + 1 >= 20 group by 1, 2),
 s as (select x.plan_id, x.gap, sum(y.n) weight from h x join h y on y.plan_id = x.plan_id and abs(y.gap - x.gap) <= 1 group by 1, 2), k as (select *, row_number() over (partition by plan_id order by weight desc, gap) k from s),
 t as (select plan_id, sum(end_px - start_px + 1) total from c_stroke group by 1) select k.plan_id, k.gap, round(k.weight, 4) weight from k join t using (plan_id) where k.k = 1 and k.weight >= t.total * 0.08""")
def d5_face_gaps(c: Campus) -> DataFrame:
    found = draft.face_gaps(c.view("c_stroke"), 12.0, 20.0)
    return found.select("plan_id", "gap", F.round("weight", 4).alias("weight"))


@query("""select 'navigationNode' kind, cast(node_id as varchar) id, floor_id plane_id, 'Point' shape, type about, round(x, 6) x0, round(y, 6) y0, null::double x1, null::double y1 from c_nav_node
 union all select 'navigationEdge', e.edge_id, e.floor_id, 'LineString', e.type, round(a.x, 6), round(a.y, 6), round(b.x, 6), round(b.y, 6) from c_nav_edge e join c_nav_node a on a.node_id = e.from_id join c_nav_node b on b.node_id = e.to_id""")
def x4_navigation_features(c: Campus) -> DataFrame:
    """Coordinates and properties are read back from the JSON of each feature."""
    made = export.navigation_features(c.nodes(), c.edges(), c.nodes())
    part = lambda path: F.get_json_object("feature", "$." + path)
    number = lambda *paths: r(F.coalesce(*[part("geometry.coordinates" + p).cast("double") for p in paths]))
    point = part("geometry.type") == "Point"
    at = lambda a, b: F.when(point, number(a)).otherwise(number(b))
    return made.select(
        "kind", "id", "plane_id", part("geometry.type").alias("shape"), F.coalesce(part("properties.nodeType"), part("properties.edgeType")).alias("about"),
        at("[0]", "[0][0]").alias("x0"), at("[1]", "[0][1]").alias("y0"), F.when(~point, number("[1][0]")).alias("x1"), F.when(~point, number("[1][1]")).alias("y1"),
    )


@query("""select kind, id, label from (select 'poi' kind, poi_id id, name label from c_poi union all select 'space', space_id, name from c_space where coalesce(trim(name), '') <> '' union all
 select 'node', node_id, type || ' ' || node_id || ' / ' || floor_id from c_nav_node) where contains(lower(label), 'an')""")
def p9_route_choices(c: Campus) -> DataFrame:
    """What a route can start from or end at: every POI, named room and node with a label, narrowed by a word."""
    pois = c.pois().select(F.lit("poi").alias("kind"), F.col("poi_id").alias("id"), F.col("name").alias("label"))
    rooms = c.spaces().filter("coalesce(trim(name), '') <> ''").select(F.lit("space"), "space_id", "name")
    nodes = c.nodes().select(F.lit("node"), "node_id", F.concat_ws(" / ", F.concat_ws(" ", "type", "node_id"), F.col("plane_id").cast("string")))
    return pois.union(rooms).union(nodes).filter(F.contains(F.lower("label"), F.lit("an")))


@query(""", s as (select p.poi_id, b.ox + p.x*cos(radians(b.bearing)) + p.y*sin(radians(b.bearing)) x, b.oy - p.x*sin(radians(b.bearing)) + p.y*cos(radians(b.bearing)) y, t.lon, t.lat, 1 - 6.69437999014e-3*sin(radians(t.lat))*sin(radians(t.lat)) w
   from c_poi p join c_floor f using (floor_id) join c_building b on b.building_id = f.building_id join c_site t on t.project_id = b.project_id)
select poi_id, 'wgs84' as mode, lon is null refused, round(lon + degrees(x/(6378137.0/sqrt(w)*cos(radians(lat)))), 6) a, round(lat + degrees(y/(6378137.0*(1-6.69437999014e-3)/(w*sqrt(w)))), 6) b from s union all
select poi_id, 'auto', false, round(coalesce(lon + degrees(x/(6378137.0/sqrt(w)*cos(radians(lat)))), x), 6), round(coalesce(lat + degrees(y/(6378137.0*(1-6.69437999014e-3)/(w*sqrt(w)))), y), 6) from s""")
def x1_coordinate_modes(c: Campus) -> DataFrame:
    """POIs on the globe and in the mode that suits their project; one project has no anchor."""
    of = lambda mode: export.placed(c.pois(), c.floors(), c.view("c_site"), mode).select("poi_id", F.lit(mode).alias("mode"), "refused", r(F.get("coordinates", F.lit(0))).alias("a"), r(F.get("coordinates", F.lit(1))).alias("b"))
    return of("wgs84").union(of("auto"))
