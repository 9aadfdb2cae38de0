"""Queries of IMDF features: labels, addresses, footprints, openings, amenities, venues, manifests and their issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import export, imdf, spatial
from atrium.plans.graph import SITE
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(c, 6)
UUID = lambda seed: f"regexp_replace(md5({seed}), '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}})$', '\\1-\\2-5\\3-a\\4-\\5')"


def _levels(c: Campus) -> DataFrame:
    return export.levels(c.floors(), c.spaces()).filter("not empty")


@query("""select space_id, case when space_id % 5 = 0 then null else trim(name) end en, case when space_id % 3 = 0 then code end ko from c_space where space_id % 5 <> 0 or space_id % 3 = 0""")
def m2_labels(c: Campus) -> DataFrame:
    name = F.when(F.col("space_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "name"))
    names = F.create_map(F.lit("ko"), F.when(F.col("space_id") % 3 == 0, F.col("code")).otherwise(" "))
    made = c.spaces().select("space_id", imdf.labels(name, names, "en").alias("m")).filter("m is not null")
    return made.select("space_id", F.try_element_at("m", F.lit("en")).alias("en"), F.try_element_at("m", F.lit("ko")).alias("ko"))


ADDRESS = (
    "case when poi_id % 10 = 0 or poi_id % 4 = 0 then null else name end address",
    "case when poi_id % 10 = 0 then '' else segment end locality",
    "case when poi_id % 10 = 0 or poi_id % 3 = 0 then null else 'KR' end country",
)


@query(f""", a as (select poi_id, {", ".join(ADDRESS)} from c_poi)
select 'feature' kind, poi_id::varchar object_id, locality value from a where coalesce(address, '') <> '' or coalesce(locality, '') <> '' or coalesce(country, '') <> ''
 union all select 'missing-address', poi_id::varchar, 'error' from a where coalesce(address, '') = '' and coalesce(locality, '') = '' and coalesce(country, '') = ''
 union all select 'incomplete-address', poi_id::varchar, 'warning' from a where not (coalesce(address, '') = '' and coalesce(locality, '') = '' and coalesce(country, '') = '') and (coalesce(address, '') = '' or coalesce(locality, '') = '' or coalesce(country, '') = '')""")
def m3_addresses(c: Campus) -> DataFrame:
    """Each POI stands in for a site of its own."""
    sites = c.pois().selectExpr("poi_id site_id", *ADDRESS, "cast(null as string) province", "cast(null as string) postal_code")
    made = imdf.addresses(sites).select(F.lit("feature").alias("kind"), F.col("site_id").cast("string").alias("object_id"), F.col("locality").alias("value"))
    return made.union(imdf.address_issues(sites).select("code", "object_id", "severity"))


def _outlines(c: Campus) -> DataFrame:
    corner = lambda x, y: geom.point(F.lit(float(x)), F.lit(float(y)))
    given = F.when(F.col("building_id") % 4 == 0, F.array(corner(0, 0), corner(60, 0), corner(60, 40), corner(0, 40)))
    return imdf.building_outlines(c.view("c_building").withColumn("footprint", given), c.spaces(), c.floors())


@query(""", h as (select f.building_id, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, count(s.space_id) n from c_floor f left join c_space s using (floor_id) group by 1)
select building_id, case when building_id % 4 = 0 then 'given' when n > 0 then 'hull' else 'none' end source, case when building_id % 4 = 0 then null when n > 0 then 'approximated-footprint' else 'missing-footprint' end code,
 case when building_id % 4 = 0 then 0.0 else x0 end x0, case when building_id % 4 = 0 then 0.0 else y0 end y0, case when building_id % 4 = 0 then 60.0 else x1 end x1, case when building_id % 4 = 0 then 40.0 else y1 end y1, p.lon is not null and (building_id % 4 = 0 or n > 0) footprint
from h join c_building b using (building_id) join c_site p using (project_id)""")
def m4_footprints(c: Campus) -> DataFrame:
    out = _outlines(c)
    made = imdf.buildings_and_footprints(out, c.view("c_building"), c.view("c_site")).filter("feature_type = 'footprint'").select("building_id", F.col("geometry").isNotNull().alias("footprint"))
    b = geom.box(F.col("outline"))
    codes = imdf.footprint_issues(out).select(F.col("object_id").cast("long").alias("building_id"), "code")
    rows = out.join(codes, "building_id", "left").join(made, "building_id", "left")
    return rows.select("building_id", "source", "code", b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1"), F.coalesce("footprint", F.lit(False)).alias("footprint"))


@query(f"""select entrance_id, {UUID("'opening|' || entrance_id")} id, round(e.x - case when length > 0 then (ex-sx)/length else 0 end * e.width/2, 6) ax, round(e.y - case when length > 0 then (ey-sy)/length else 0 end * e.width/2, 6) ay,
 round(e.x + case when length > 0 then (ex-sx)/length else 0 end * e.width/2, 6) bx, round(e.y + case when length > 0 then (ey-sy)/length else 0 end * e.width/2, 6) "by"
from c_entrance e join (select *, sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) length from c_wall) w using (wall_id, floor_id) where e.type = 'door'""")
def m7_openings(c: Campus) -> DataFrame:
    made = imdf.openings(c.entrances(), c.walls(), _levels(c))
    return made.select("entrance_id", "id", *[r(F.col(k)).alias(k) for k in ("ax", "ay", "bx", "by")])


IN = "p.x >= s.x0 and p.x < s.x1 and p.y >= s.y0 and p.y < s.y1 and not exists (select 1 from c_hole h where h.space_id = s.space_id and p.x >= hx0 and p.x < hx1 and p.y >= hy0 and p.y < hy1)"
AMENITY = f""", p as (select *, case when poi_id % 6 = 0 then 'restroom' when poi_id % 6 = 1 then 'store' else 'custom' end type, case when poi_id % 4 = 0 then poi_id % 500 end named from c_poi where floor_id in (select floor_id from c_space)),
 u as (select p.poi_id, coalesce(min(n.space_id), arg_min(s.space_id, s.ord)) unit from p left join c_space n on n.space_id = p.named and n.floor_id = p.floor_id left join c_space s on s.floor_id = p.floor_id and {IN} group by 1)
"""


def _typed_pois(c: Campus) -> DataFrame:
    k = F.col("poi_id") % 6
    return c.pois().withColumn("type", F.when(k == 0, "restroom").when(k == 1, "store").otherwise("custom")).withColumn("space_id", F.when(F.col("poi_id") % 4 == 0, F.col("poi_id") % 500))


@query(AMENITY + f"select poi_id, case when type = 'restroom' then 'restroom' else 'unspecified' end category, case when unit is not null then {UUID("'unit|' || unit")} end unit_id from p join u using (poi_id)")
def m8_amenities(c: Campus) -> DataFrame:
    made = imdf.amenities(_typed_pois(c), c.spaces(), _levels(c))
    return made.select("poi_id", "category", F.get("unit_ids", F.lit(0)).alias("unit_id"))


@query(AMENITY + "select 'amenity-without-unit' code, poi_id::varchar object_id from u where unit is null union all select 'store-as-amenity', poi_id::varchar from p where type = 'store'")
def m8_amenity_issues(c: Campus) -> DataFrame:
    return imdf.amenity_issues(_typed_pois(c), c.spaces(), _levels(c)).select("code", "object_id")


@query(SITE.split(" se as")[0].rstrip().rstrip(",") + """, k as (select building_id, unnest([x0, x1, x1, x0]) x, unnest([y0, y0, y1, y1]) y from c_space join c_floor using (floor_id) where building_id % 4 <> 0
  union all select building_id, unnest([0.0, 60.0, 60.0, 0.0]), unnest([0.0, 0.0, 40.0, 40.0]) from c_building where building_id % 4 = 0)
select project_id, round(min(ox + x*cos(radians(bearing)) + y*sin(radians(bearing))), 4) x0, round(min(oy - x*sin(radians(bearing)) + y*cos(radians(bearing))), 4) y0,
 round(max(ox + x*cos(radians(bearing)) + y*sin(radians(bearing))), 4) x1, round(max(oy - x*sin(radians(bearing)) + y*cos(radians(bearing))), 4) y1 from k join c_building using (building_id) group by 1""")
def m10_venues(c: Campus) -> DataFrame:
    b = geom.box(F.col("outline"))
    return imdf.venues(_outlines(c), c.view("c_building"), c.view("c_site")).select("project_id", *[F.round(b[k], 4).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query("""select project_id, case when lon is null then 'missing-geo-anchor' end refused, case when lon is not null then '1.0.0' end version, count(s.space_id)::bigint units from c_site p join c_floor f using (project_id) left join c_space s using (floor_id) group by all""")
def m11_manifests(c: Campus) -> DataFrame:
    """The manifest of each site beside the number of its units."""
    units = c.floors().join(c.spaces().select("plane_id", "space_id"), "plane_id", "left").groupBy("project_id").agg(F.count("space_id").alias("units"))
    made = imdf.manifests(c.view("c_site"), "en", "2024-01-01T00:00:00.000Z")
    return made.join(units, "project_id").select("project_id", "refused", F.get_json_object("manifest", "$.version").alias("version"), "units")


@query(f""", p as (select t.connector_id, t.floor_id, t.node_id, n.x, n.y from c_stop t join c_nav_node n using (node_id)), g as (select connector_id, count(distinct p.floor_id) n from p join c_space s on s.floor_id = p.floor_id and {IN} group by 1)
select distinct 'connector-without-units' code, t.connector_id::varchar object_id from c_stop t left join g using (connector_id) where coalesce(n, 0) < 2""")
def m9_connectors_without_units(c: Campus) -> DataFrame:
    at = c.stops().join(c.nodes().select("node_id", "x", "y"), "node_id").select("connector_id", "plane_id", "node_id", "x", "y")
    home = spatial.first_space(at, c.spaces(), "node_id")
    return imdf.connectors_without_units(at.join(home, "node_id", "left"), _levels(c)).select("code", "object_id")
