"""Queries of lookups and search over the campus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import geom
from atrium.operators import places
from atrium.plans.registry import query
from atrium.sources.campus import Campus


@query("select building_id, floor_id plane_id from c_floor where level = 1")
def p2_ground_floors(c: Campus) -> DataFrame:
    return places.ground_floors(c.floors().withColumn("ord", F.col("level")))


@query("""select f.building_id, count(*) > 0 has_rooms, round(min(x0), 6) x0, round(min(y0), 6) y0, round(max(x1), 6) x1, round(max(y1), 6) y1 from c_space s join c_floor f using (floor_id) group by 1""")
def p3_building_outlines(c: Campus) -> DataFrame:
    o = places.outlines(c.view("c_building").select("building_id"), c.spaces(), c.floors()).filter("outline is not null")
    b = geom.box(F.col("outline"))
    return o.select("building_id", (geom.signed_area(F.col("outline")) > 0).alias("has_rooms"), *[F.round(b[k], 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


ASKED = "(values (1, 'store'), (2, 'BUILDING'), (3, 'brand#1'), (4, 'Customer#00000001'), (5, 'auto mobile'), (6, '#'))"
SCORE = "case when t = q then 100 when starts_with(t, q) then 80 when len(list_filter(string_split_regex(lower(raw), '[\\s\\-_/()·]+'), lambda w: starts_with(w, q))) > 0 then 60 when contains(t, q) then 40 else 0 end"


@query(f""", q as (select query_id, replace(lower(text), ' ', '') q from {ASKED} a(query_id, text)),
 pl as (select 'poi' kind, poi_id id, name, unnest([name, segment]) raw from c_poi union all select 'space', space_id, name, unnest([name, code]) from c_space),
 sc as (select query_id, kind, id, name, max({SCORE.replace('t = q', "replace(lower(raw), ' ', '') = q").replace('starts_with(t, q)', "starts_with(replace(lower(raw), ' ', ''), q)").replace('contains(t, q)', "contains(replace(lower(raw), ' ', ''), q)")}) score from pl, q group by 1, 2, 3, 4)
select query_id, rank, kind, id, score from (select *, row_number() over (partition by query_id order by score desc, name, kind, id) rank from sc where score > 0) where rank <= 20""")
def p8_search(c: Campus) -> DataFrame:
    poi = c.pois().select(F.lit("poi").alias("kind"), F.col("poi_id").alias("id"), "name", F.array("name", "segment").alias("texts"))
    space = c.spaces().select(F.lit("space").alias("kind"), F.col("space_id").alias("id"), "name", F.array("name", "code").alias("texts"))
    asked = c.spark.sql(f"select * from {ASKED[1:-1]} as a(query_id, text)")
    return places.search(asked, poi.union(space))


@query("""select floor_id plane_id, coalesce(s, 0)::bigint space, coalesce(w, 0)::bigint wall, coalesce(e, 0)::bigint entrance, coalesce(p, 0)::bigint poi, coalesce(n, 0)::bigint node from
 (select floor_id, count(*) s from c_space group by 1) full join (select floor_id, count(*) w from c_wall group by 1) using (floor_id) full join (select floor_id, count(*) e from c_entrance group by 1) using (floor_id)
 full join (select floor_id, count(*) p from c_poi group by 1) using (floor_id) full join (select floor_id, count(*) n from c_nav_node group by 1) using (floor_id)""")
def a1_objects_per_floor(c: Campus) -> DataFrame:
    of = lambda df, kind: df.select("plane_id", F.lit(kind).alias("kind"))
    every = of(c.spaces(), "space").union(of(c.walls(), "wall")).union(of(c.entrances(), "entrance")).union(of(c.pois(), "poi")).union(of(c.nodes(), "node"))
    return places.object_counts(every)


@query(""", w as (select floor_id window_id, floor_id, 8.0 wx0, 3.0 wy0, 31.0 wx1, 12.0 wy1 from c_floor)
select window_id, space_id id, case when x0 >= wx0 and x1 <= wx1 and y0 >= wy0 and y1 <= wy1 then 'window' else 'crossing' end mode from c_space join w using (floor_id) where x0 <= wx1 and wx0 <= x1 and y0 <= wy1 and wy0 <= y1""")
def p12_window_query(c: Campus) -> DataFrame:
    box = [F.lit(v).alias(k) for k, v in (("wx0", 8.0), ("wy0", 3.0), ("wx1", 31.0), ("wy1", 12.0))]
    windows = c.floors().select(F.col("plane_id").alias("window_id"), "plane_id", *box)
    return places.in_window(c.spaces().select("plane_id", F.col("space_id").alias("id"), "polygon"), windows)
