"""Queries of trips, guidance, rules, drafts, exports and maintenance over the campus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import draft, export, maintain, trips
from atrium.plans.registry import query
from atrium.sources.campus import Campus
from atrium.streaming import guidance, rules

r = lambda c: F.round(c, 6)

TOUR = """, pt as (select user_id path_id, event_id ord, x, y, lag(x) over w px, lag(y) over w py from c_ping window w as (partition by user_id order by event_id)),
 kp as (select path_id, ord, x, y from pt where px is null or sqrt((x-px)*(x-px)+(y-py)*(y-py)) > 1e-6),
 sg as (select path_id, ord, x, y, coalesce(sqrt((x-lag(x) over w)*(x-lag(x) over w)+(y-lag(y) over w)*(y-lag(y) over w)), 0) gap from kp window w as (partition by path_id order by ord))
"""


def _tours(c: Campus) -> DataFrame:
    return c.pings().select(F.col("user_id").alias("path_id"), F.col("event_id").alias("ord"), "x", "y")


@query(TOUR + "select path_id, count(*) points, round(sum(gap), 4) metres from sg group by path_id")
def n22_path_lengths(c: Campus) -> DataFrame:
    return trips.arc_lengths(_tours(c)).groupBy("path_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.max("along"), 4).alias("metres"))


@query(TOUR + "select path_id, 1 + sum(greatest(1, ceil(gap/2.0)))::bigint points from sg where gap > 0 group by path_id")
def n25_densified_paths(c: Campus) -> DataFrame:
    measured = trips.arc_lengths(_tours(c))
    return trips.densified(measured, 2.0).groupBy("path_id").agg(F.count(F.lit(1)).alias("points")).filter("points > 1")


@query("""select user_id route_id, count(distinct leg) legs from (select user_id, sum(case when floor_id = p then 0 else 1 end) over (partition by user_id order by event_id) leg from (select *, lag(floor_id) over (partition by user_id order by event_id) p from c_ping)) group by 1""")
def n19_route_legs(c: Campus) -> DataFrame:
    steps = c.pings().select(F.col("user_id").alias("route_id"), F.col("event_id").alias("ord"), "plane_id", "x", "y")
    return trips.legs(steps).groupBy("route_id").agg(F.countDistinct("leg_no").alias("legs"))


@query("""select user_id trip_id, round(sum(case when event_type = 'view' then value/1.3 else least(4.0, greatest(1.5, value/8)) end), 4) as seconds from events group by 1""")
def n26_timelines(c: Campus) -> DataFrame:
    e = c.spark.read.parquet(f"{c.sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "walk").otherwise("change")
    parts = e.select(F.col("user_id").alias("trip_id"), F.col("event_id").alias("ord"), kind.alias("kind"), F.col("value").alias("metres"), F.col("value").alias("seconds"))
    return trips.timeline(parts).groupBy("trip_id").agg(F.round(F.max(F.col("starts") + F.col("lasts")), 4).alias("seconds"))


ALERTS = """, m as (select user_id k, event_id, ts, x, y, accuracy, sqrt((x-50)*(x-50)+(y-12)*(y-12)) e,
   case when x between 5 and 50 then abs(y-2) when x < 5 then sqrt((x-5)*(x-5)+(y-2)*(y-2)) else sqrt((x-50)*(x-50)+(y-2)*(y-2)) end d1,
   case when y between 2 and 12 then abs(x-50) when y < 2 then sqrt((x-50)*(x-50)+(y-2)*(y-2)) else sqrt((x-50)*(x-50)+(y-12)*(y-12)) end d2 from c_ping),
 f as (select *, e <= 2 + accuracy arrives, least(d1, d2) > 4 + accuracy and not e <= 2 + accuracy off from m),
 g as (select *, coalesce(max(case when arrives then 1 else 0 end) over (partition by k order by ts, event_id rows between unbounded preceding and 1 preceding), 0) done,
   coalesce(lag(least(d1, d2) > 4 + accuracy) over (partition by k order by ts, event_id), false) was from f)
"""


def _routes(c: Campus) -> DataFrame:
    """One route on every floor for every visitor: (5, 2) to (50, 2) to (50, 12)."""
    p = c.pings().select(F.col("user_id").alias("key"), "plane_id").distinct()
    seg = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("ax", "ay", "bx", "by"), strict=True)])
    end = F.struct(F.lit(50.0).alias("x"), F.lit(12.0).alias("y"))
    return p.select("key", "plane_id", F.array(seg(5, 2, 50, 2), seg(50, 2, 50, 12)).alias("segments"), end.alias("end"), F.lit(2.0).alias("arrival_radius"), F.lit(4.0).alias("off_route"))


@query(ALERTS + "select k as key, event_id ping_id, case when arrives then 'route.arrived' else 'route.offRoute' end kind, case when not arrives then round(least(d1, d2), 6) end distance from g where done = 0 and (arrives or (off and not was))")
def t2_guidance_alerts(c: Campus) -> DataFrame:
    p = c.pings().select(F.col("user_id").alias("key"), F.col("event_id").alias("ping_id"), "ts", "plane_id", "x", "y", "accuracy")
    return guidance.alerts(p, _routes(c)).select("key", "ping_id", "kind", r(F.col("distance")).alias("distance"))


@query("""select e.event_id, r.rule_id, 0::bigint ord, r.action from events e join c_rule r on r.event = e.event_type where case r.operator
 when 'gt' then cast(json_extract_string(e.props, '$.k') as double) > cast(r.value as double) when 'lt' then cast(json_extract_string(e.props, '$.k') as double) < cast(r.value as double)
 when 'equals' then cast(json_extract_string(e.props, '$.k') as double) = cast(r.value as double) else false end""")
def t6_matched_rules(c: Campus) -> DataFrame:
    e = c.spark.read.parquet(f"{c.sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("event"), F.col("props").alias("payload"))
    rule = c.view("c_rule").select("rule_id", "event", F.array(F.struct(F.lit("k").alias("field"), "operator", "value")).alias("conditions"), F.array("action").alias("actions"))
    return rules.matched(e, rule).withColumn("ord", F.col("ord").cast("long"))


STRICT = [
    (10, "view", "k", "equals", "60"), (11, "view", "k", "equals", '"60"'), (12, "click", "k", "in", '[1, "2", true, 55]'), (13, "click", "k", "notIn", '[1, "2", true]'), (14, "click", "k", "notIn", '"2"'),
    (15, "purchase", "a.k", "gt", "50"), (16, "purchase", "k", "lt", "20"), (17, "view", "k", "notEquals", "true"), (18, "view", "a.k", "equals", "7"), (19, "view", "k", "gt", '"50"'), (20, "click", "k", "between", "1"),
]
PAYLOADS = """case event_id % 5 when 0 then concat('{"k": ', event_id % 100, '}') when 1 then concat('{"k": "', event_id % 100, '"}') when 2 then concat('{"a": {"k": ', event_id % 100, '}}') when 3 then case when event_id % 2 = 0 then '{"k": true}' else '{"k": null}' end else '{}' end"""


@query(f""", q as (select * from (values {", ".join(f"({i}, '{e}', '{f}', '{o}', '{v}')" for i, e, f, o, v in STRICT)}) q(rule_id, event, field, operator, value)),
 p as (select event_id, event_type, cast({PAYLOADS} as json) payload from events),
 m as (select p.event_id, q.rule_id, q.operator, json_extract(payload, '$.' || q.field) v, cast(q.value as json) w from p join q on q.event = p.event_type),
 k as (select *, v is not null and json_type(v) = json_type(w) and cast(v as varchar) = cast(w as varchar) same, json_type(w) = 'ARRAY' listed, case when json_type(w) = 'ARRAY' then coalesce(list_contains(list_transform(json_extract(w, '$[*]'), lambda x: cast(x as varchar)), cast(v as varchar)), false) else false end inside,
   json_type(v) = 'UBIGINT' and json_type(w) = 'UBIGINT' numbers from m)
select event_id, rule_id from k where case operator when 'equals' then same when 'notEquals' then not same when 'in' then listed and inside when 'notIn' then listed and not inside
 when 'gt' then numbers and try_cast(cast(v as varchar) as double) > try_cast(cast(w as varchar) as double) when 'lt' then numbers and try_cast(cast(v as varchar) as double) < try_cast(cast(w as varchar) as double) else false end""")
def t6_strict_conditions(c: Campus) -> DataFrame:
    """Payloads with numbers, strings, truth values, nulls, nested and missing fields."""
    e = c.spark.read.parquet(f"{c.sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("event"), F.expr(PAYLOADS).alias("payload"))
    cond = "array<struct<field:string,operator:string,value:string>>"
    rule = c.spark.createDataFrame([(i, e_, [(f, o, v)], ["act"]) for i, e_, f, o, v in STRICT], f"rule_id int, event string, conditions {cond}, actions array<string>")
    return rules.matched(e, rule).select("event_id", "rule_id")


@query(""", t as (select plan_id, thickness_px, sum(end_px-start_px+1) n from c_stroke where thickness_px >= 2 and end_px-start_px+1 >= 2*thickness_px group by 1, 2),
 u as (select *, sum(n) over (partition by plan_id order by thickness_px desc) run, sum(n) over (partition by plan_id) total from t), d as (select plan_id, max(thickness_px) dominant from u where run >= total*0.3 group by 1)
select s.plan_id, case when dominant >= 4 and thickness_px < dominant*0.5 then 'thin' else 'wall' end part, count(*) strokes, round(sum(end_px-start_px+1), 4) pixels
 from c_stroke s join d using (plan_id) where thickness_px >= 2 and end_px-start_px+1 >= 2*thickness_px group by 1, 2""")
def d1_split_strokes(c: Campus) -> DataFrame:
    return draft.split(c.view("c_stroke"), 2.0).groupBy("plan_id", "part").agg(F.count(F.lit(1)).alias("strokes"), F.round(F.sum(draft.length()), 4).alias("pixels"))


@query("""select plan_id, count(*) strokes, sum(stroke_id)::bigint ids from c_stroke s where not exists (select 1 from c_stroke c where c.plan_id = s.plan_id and c.orientation = s.orientation and c.stroke_id <> s.stroke_id
 and c.end_px-c.start_px > s.end_px-s.start_px and c.start_px <= s.start_px+2 and c.end_px >= s.end_px-2 and abs(c.offset_px-s.offset_px) <= (c.thickness_px+s.thickness_px)/2+3) group by 1""")
def d3_without_fringes(c: Campus) -> DataFrame:
    return draft.without_fringes(c.view("c_stroke"), 2.0).groupBy("plan_id").agg(F.count(F.lit(1)).alias("strokes"), F.sum("stroke_id").alias("ids"))


@query(""", o as (select *, max(end_px) over (partition by plan_id, orientation, offset_px order by start_px, end_px, stroke_id rows between unbounded preceding and 1 preceding) b from c_stroke),
 i as (select *, sum(case when start_px <= b + 4 then 0 else 1 end) over (partition by plan_id, orientation, offset_px order by start_px, end_px, stroke_id) g from o)
select plan_id, orientation, count(*) walls, round(sum(e-s+1), 4) pixels from (select plan_id, orientation, offset_px, g, min(start_px) s, max(end_px) e from i group by 1, 2, 3, 4) group by 1, 2""")
def d2_fused_strokes(c: Campus) -> DataFrame:
    return draft.fused(c.view("c_stroke"), 3.0).groupBy("plan_id", "orientation").agg(F.count(F.lit(1)).alias("walls"), F.round(F.sum(draft.length()), 4).alias("pixels"))


@query(""", w as (select floor_id plan_id, thickness, row_number() over (partition by floor_id order by thickness, wall_id) k, count(*) over (partition by floor_id) n from c_wall)
select plan_id, thickness median, not (thickness between 0.06 and 0.6) odd_scale from w where n >= 3 and k = n // 2 + 1""")
def d16_median_thickness(c: Campus) -> DataFrame:
    return draft.median_thickness(c.walls().withColumnRenamed("plane_id", "plan_id"))


@query("""select kind, count(*) features from (select 'space' kind from c_space union all select 'wall' from c_wall union all select 'entrance' from c_entrance union all select 'poi' from c_poi) group by 1""")
def x3_geojson_features(c: Campus) -> DataFrame:
    made = export.geojson(c.spaces(), c.walls(), c.entrances(), c.pois())
    return made.filter(F.get_json_object("feature", "$.geometry.type").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("features"))


@query("""select category, count(*) units, count(distinct floor_id) levels from (select floor_id, case type when 'room' then 'room' when 'store' then 'room' when 'corridor' then 'walkway' else 'unspecified' end category from c_space) group by 1""")
def m6_imdf_units(c: Campus) -> DataFrame:
    level = export.levels(c.floors(), c.spaces()).filter("not empty")
    return export.units(c.spaces(), level).groupBy("category").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("level_id").alias("levels"))


@query("""select f.floor_id plane_id, f.level - 1 as ordinal, s.floor_id is null empty from c_floor f left join (select distinct floor_id from c_space) s using (floor_id)""")
def m5_imdf_levels(c: Campus) -> DataFrame:
    return export.levels(c.floors(), c.spaces()).select("plane_id", "ordinal", "empty")


@query(""", s as (select connector_id, kind, node_id, row_number() over (partition by connector_id order by elevation, level) k, count(*) over (partition by connector_id) n from c_stop)
select connector_id, 'elevator' as type, max(case when k = 1 then node_id end) origin, max(case when k = n then node_id end) destination, max(n) - 2 between_stops from s where kind = 1 and n >= 2 group by 1
union all select a.connector_id, 'stairs', a.node_id, b.node_id, 0 from s a join s b on a.connector_id = b.connector_id and b.k = a.k + 1 where a.kind = 2""")
def m9_imdf_relationships(c: Campus) -> DataFrame:
    return export.relationships(c.stops()).select("connector_id", "type", "origin", "destination", F.size("between").cast("long").alias("between_stops"))


@query("""select (select count(*) from c_space where space_id % 10 <> 0) spaces, (select count(*) from c_wall where wall_id % 10 <> 0) walls, (select count(*) from c_entrance where space_a % 10 <> 0) named_entrances,
 (select count(*) from c_entrance where wall_id % 10 <> 0) hosted_entrances, (select count(*) from c_nav_node where node_id % 10 <> 0) nodes, (select count(*) from c_nav_edge where from_id % 10 <> 0 and to_id % 10 <> 0) edges""")
def b1_cascade_delete(c: Campus) -> DataFrame:
    """What is left after deleting every tenth room, wall and node."""
    tenth = lambda df, key, kind: df.filter(F.col(key) % 10 == 0).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    gone = tenth(c.spaces(), "space_id", "space").union(tenth(c.walls(), "wall_id", "wall")).union(tenth(c.nodes(), "node_id", "node"))
    # an entrance that names a missing room keeps its reference unless that id is deleted
    missing = c.entrances().filter("space_a % 10 = 0").select(F.lit("space").alias("kind"), F.col("space_a").alias("id"))
    left = maintain.cascade({"spaces": c.spaces(), "walls": c.walls(), "entrances": c.entrances(), "nodes": c.nodes(), "edges": c.edges()}, gone.union(missing))
    e = left["entrances"].agg(F.count("space_a").alias("named_entrances"), F.count("wall_id").alias("hosted_entrances"))
    for name in ("spaces", "walls", "nodes", "edges"):
        e = e.join(left[name].agg(F.count(F.lit(1)).alias(name)))
    return e


@query(""", h as (select p.poi_id, s.space_id, row_number() over (partition by p.poi_id order by s.ord, s.space_id) k from c_poi p join c_space s on s.floor_id = p.floor_id and p.x >= s.x0 and p.x < s.x1 and p.y >= s.y0 and p.y < s.y1
  left join c_hole o on o.space_id = s.space_id and p.x >= o.hx0 and p.x < o.hx1 and p.y >= o.hy0 and p.y < o.hy1 where o.space_id is null)
select p.poi_id, h.space_id from c_poi p left join (select * from h where k = 1) h using (poi_id)""")
def b9_rehomed_pois(c: Campus) -> DataFrame:
    return maintain.rehomed(c.pois(), c.spaces(), "poi_id").select("poi_id", "space_id")
