"""Queries of draft plans: wall ends, partitions, ladders of strokes, and scores against the mapped floors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import joints, score
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(c, 6)


@query(""", m as (select w.plan_id, w.stroke_id, o.stroke_id o_id, o.offset_px o_at, abs(w.start_px - o.offset_px) ds, abs(w.end_px - o.offset_px) de, o.thickness_px / 2 + 3 rc from c_stroke w join c_stroke o on w.plan_id = o.plan_id and w.orientation <> o.orientation and w.offset_px >= o.start_px - 3 and w.offset_px <= o.end_px + 3),
 b as (select plan_id, stroke_id, min(case when ds <= rc then {'d': ds, 'i': o_id, 'a': o_at} end) s, min(case when de <= rc then {'d': de, 'i': o_id, 'a': o_at} end) e from m group by 1, 2)
select plan_id, stroke_id, least(coalesce(s.a, start_px), coalesce(e.a, end_px)) start_px, greatest(coalesce(s.a, start_px), coalesce(e.a, end_px)) end_px from c_stroke left join b using (plan_id, stroke_id)""")
def d8_joined_ends(c: Campus) -> DataFrame:
    return joints.joined_ends(c.view("c_stroke"), 3.0).select("plan_id", "stroke_id", "start_px", "end_px")


FAR = "sqrt(power({0} - greatest(w.start_px, least(w.end_px, {0})), 2) + power({1} - w.offset_px, 2))"


@query(""", u as (select * from c_stroke where stroke_id % 2 = 1), wl as (select * from c_stroke where stroke_id % 2 = 0),
 p as (select plan_id, stroke_id, orientation own, place, case when orientation = 'horizontal' then pos else offset_px end x, case when orientation = 'horizontal' then offset_px else pos end y from (
   select *, unnest(['start', 'end', 'middle']) place, unnest([start_px, end_px, (start_px + end_px) / 2]) pos from u where end_px - start_px + 1 >= 30)),
 h as (select p.*, w.orientation, w.thickness_px, case when w.orientation = 'horizontal' then """ + FAR.format("p.x", "p.y") + " else " + FAR.format("p.y", "p.x") + """ end far from p join wl w using (plan_id)),
 g as (select plan_id, stroke_id, bool_or(place = 'start' and far <= thickness_px/2 + 0.5) s, bool_or(place = 'end' and far <= thickness_px/2 + 0.5) e, bool_or(place = 'middle' and own = orientation and far <= thickness_px/2 + 0.25) w from h group by 1, 2)
select plan_id, stroke_id from g where s and e and not w""")
def d7_partitions(c: Campus) -> DataFrame:
    s = c.view("c_stroke")
    return joints.partitions(s.filter("stroke_id % 2 = 1"), s.filter("stroke_id % 2 = 0"), 0.5, 30.0).select("plan_id", "stroke_id").distinct()


def _same(x: str, y: str) -> str:
    return f"abs({x} - {y}) <= greatest(2.0, 0.15 * greatest({x}, {y}))"


@query(""", s as (select * from c_stroke), p as (select a.plan_id, a.stroke_id, a.offset_px o, {'d': abs(b.offset_px - a.offset_px), 'i': b.stroke_id, 'o': b.offset_px, 'a': b.start_px, 'b': b.end_px} n from s a join s b on a.plan_id = b.plan_id and a.orientation = b.orientation and abs(b.offset_px - a.offset_px) > 1 and abs(b.offset_px - a.offset_px) <= 24
   and least(a.end_px, b.end_px) - greatest(a.start_px, b.start_px) + 1 >= greatest(8.0, 0.5 * (least(a.end_px - a.start_px, b.end_px - b.start_px) + 1))),
 q as (select plan_id, stroke_id, o, min(n) filter (n.o < o) p, min(n) filter (n.o > o) n from p group by 1, 2, 3),
 t as (select plan_id, stroke_id, p.i b_id, n.i a_id, (n.o - p.o) / 2 sp from q where p is not null and n is not null and least(p.b, n.b) - greatest(p.a, n.a) + 1 >= greatest(8.0, 0.5 * (least(p.b - p.a, n.b - n.a) + 1)) and """ + _same("(o - p.o)", "(n.o - o)") + """),
 f as (select t.plan_id, unnest([t.b_id, t.stroke_id, t.a_id, z.a_id]) stroke_id from t join t z on z.plan_id = t.plan_id and z.stroke_id = t.a_id where """ + _same("t.sp", "z.sp") + """)
select distinct plan_id, stroke_id from f""")
def d4_ladders(c: Campus) -> DataFrame:
    return joints.ladders(c.view("c_stroke"), 8.0, 24.0)


#: A recognised wall is a mapped one moved a little, and some are lost.
DRAWN = ", t as (select floor_id plan_id, wall_id, sx, sy, ex, ey from c_wall where wall_id % 7 <> 0), p as (select floor_id plan_id, wall_id, sx, sy + cast(wall_id % 5 as double) / 10 sy, ex + 0.5 ex, ey + cast(wall_id % 5 as double) / 10 ey from c_wall where wall_id % 3 <> 0)"


def _samples(a: str, b: str) -> str:
    point = "{'x': sx + (ex-sx)*(i+0.5)/n, 'y': sy + (ey-sy)*(i+0.5)/n}"
    pieces = f"select plan_id, wall_id, i, m/n own, {point} z from (select *, unnest(range(n::bigint)) i from (select *, greatest(1, ceil(m/0.1)) n from (select *, sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) m from {a}) where m > 0))"
    u = "case when (w.ex-w.sx)*(w.ex-w.sx)+(w.ey-w.sy)*(w.ey-w.sy) = 0 then 0 else greatest(0, least(1, ((z.x-w.sx)*(w.ex-w.sx)+(z.y-w.sy)*(w.ey-w.sy))/((w.ex-w.sx)*(w.ex-w.sx)+(w.ey-w.sy)*(w.ey-w.sy)))) end"
    near = f"sqrt(power(z.x - w.sx - {u}*(w.ex-w.sx), 2) + power(z.y - w.sy - {u}*(w.ey-w.sy), 2)) <= 0.2"
    return f"select plan_id, sum(own) m, sum(case when exists (select 1 from {b} w where w.plan_id = k.plan_id and {near}) then own else 0 end) c from ({pieces}) k group by 1"


@query(DRAWN + f""" select plan_id, round(x.c/x.m, 6) "precision", round(y.c/y.m, 6) recall from ({_samples('p', 't')}) x full join ({_samples('t', 'p')}) y using (plan_id)""")
def d18_wall_score(c: Campus) -> DataFrame:
    w = c.walls().withColumnRenamed("plane_id", "plan_id").select("plan_id", "wall_id", "sx", "sy", "ex", "ey")
    by = (F.col("wall_id") % 5).cast("double") / 10
    drawn = w.filter("wall_id % 3 <> 0").withColumn("sy", F.col("sy") + by).withColumn("ey", F.col("ey") + by).withColumn("ex", F.col("ex") + 0.5)
    return score.wall_score(drawn, w.filter("wall_id % 7 <> 0")).select("plan_id", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"))


def _rooms(c: Campus) -> tuple[DataFrame, DataFrame]:
    s = c.spaces().withColumnRenamed("plane_id", "plan_id").select("plan_id", "space_id", "ord", "polygon", "holes")
    shifted = F.transform("polygon", lambda p: F.struct((p.x + (F.col("space_id") % 4).cast("double")).alias("x"), p.y.alias("y")))
    return s.filter("space_id % 6 <> 0").withColumn("polygon", shifted).withColumn("holes", F.slice("holes", 1, 0)), s.filter("space_id % 8 <> 0")


@query(""", t as (select * from c_space where space_id % 8 <> 0), p as (select space_id, floor_id, ord, x0 + space_id % 4 x0, y0, x1 + space_id % 4 x1, y1 from c_space where space_id % 6 <> 0),
 o as (select floor_id, min(x0) ox, min(y0) oy from (select floor_id, x0, y0 from t union all select floor_id, x0, y0 from p) group by 1),
 g as (select *, unnest(range(floor((x0-ox)/0.25)::bigint, floor((x1-ox)/0.25)::bigint + 1)) cx, side from (select *, 't' side from t union all by name select *, 'p' side from p) join o using (floor_id)),
 k as (select *, ox + (cx+0.5)*0.25 x, oy + (cy+0.5)*0.25 y from (select *, unnest(range(floor((y0-oy)/0.25)::bigint, floor((y1-oy)/0.25)::bigint + 1)) cy from g)),
 c as (select floor_id, side, cx, cy, arg_max(space_id, ord) s from k where x > x0 and x < x1 and y > y0 and y < y1 and not (side = 't' and exists (select 1 from c_hole h where h.space_id = k.space_id and x > hx0 and x < hx1 and y > hy0 and y < hy1)) group by 1, 2, 3, 4),
 j as (select floor_id, a.s t, b.s p from (select * from c where side = 't') a full join (select * from c where side = 'p') b using (floor_id, cx, cy)),
 n as (select floor_id, t, p, count(*) n from j group by 1, 2, 3), w as (select *, sum(n) over (partition by floor_id, t) tn, sum(n) over (partition by floor_id, p) pn from n),
 f as (select floor_id, count(distinct t) rooms from w where t is not null and p is not null and n / (tn + pn - n) >= 0.5 group by 1)
select floor_id plan_id, round(sum(case when t is not null and p is not null then n else 0 end) / sum(case when p is not null then n end), 6) "precision", round(sum(case when t is not null and p is not null then n else 0 end) / sum(case when t is not null then n end), 6) recall,
 round(sum(case when t is not null and p is not null then n else 0 end) / sum(n), 6) iou, round(sum(case when p is not null then n end) * 0.0625, 6) predicted_area, round(sum(case when t is not null then n end) * 0.0625, 6) truth_area, coalesce(any_value(rooms), 0)::bigint rooms from n left join f using (floor_id) group by 1""")
def d19_floor_score(c: Campus) -> DataFrame:
    drawn, truth = _rooms(c)
    got = score.floor_score(drawn, truth, cell=0.25, most=None)  # cells of one size, however large the floor
    return got.select("plan_id", *[r(F.col(k)).alias(k) for k in ("precision", "recall", "iou", "predicted_area", "truth_area")], "rooms")


@query()
def d21_matched_points(c: Campus) -> DataFrame:
    """Positions of users taken as recognised openings, matched with the entrances of the floor."""
    truth = c.entrances().select(F.col("plane_id").alias("plan_id"), F.col("entrance_id").alias("truth_id"), F.col("entrance_id").alias("ord"), "x", "y")
    seen = c.pings().select(F.col("plane_id").alias("plan_id"), F.col("event_id").alias("point_id"), "x", "y")
    return score.matched_points(seen, truth, 0.5)
