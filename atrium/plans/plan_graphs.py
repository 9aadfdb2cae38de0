"""Queries of plan graphs: planar graph of strokes, pruning, straight walls, rooms from faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import draft, face_pairs, plan_graph, plan_openings
from atrium.plans.registry import query
from atrium.sources.campus import Campus

STUB, LEAST_PIECE, SHARE, LEAST_ROOM = 8.0, 20.0, 0.02, 100.0
r = lambda c: F.round(F.col(c), 6).alias(c)

#: Nodes are (x, y) of their first point; e: the edges a, b with their first stroke's thickness.
GRAPH = """, st as materialized (select * from c_plan_stroke),
 cr as (select h.plan_id, h.stroke_id h, v.stroke_id v, greatest(h.start_px, least(h.end_px, v.offset_px)) hx, greatest(v.start_px, least(v.end_px, h.offset_px)) vy from st h join st v on h.plan_id = v.plan_id and h.orientation = 'horizontal' and v.orientation = 'vertical'
   and v.offset_px between h.start_px - 3 and h.end_px + 3 and h.offset_px between v.start_px - 3 and v.end_px + 3),
 br as (select plan_id, h stroke_id, hx pos from cr union select plan_id, v, vy from cr union select plan_id, stroke_id, start_px from st union select plan_id, stroke_id, end_px from st),
 pc as (select b.*, s.orientation, s.offset_px, s.thickness_px, lead(pos) over (partition by b.plan_id, b.stroke_id order by pos) nx from br b join st s using (plan_id, stroke_id)),
 pp as materialized (select plan_id, stroke_id, orientation, thickness_px, case when orientation = 'horizontal' then pos else offset_px end x0, case when orientation = 'horizontal' then offset_px else pos end y0, case when orientation = 'horizontal' then nx else offset_px end x1, case when orientation = 'horizontal' then offset_px else nx end y1 from pc where nx is not null),
 pt as materialized (select plan_id, x, y, count(*) n from (select plan_id, x0 x, y0 y from pp union all select plan_id, x1, y1 from pp) group by all),
 nb as materialized (select a.plan_id, a.x, a.y, b.x ox, b.y oy from pt a join pt b on a.plan_id = b.plan_id and abs(a.x - b.x) <= 3 and abs(a.y - b.y) <= 3 and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 9),
 cl as (select plan_id, x, y, x rx, y ry from pt union select c.plan_id, c.x, c.y, nb.ox, nb.oy from cl c join nb on nb.plan_id = c.plan_id and nb.x = c.rx and nb.y = c.ry),
 nd as materialized (select plan_id, x, y, min({'x': rx, 'y': ry}) node from cl group by all),
 ce as materialized (select nd.plan_id, node, sum(pt.x * n) / sum(n) nx, sum(pt.y * n) / sum(n) ny from nd join pt using (plan_id, x, y) group by all),
 ed as (select pp.plan_id, least(a.node, b.node) a, greatest(a.node, b.node) b, orientation, stroke_id, x0, y0, thickness_px from pp join nd a on a.plan_id = pp.plan_id and a.x = x0 and a.y = y0 join nd b on b.plan_id = pp.plan_id and b.x = x1 and b.y = y1 where a.node <> b.node),
 e as materialized (select q.plan_id, q.a, q.b, q.thickness_px, ca.nx ax, ca.ny ay, cb.nx bx, cb.ny by_, sqrt((cb.nx-ca.nx)*(cb.nx-ca.nx) + (cb.ny-ca.ny)*(cb.ny-ca.ny)) len from (select *, row_number() over (partition by plan_id, a, b order by orientation, stroke_id, x0, y0) k from ed) q
   join ce ca on ca.plan_id = q.plan_id and ca.node = q.a join ce cb on cb.plan_id = q.plan_id and cb.node = q.b where k = 1)"""

def _pass(of: str, to: str) -> str:
    return f""", {of}_deg as (select plan_id, n, count(*) c from (select plan_id, a n from {of} union all select plan_id, b from {of}) group by all),
 {to} as materialized (select e.* from {of} e join {of}_deg x on x.plan_id = e.plan_id and x.n = e.a join {of}_deg y on y.plan_id = e.plan_id and y.n = e.b where x.c = 1 and y.c = 1 or (x.c > 1 and y.c > 1) or len > greatest({STUB}, thickness_px))"""

#: Stubs are at most a few edges long here; the last two passes take nothing more.
PRUNED = GRAPH + _pass("e", "e1") + _pass("e1", "e2") + _pass("e2", "e3") + _pass("e3", "e4") + f""",
 pn as (select plan_id, a n, a r from e4 union select plan_id, b, b from e4 union select p.plan_id, p.n, case when e4.a = p.r then e4.b else e4.a end from pn p join e4 on e4.plan_id = p.plan_id and (e4.a = p.r or e4.b = p.r)),
 pl as materialized (select plan_id, n, min(r) piece from pn group by all),
 ps as (select e4.plan_id, piece, sum(len) size from e4 join pl on pl.plan_id = e4.plan_id and pl.n = e4.a group by all),
 pk as (select plan_id, piece from (select *, max(size) over (partition by plan_id) most from ps) where size >= greatest({LEAST_PIECE}, most * {SHARE})),
 g as materialized (select e4.* from e4 join pl on pl.plan_id = e4.plan_id and pl.n = e4.a join pk on pk.plan_id = e4.plan_id and pk.piece = pl.piece)"""

def _graph(c: Campus) -> DataFrame:
    return plan_graph.planar_graph(c.view("c_plan_stroke"), 3.0)

def _pruned(c: Campus) -> DataFrame:
    return plan_graph.pruned(_graph(c), STUB, LEAST_PIECE, SHARE)[0]

@query(GRAPH + " select plan_id, round(ax, 6) ax, round(ay, 6) ay, round(bx, 6) bx, round(by_, 6) as \"by\", thickness_px from e")
def d9_planar_graph(c: Campus) -> DataFrame:
    return _graph(c).select("plan_id", r("ax"), r("ay"), r("bx"), r("by"), "thickness_px")

@query(PRUNED + " select plan_id, round(ax, 6) ax, round(ay, 6) ay, round(bx, 6) bx, round(by_, 6) as \"by\", thickness_px from g")
def d10_pruned_graph(c: Campus) -> DataFrame:
    return _pruned(c).select("plan_id", r("ax"), r("ay"), r("bx"), r("by"), "thickness_px")

@query(PRUNED + """, dt as materialized (select plan_id, {'a': a, 'b': b} id, a n, (bx-ax)/len dx, (by_-ay)/len dy from g union all select plan_id, {'a': a, 'b': b}, b, (ax-bx)/len, (ay-by_)/len from g),
 sp as (select p.plan_id, p.n, p.id, min(q.id) o from dt p join dt q on p.plan_id = q.plan_id and p.n = q.n and p.id <> q.id and p.dx*q.dx + p.dy*q.dy < -0.995 group by all having count(*) = 1),
 sl as materialized (select p.* from sp p join sp q on p.plan_id = q.plan_id and p.n = q.n and p.id = q.o and p.o = q.id),
 sw as (select plan_id, {'a': a, 'b': b} id, {'a': a, 'b': b} r from g union select sw.plan_id, sw.id, sl.o from sw join sl on sl.plan_id = sw.plan_id and sl.id = sw.r),
 wn as (select plan_id, id, min(r) wall from sw group by all),
 wm as materialized (select g.*, wall from g join wn on wn.plan_id = g.plan_id and wn.id = {'a': g.a, 'b': g.b}),
 tp as (select plan_id, wall, {'node': n, 'x': x, 'y': y} t from (select plan_id, wall, a n, ax x, ay y from wm union all select plan_id, wall, b, bx, by_ from wm) group by all having count(*) = 1),
 ww as (select plan_id, wall, sum(thickness_px * len) / sum(len) th, count(*) edges from wm group by all)
select plan_id, round(min(t).x, 6) ax, round(min(t).y, 6) ay, round(max(t).x, 6) bx, round(max(t).y, 6) as "by", round(any_value(th), 6) thickness_px, any_value(edges) edges from tp join ww using (plan_id, wall) group by plan_id, wall""")
def d11_straight_walls(c: Campus) -> DataFrame:
    return plan_graph.straight_walls(_pruned(c)).select("plan_id", r("ax"), r("ay"), r("bx"), r("by"), r("thickness_px"), "edges")

@query(PRUNED + f""", dd as materialized (select plan_id, a u, b v, ax x, ay y, bx tx, by_ ty from g union all select plan_id, b, a, bx, by_, ax, ay from g),
 nx as materialized (select plan_id, v2 u, u v, coalesce(lead(v2) over w, first_value(v2) over w) goes from (select plan_id, u, v v2, x, y, tx, ty from dd) window w as (partition by plan_id, u order by atan2(ty-y, tx-x), v2 rows between unbounded preceding and unbounded following)),
 wk as (select plan_id, u su, v sv, u, v, 0 k from dd union all select w.plan_id, su, sv, w.v, n.goes, k + 1 from wk w join nx n on n.plan_id = w.plan_id and n.u = w.u and n.v = w.v where not (w.v = su and n.goes = sv)),
 fm as (select plan_id, su, sv, min({{'u': u, 'v': v}}) low, count(*) size from wk group by all),
 fc as materialized (select wk.*, fm.size, d.x, d.y, d.tx, d.ty from wk join fm using (plan_id, su, sv) join dd d on d.plan_id = wk.plan_id and d.u = wk.u and d.v = wk.v where fm.low = {{'u': su, 'v': sv}}),
 fa as (select plan_id, su, sv, size, sum(x*ty - tx*y)/2 signed, string_agg(round(x*10)::bigint || ' ' || round(y*10)::bigint, ',' order by k) ring from fc group by all),
 fk as (select *, row_number() over (partition by plan_id order by round(abs(signed), 6) desc, signed desc, su, sv) rk from fa where size >= 3)
select plan_id, size corners, round(abs(signed), 4) area, ring from fk where rk > 1 and abs(signed) >= {LEAST_ROOM}""")
def d12_rooms(c: Campus) -> DataFrame:
    found = plan_graph.rooms(plan_graph.faces(_pruned(c)), LEAST_ROOM)
    corner = F.concat(F.round(F.col("x") * 10).cast("long").cast("string"), F.lit(" "), F.round(F.col("y") * 10).cast("long").cast("string"))
    ring = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", corner.alias("c")))), lambda t: t.c), ",")  # the corners of one room
    return found.groupBy("plan_id", "face").agg(F.count(F.lit(1)).alias("corners"), F.round(F.max("area"), 4).alias("area"), ring.alias("ring")).drop("face")


@query()
def d6_paired_faces(c: Campus) -> DataFrame:
    """Each stroke of the plans drawn as two lines, paired to walls again, with what is left over."""
    s = c.view("c_plan_stroke")
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    lines = s.select("plan_id", (F.col("stroke_id") * 2).alias("twice"), side, "orientation", "offset_px", "start_px", "end_px", F.lit(1.0).alias("thickness_px"))
    lines = lines.select("plan_id", (F.col("twice") + F.col("side")).alias("stroke_id"), "orientation", (F.col("offset_px") + F.col("side") * 6 - 3).alias("offset_px"), (F.col("start_px") + F.col("side") * 2).alias("start_px"), "end_px", "thickness_px")
    walls, left = face_pairs.paired(lines, s.select("plan_id").distinct().withColumn("gap", F.lit(6.0)), 10.0)
    kinds = walls.select(F.lit("wall").alias("kind"), "plan_id", "orientation", "offset_px", "start_px", "end_px", "thickness_px")
    return kinds.union(left.select(F.lit("left"), "plan_id", "orientation", "offset_px", "start_px", "end_px", "thickness_px"))


@query(""", sl as materialized (select a.plan_id, a.stroke_id u, b.stroke_id v from c_plan_stroke a join c_plan_stroke b on a.plan_id = b.plan_id and a.orientation = b.orientation and abs(a.offset_px - b.offset_px) <= greatest(1.5, greatest(a.thickness_px, b.thickness_px) / 2) and a.start_px <= b.end_px + 5 and a.end_px >= b.start_px - 5),
 sc as (select plan_id, u n, v r from sl union select sc.plan_id, sc.n, sl.v from sc join sl on sl.plan_id = sc.plan_id and sl.u = sc.r),
 sm as (select plan_id, n stroke_id, min(r) line from sc group by all)
select plan_id, orientation, round(sum(offset_px * (end_px - start_px + 1)) / sum(end_px - start_px + 1), 6) offset_px, min(start_px) start_px, max(end_px) end_px, max(thickness_px) thickness_px, count(*) strokes from c_plan_stroke join sm using (plan_id, stroke_id) group by plan_id, orientation, line""")
def d2_united_strokes(c: Campus) -> DataFrame:
    """The strokes of each wall line of the plans as one, though their offsets differ by a pixel or two."""
    return draft.united(c.view("c_plan_stroke"), 5.0).withColumn("offset_px", F.round("offset_px", 6))


#: Metres to a pixel of the plans in which openings are looked for.
SCALE = 0.031


@query(f""", w as materialized (select plan_id, stroke_id k, case when orientation = 'horizontal' then start_px else offset_px end * {SCALE} ax, case when orientation = 'horizontal' then offset_px else start_px end * {SCALE} ay, case when orientation = 'horizontal' then end_px else offset_px end * {SCALE} bx, case when orientation = 'horizontal' then offset_px else end_px end * {SCALE} by_, thickness_px * {SCALE} th, orientation o, offset_px * {SCALE} pos, start_px * {SCALE} s, end_px * {SCALE} e from c_plan_stroke),
 gp as (select a.plan_id, a.k i, b.k j, a.o, a.pos, case when b.s > a.e then a.e else b.e end f, case when b.s > a.e then b.s else a.s end t, (a.th+b.th)/2 th from w a join w b on a.plan_id = b.plan_id and a.o = b.o and a.k < b.k and abs(a.pos-b.pos) <= 0.04 and abs(a.th-b.th) <= 0.08 and a.e-a.s >= 0.4 and b.e-b.s >= 0.4 and (b.s > a.e or b.e < a.s)),
 tp as (select plan_id, k, ax x, ay y from w union all select plan_id, k, bx, by_ from w),
 oc as materialized (select *, case when o = 'horizontal' then (f+t)/2 else pos end x, case when o = 'horizontal' then pos else (f+t)/2 end y from gp where t-f between 0.55 and 2.4 and not exists (select 1 from tp where tp.plan_id = gp.plan_id and tp.k <> i and tp.k <> j and (case when o = 'horizontal' then x else y end) > f+0.04 and (case when o = 'horizontal' then x else y end) < t-0.04 and abs((case when o = 'horizontal' then y else x end) - pos) < 0.15)),
 cf as materialized (select b.plan_id, a.i i0, a.j j0, b.i, b.j from oc a join oc b on a.plan_id = b.plan_id and (a.i, a.j) < (b.i, b.j) and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 0.15),
 d1 as materialized (select distinct plan_id, i, j from cf where (plan_id, i0, j0) not in (select (plan_id, i, j) from cf)),
 c2 as materialized (select * from cf anti join d1 using (plan_id, i, j) anti join d1 on d1.plan_id = cf.plan_id and d1.i = cf.i0 and d1.j = cf.j0),
 d2 as (select distinct plan_id, i, j from c2 where (plan_id, i0, j0) not in (select (plan_id, i, j) from c2))
select plan_id, i, j, round(x, 6) x, round(y, 6) y, round(t-f, 6) width, round(th, 6) thickness from oc anti join (select * from d1 union select * from d2) using (plan_id, i, j)""")
def d13_openings(c: Campus) -> DataFrame:
    """The gaps of the plans in which a door, a window or a passage may be."""
    s = c.view("c_plan_stroke")
    flat = F.col("orientation") == "horizontal"
    side = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b)) * SCALE
    walls = s.select("plan_id", F.col("stroke_id").alias("wall_id"), side("start_px", "offset_px").alias("ax"), side("offset_px", "start_px").alias("ay"), side("end_px", "offset_px").alias("bx"), side("offset_px", "end_px").alias("by"), (F.col("thickness_px") * SCALE).alias("thickness"))
    return plan_openings.openings(walls).select("plan_id", "i", "j", r("x"), r("y"), r("width"), r("thickness"))
