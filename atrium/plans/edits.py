"""Queries of rounded routes, snapped points, and walls that move with what touches them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.operators import rounding, snapping, trips, wall_moves
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(F.col(c), 6).alias(c)


def _apart(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """The distance of a point from a segment, in SQL."""
    dx, dy = f"({bx}-{ax})", f"({by}-{ay})"
    t = f"greatest(0, least(1, coalesce((({px}-{ax})*{dx}+({py}-{ay})*{dy})/nullif({dx}*{dx}+{dy}*{dy}, 0), 0)))"
    return f"sqrt(power({px}-{ax}-{t}*{dx}, 2)+power({py}-{ay}-{t}*{dy}, 2))"


_K = "((g.x1-g.x0)*(o.ey-o.sy)-(g.y1-g.y0)*(o.ex-o.sx))"
_MEET = f"(((o.sx-g.x0)*(o.ey-o.sy)-(o.sy-g.y0)*(o.ex-o.sx))/nullif({_K}, 0) between 0 and 1 and ((o.sx-g.x0)*(g.y1-g.y0)-(o.sy-g.y0)*(g.x1-g.x0))/nullif({_K}, 0) between 0 and 1)"
_NEAR = f"case when {_MEET} then 0 else least({_apart('g.x0', 'g.y0', 'o.sx', 'o.sy', 'o.ex', 'o.ey')}, {_apart('g.x1', 'g.y1', 'o.sx', 'o.sy', 'o.ex', 'o.ey')}, {_apart('o.sx', 'o.sy', 'g.x0', 'g.y0', 'g.x1', 'g.y1')}, {_apart('o.ex', 'o.ey', 'g.x0', 'g.y0', 'g.x1', 'g.y1')}) end"
_ON = lambda t: f"x+ux*r*power(1-{t}, 2)+vx*r*power({t}, 2) {{}}, y+uy*r*power(1-{t}, 2)+vy*r*power({t}, 2) {{}}"

#: co: the corners of each visitor's way on each floor; tk: the first radius that is clear.
ROUNDED = f""", lf as (select *, lag(floor_id) over (partition by user_id order by event_id) pf from c_ping),
 ll as (select *, sum(case when floor_id = pf then 0 else 1 end) over (partition by user_id order by event_id)::bigint leg from lf),
 l0 as (select user_id, leg, floor_id, event_id, x, y, lag(x) over w px, lag(y) over w py from ll window w as (partition by user_id, leg order by event_id)),
 l1 as (select * from l0 where px is null or sqrt((x-px)*(x-px)+(y-py)*(y-py)) > 1e-6),
 l2 as (select user_id, leg, floor_id, event_id, x, y, lag(x) over w ax, lag(y) over w ay, lead(x) over w bx, lead(y) over w by_ from l1 window w as (partition by user_id, leg order by event_id)),
 l3 as (select *, sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y)) la, sqrt((bx-x)*(bx-x)+(by_-y)*(by_-y)) lb from l2),
 l4 as (select *, (ax-x)/la ux, (ay-y)/la uy, (bx-x)/lb vx, (by_-y)/lb vy from l3),
 co as materialized (select *, ux*vx+uy*vy c, greatest(2, ceil((pi()-acos(greatest(-1, least(1, ux*vx+uy*vy))))/(pi()/16)))::bigint steps, least(0.8, la*0.45, lb*0.45) r0 from l4),
 tr as materialized (select user_id, leg, floor_id, event_id, x, y, ux, uy, vx, vy, steps, k, r0*power(0.6, k) r from co cross join range(8) t(k) where c >= -0.9995 and r0*power(0.6, k) > 1e-6),
 ob as (select floor_id, sx, sy, ex, ey, greatest(0, thickness/2) cl from c_wall union all select s.floor_id, unnest([hx0, hx1, hx1, hx0]), unnest([hy0, hy0, hy1, hy1]), unnest([hx1, hx1, hx0, hx0]), unnest([hy0, hy1, hy1, hy0]), 0 from c_hole h join c_space s using (space_id)),
 hb as materialized (select t.*, sx, sy, ex, ey, cl, row_number() over () pair from tr t join ob o on o.floor_id = t.floor_id and least(sx, ex)-cl <= greatest(x, x+ux*r, x+vx*r) and greatest(sx, ex)+cl >= least(x, x+ux*r, x+vx*r) and least(sy, ey)-cl <= greatest(y, y+uy*r, y+vy*r) and greatest(sy, ey)+cl >= least(y, y+uy*r, y+vy*r)),
 cv as (select pair, min({_NEAR}) d from (select pair, {_ON('(i::double/steps)').format('x0', 'y0')}, {_ON('((i+1)::double/steps)').format('x1', 'y1')} from (select *, unnest(range(steps)) i from hb)) g join hb o using (pair) group by 1),
 sh as (select pair, min({_NEAR}) d from (select pair, x x0, y y0, x+ux*r x1, y+uy*r y1 from hb union all select pair, x, y, x+vx*r, y+vy*r from hb) g join hb o using (pair) group by 1),
 bd as (select distinct user_id, leg, event_id, k from hb join cv using (pair) join sh using (pair) where not (cv.d > 0 and cv.d >= cl) and (cv.d <= 0 and sh.d > 0 or cv.d < least(cl, sh.d)-1e-6)),
 tk as materialized (select * from (select *, row_number() over (partition by user_id, leg, event_id order by k) n from tr anti join bd using (user_id, leg, event_id, k)) where n = 1)
 select user_id, leg, event_id, i step, {_ON('(i::double/steps)').format('px', 'py')}, r from (select *, unnest(range(steps+1)) i from tk)
 union all select user_id, leg, event_id, 0, x, y, null from co anti join tk using (user_id, leg, event_id)"""


@query(", rp as (select * from (" + ROUNDED.replace(", lf as", "with lf as", 1) + ")) select user_id, leg, event_id, step, round(px, 6) x, round(py, 6) y, round(r, 6) radius from rp")
def n23_rounded_routes(c: Campus) -> DataFrame:
    """The way of every visitor on every floor, with rounded corners that keep clear of walls and holes."""
    steps = trips.legs(c.pings().select(F.col("user_id").alias("route_id"), F.col("event_id").alias("ord"), "plane_id", "x", "y"))
    points = steps.select(F.struct("route_id", "leg_no").alias("path_id"), "plane_id", "ord", "x", "y")
    out = rounding.rounded(points, rounding.obstacles(c.walls(), c.spaces()))
    return out.select(F.col("path_id.route_id").alias("user_id"), F.col("path_id.leg_no").alias("leg"), F.col("ord").alias("event_id"), F.col("step").cast("long").alias("step"), r("x"), r("y"), r("radius"))


_HELD = lambda v, a, b: f"least(greatest({a}, {b}), greatest(least({a}, {b}), floor({v}/0.5+0.5)*0.5))"
_T = "greatest(0, least(1, coalesce(((q.x-l.ax)*(l.bx-l.ax)+(q.y-l.ay)*(l.by_-l.ay))/nullif((l.bx-l.ax)*(l.bx-l.ax)+(l.by_-l.ay)*(l.by_-l.ay), 0), 0)))"
#: q: the points to snap, with the position before as reference; ln: edges in order.
SNAPPED = f""", q as materialized (select event_id, floor_id, x, y, case when event_id % 3 <> 0 then lag(x) over w end rx, case when event_id % 3 <> 0 then lag(y) over w end ry, case when event_id % 4 = 0 then 'wall-' || (event_id % 100 * 2) end ex from c_ping window w as (partition by floor_id, cast(round(y) as bigint) order by x, event_id)),
 ln as materialized (select floor_id, 'space-' || space_id o, 0 kind, ord, space_id id, i, case when i in (0, 3) then x0 else x1 end ax, case when i < 2 then y0 else y1 end ay, case when i in (0, 1) then x1 else x0 end bx, case when i in (1, 2) then y1 else y0 end by_ from c_space cross join range(4) t(i)
   union all select floor_id, 'wall-' || wall_id, 1, null, wall_id, 0, sx, sy, ex, ey from c_wall),
 vt as (select floor_id, o, kind, ord, id, i, ax, ay from ln union all select floor_id, o, kind, ord, id, 1, bx, by_ from ln where kind = 1),
 sv as (select * from (select event_id, ax, ay, row_number() over (partition by event_id order by d, kind, ord, id, i) n from (select q.event_id, vt.*, sqrt((q.x-ax)*(q.x-ax)+(q.y-ay)*(q.y-ay)) d from q join vt on vt.floor_id = q.floor_id and abs(q.x-ax) <= 0.2 and abs(q.y-ay) <= 0.2 and (q.ex is null or q.ex <> o)) where d < 0.2) where n = 1),
 se as (select * from (select *, row_number() over (partition by event_id order by d, kind, ord, id, i) n from (select q.event_id, kind, ord, id, i, {_apart('q.x', 'q.y', 'ax', 'ay', 'bx', 'by_')} d, case when abs(ay-by_) < 1e-9 then {_HELD(f'(ax+{_T}*(bx-ax))', 'ax', 'bx')} when abs(ax-bx) < 1e-9 then ax else ax+{_T}*(bx-ax) end hx, case when abs(ay-by_) < 1e-9 then ay when abs(ax-bx) < 1e-9 then {_HELD(f'(ay+{_T}*(by_-ay))', 'ay', 'by_')} else ay+{_T}*(by_-ay) end hy
   from q join ln l on l.floor_id = q.floor_id and (q.ex is null or q.ex <> o) and q.x between least(ax, bx)-0.15 and greatest(ax, bx)+0.15 and q.y between least(ay, by_)-0.15 and greatest(ay, by_)+0.15) where d < 0.15) where n = 1),
 so as (select event_id, case when abs(x-rx) <= 0.15 and abs(x-rx) <= abs(y-ry) then rx else floor(x/0.5+0.5)*0.5 end hx, case when abs(x-rx) <= 0.15 and abs(x-rx) <= abs(y-ry) then floor(y/0.5+0.5)*0.5 else ry end hy from q where abs(x-rx) <= 0.15 and abs(x-rx) <= abs(y-ry) or abs(y-ry) <= 0.15 and abs(y-ry) < abs(x-rx)),
 of as (select event_id, 0 rk, 'vertex' kind, ax hx, ay hy from sv union all select event_id, 1, 'grid', floor(x/0.5+0.5)*0.5, floor(y/0.5+0.5)*0.5 from q union all select event_id, 2, 'edge', hx, hy from se union all select event_id, 3, 'orthogonal', hx, hy from so)
select event_id, kind, round(hx, 6) x, round(hy, 6) y from (select of.*, row_number() over (partition by event_id order by sqrt((hx-x)*(hx-x)+(hy-y)*(hy-y)), rk) n from of join q using (event_id)) where n = 1"""


@query(SNAPPED)
def p13_snapped_points(c: Campus) -> DataFrame:
    """Every position as if it were drawn, on a grid of half a metre; most have a reference point, some an object of their own."""
    w = Window.partitionBy("plane_id", F.round("y").cast("long")).orderBy("x", "event_id")
    before = lambda col: F.when(F.col("event_id") % 3 != 0, F.lag(col).over(w))
    points = c.pings().select(F.col("event_id").alias("point_id"), "plane_id", "x", "y", before("x").alias("rx"), before("y").alias("ry"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("wall-"), F.col("event_id") % 100 * 2)).alias("excluded"))
    return snapping.snapped(points, c.spaces(), c.walls(), grid=0.5).select(F.col("point_id").alias("event_id"), "kind", r("x"), r("y"))


def _draft(c: Campus) -> wall_moves.Draft:
    """The campus as a draft: doors bring a piece of wall if their id is even; all are accepted but every sixth."""
    e = c.entrances()
    piece = F.struct((F.col("x") - F.col("width") / 2).alias("sx"), F.col("y").alias("sy"), (F.col("x") + F.col("width") / 2).alias("ex"), F.col("y").alias("ey"))
    elements = e.select("plane_id", F.col("entrance_id").alias("element_id"), "x", "y", "width", (F.col("entrance_id") % 6 != 0).alias("accepted"), F.when(F.col("entrance_id") % 2 == 0, piece).alias("support"))
    return wall_moves.Draft(c.walls(), c.spaces(), elements)


def _rows(draft: wall_moves.Draft) -> DataFrame:
    """kind, id, part, x, y of everything in a draft; an element's part says whether it is accepted."""
    point = lambda part, x, y: F.struct(F.lit(part).alias("part"), F.col(x).alias("x"), F.col(y).alias("y"))
    w = draft.walls.select(F.lit("wall").alias("kind"), F.col("wall_id").alias("id"), F.explode(F.array(point(0, "sx", "sy"), point(1, "ex", "ey"))).alias("p"))
    s = draft.spaces.select(F.lit("space"), F.col("space_id"), F.explode(F.transform("polygon", lambda p, i: F.struct(i.alias("part"), p.x.alias("x"), p.y.alias("y")))))
    h = draft.spaces.select(F.lit("hole"), F.col("space_id"), F.explode(F.transform(F.flatten("holes"), lambda p, i: F.struct(i.alias("part"), p.x.alias("x"), p.y.alias("y")))))
    e = draft.elements.select(F.lit("element"), F.col("element_id"), F.struct(F.col("accepted").cast("int").alias("part"), "x", "y"))
    u = draft.elements.filter("support is not null").select(F.lit("support"), F.col("element_id"), F.explode(F.array(point(0, "support.sx", "support.sy"), point(1, "support.ex", "support.ey"))))
    return w.union(s).union(h).union(e).union(u).select("kind", "id", F.col("p.part").cast("long").alias("part"), r_of("p.x", "x"), r_of("p.y", "y"))


def r_of(c: str, name: str):
    """Rounded, without a negative zero."""
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(name)


#: pt: all points of walls, rooms and holes; the changed walls cw (old ends, new ends); fo: the points that follow.
_POINTS = """, pt as materialized (select 'wall' kind, wall_id id, 0 part, floor_id, sx x, sy y from c_wall union all select 'wall', wall_id, 1, floor_id, ex, ey from c_wall union all select 'space', space_id, i, floor_id, case when i in (0, 3) then x0 else x1 end, case when i < 2 then y0 else y1 end from c_space cross join range(4) t(i)),
 ho as (select 'hole' kind, space_id id, i part, case when i in (0, 3) then hx0 else hx1 end x, case when i < 2 then hy0 else hy1 end y from c_hole cross join range(4) t(i)),
 su as (select 'support' kind, entrance_id id, i part, x+(i-0.5)*width x, y from c_entrance cross join range(2) t(i) where entrance_id % 2 = 0)"""
_FT = "greatest(0, least(1, coalesce(((x-sx)*(ex-sx)+(y-sy)*(ey-sy))/nullif((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy), 0), 0)))"
_FOLLOW = f""", fo as materialized (select kind, id, part, arg_min(nsx+(nex-nsx)*t+x-sx-t*(ex-sx), w_id) nx, arg_min(nsy+(ney-nsy)*t+y-sy-t*(ey-sy), w_id) ny from (select pt.*, cw.wall_id w_id, sx, sy, ex, ey, nsx, nsy, nex, ney, least(0.15, greatest(0.05, thickness/2)) tol, {_FT} t from pt join cw using (floor_id) where not detach and not (kind = 'wall' and id in (select wall_id from cw)))
   where sqrt(power(x-sx-t*(ex-sx), 2)+power(y-sy-t*(ey-sy), 2)) <= tol group by all)"""


@query(_POINTS + """, cw as materialized (select w.*, sx-0.5 nsx, sy-0.75 nsy, ex+0.25 nex, ey-0.25 ney, floor_id % 10 = 3 detach from c_wall w join (select min(wall_id) wall_id from c_wall group by floor_id) using (wall_id))""" + _FOLLOW + f"""
select p.kind, p.id, p.part, round(case when c.wall_id is not null and p.part = 0 then nsx when c.wall_id is not null then nex else coalesce(fo.nx, p.x) end, 6)+0.0 x, round(case when c.wall_id is not null and p.part = 0 then nsy when c.wall_id is not null then ney else coalesce(fo.ny, p.y) end, 6)+0.0 y from pt p left join cw c on p.kind = 'wall' and c.wall_id = p.id left join fo on fo.kind = p.kind and fo.id = p.id and fo.part = p.part
 union all select kind, id, part, round(x, 6), round(y, 6) from ho union all select kind, id, part, round(x, 6), round(y, 6) from su
 union all select 'element', entrance_id, case when entrance_id % 6 <> 0 and not exists (select 1 from cw where cw.floor_id = e.floor_id and {_apart('e.x', 'e.y', 'cw.sx', 'cw.sy', 'cw.ex', 'cw.ey')} <= e.width/2+least(0.15, greatest(0.05, cw.thickness/2))) then 1 else 0 end, round(x, 6), round(y, 6) from c_entrance e""")
def b17_reshaped_walls(c: Campus) -> DataFrame:
    """The first wall of every floor gets new ends (detached on third floors); what touches it follows."""
    w = c.walls().groupBy("plane_id").agg(F.min(F.struct("wall_id", "sx", "sy", "ex", "ey")).alias("w"))
    changes = w.select("plane_id", "w.wall_id", (F.col("w.sx") - 0.5).alias("sx"), (F.col("w.sy") - 0.75).alias("sy"), (F.col("w.ex") + 0.25).alias("ex"), (F.col("w.ey") - 0.25).alias("ey"), (F.col("plane_id") % 10 == 3).alias("detach"))
    return _rows(wall_moves.reshaped(_draft(c), changes))


_DX, _DY = "(floor_id % 3 * 0.5 + 0.25)", "-0.5"


@query(_POINTS + f""", cw as materialized (select *, sx+{_DX} nsx, sy+{_DY} nsy, ex+{_DX} nex, ey+{_DY} ney, false detach from c_wall where wall_id % 5 = 0)""" + _FOLLOW + f"""
select p.kind, p.id, p.part, round(case when p.kind = 'wall' and p.id % 5 = 0 or p.kind = 'space' and p.id % 7 = 0 then p.x+{_DX} else coalesce(fo.nx, p.x) end, 6)+0.0 x, round(case when p.kind = 'wall' and p.id % 5 = 0 or p.kind = 'space' and p.id % 7 = 0 then p.y+{_DY} else coalesce(fo.ny, p.y) end, 6)+0.0 y from pt p left join fo on fo.kind = p.kind and fo.id = p.id and fo.part = p.part
 union all select h.kind, id, part, round(case when id % 7 = 0 then x+{_DX} else x end, 6)+0.0, round(case when id % 7 = 0 then y+{_DY} else y end, 6)+0.0 from ho h join c_space s on s.space_id = h.id
 union all select u.kind, id, part, round(case when id % 3 = 0 then u.x+{_DX} else u.x end, 6)+0.0, round(case when id % 3 = 0 then u.y+{_DY} else u.y end, 6)+0.0 from su u join c_entrance e on e.entrance_id = u.id
 union all select 'element', entrance_id, case when entrance_id % 6 <> 0 then 1 else 0 end, round(case when entrance_id % 3 = 0 then x+{_DX} else x end, 6)+0.0, round(case when entrance_id % 3 = 0 then y+{_DY} else y end, 6)+0.0 from c_entrance""")
def b16_moved_drafts(c: Campus) -> DataFrame:
    """A selection of walls, rooms and doors of every floor is dragged; what touches the walls follows."""
    dx = (F.col("plane_id") % 3 * 0.5 + 0.25).alias("dx")
    pick = lambda df, kind, key, n: df.filter(F.col(key) % n == 0).select("plane_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), dx, F.lit(-0.5).alias("dy"))
    d = _draft(c)
    return _rows(wall_moves.moved(d, pick(d.walls, "wall", "wall_id", 5).union(pick(d.spaces, "space", "space_id", 7)).union(pick(d.elements, "element", "element_id", 3))))
