"""Queries of route ends, of all trips between them, and of why some have no route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import endpoints, floor_links, graph, trip_routes
from atrium.plans.graph import GRAPH, _nodes, edges, places
from atrium.plans.registry import query
from atrium.sources.campus import Campus

r = lambda c: F.round(c, 6)

_ALONG = "greatest(0, least(1, ((e.x-g.sx)*(g.ex-g.sx)+(e.y-g.sy)*(g.ey-g.sy))/((g.ex-g.sx)*(g.ex-g.sx)+(g.ey-g.sy)*(g.ey-g.sy))))"
#: an: the nodes from which each end can be walked to (end_id, node_id, d).
ANCHORS = f""", nos as materialized (select distinct space_id, node_id from (select *, case when x >= x0 and x <= x1 and y >= y0 and y <= y1 then least(x-x0, x1-x, y-y0, y1-y) else sqrt(power(greatest(x0-x, 0, x-x1), 2) + power(greatest(y0-y, 0, y-y1), 2)) end outer_d,
   case when hx0 is null then 1e9 when x >= hx0 and x <= hx1 and y >= hy0 and y <= hy1 then least(x-hx0, hx1-x, y-hy0, hy1-y) else sqrt(power(greatest(hx0-x, 0, x-hx1), 2) + power(greatest(hy0-y, 0, y-hy1), 2)) end hole_d
   from (select s.space_id, n.node_id, n.x, n.y, s.x0, s.y0, s.x1, s.y1, h.hx0, h.hy0, h.hx1, h.hy1 from c_nav_node n join c_space s on s.floor_id = n.floor_id left join c_hole h on h.space_id = s.space_id where n.x >= s.x0 - 1 and n.x <= s.x1 + 1 and n.y >= s.y0 - 1 and n.y <= s.y1 + 1))
   where outer_d <= 0.5 or hole_d <= 0.5 or (x >= x0 and x < x1 and y >= y0 and y < y1 and not (hx0 is not null and x >= hx0 and x < hx1 and y >= hy0 and y < hy1))),
 sp0 as materialized (select e.end_id, p.floor_id, p.x, p.y, p.space_id stated from c_end e join c_place p on p.poi_id = e.ref_id where kind = 'poi' union all select end_id, floor_id, x, y, null from c_end where kind = 'position'
   union all select e.end_id, s.floor_id, (s.x0+s.x1)/2, (s.y0+s.y1)/2, -1 from c_end e join c_space s on s.space_id = e.ref_id where kind = 'space' and s.space_id not in (select space_id from nos)),
 inn as (select p.end_id, s.space_id, row_number() over (partition by p.end_id order by s.ord, s.space_id) k from sp0 p join c_space s on s.floor_id = p.floor_id and p.x >= s.x0 and p.x < s.x1 and p.y >= s.y0 and p.y < s.y1
   left join c_hole h on h.space_id = s.space_id and p.x >= h.hx0 and p.x < h.hx1 and p.y >= h.hy0 and p.y < h.hy1 where h.space_id is null),
 sp1 as materialized (select p.*, coalesce(case when p.stated > 0 then p.stated end, i.space_id) home from sp0 p left join inn i on i.end_id = p.end_id and i.k = 1),
 wk as materialized (select p.end_id, n.node_id, p.floor_id, p.home, n.x ax, n.y ay, p.x bx, p.y by_, sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)) d from sp1 p join c_nav_node n using (floor_id)),
 seg as (select floor_id, wall_id, cast(null as bigint) hole_of, sx, sy, ex, ey from c_wall union all select s.floor_id, null, h.space_id, unnest([hx0, hx1, hx1, hx0]), unnest([hy0, hy0, hy1, hy1]), unnest([hx1, hx1, hx0, hx0]), unnest([hy0, hy1, hy1, hy0]) from c_hole h join c_space s using (space_id)),
 cx as (select w.*, l.wall_id, l.sx, l.sy, l.ex, l.ey, (bx-ax)*(l.ey-l.sy) - (by_-ay)*(l.ex-l.sx) k from wk w join seg l on l.floor_id = w.floor_id and (l.hole_of is null or l.hole_of = w.home)),
 ct as (select *, ((sx-ax)*(ey-sy) - (sy-ay)*(ex-sx))/nullif(k, 0) t, ((sx-ax)*(by_-ay) - (sy-ay)*(bx-ax))/nullif(k, 0) u from cx where abs(k) > 1e-12),
 ch as (select *, ax+t*(bx-ax) hx, ay+t*(by_-ay) hy from ct where t between 0 and 1 and u between 0 and 1),
 g as (select * from ch where sqrt((hx-ax)*(hx-ax)+(hy-ay)*(hy-ay)) > 0.05 and sqrt((hx-bx)*(hx-bx)+(hy-by_)*(hy-by_)) > 0.05),
 bl as materialized (select distinct end_id, node_id from g where wall_id is null or not exists (select 1 from c_entrance e where e.floor_id = g.floor_id and e.type <> 'window' and sqrt((e.x-hx)*(e.x-hx)+(e.y-hy)*(e.y-hy)) <= e.width/2+0.05
   and (e.wall_id = g.wall_id or (case when g.ex = g.sx and g.ey = g.sy then sqrt((e.x-g.sx)*(e.x-g.sx)+(e.y-g.sy)*(e.y-g.sy)) else sqrt(power(e.x - g.sx - {_ALONG}*(g.ex-g.sx), 2) + power(e.y - g.sy - {_ALONG}*(g.ey-g.sy), 2)) end) < 0.3))),
 cl as materialized (select w.*, exists (select 1 from nos where nos.space_id = w.home and nos.node_id = w.node_id) own from wk w anti join bl using (end_id, node_id)),
 an as materialized (select end_id, ref_id node_id, 0.0::double d from c_end where kind = 'node' and ref_id in (select node_id from c_nav_node union all select node_id from c_site_node)
   union all select e.end_id, nos.node_id, 0 from c_end e join nos on nos.space_id = e.ref_id where e.kind = 'space'
   union all select end_id, node_id, d from cl where own
   union all select end_id, node_id, d from (select *, row_number() over (partition by end_id order by d, node_id) k from cl where end_id not in (select end_id from cl where own)) where k = 1)"""

#: The best cost of every (start end, node), for trips that need no steps and for all others.
TRIPS = GRAPH + ANCHORS + """, tr as materialized (select query_id, from_poi from_id, to_poi to_id, require_accessible acc from c_trip),
 ad as materialized (select src, dst, min(w) w, acc from (select from_id src, to_id dst, coalesce(duration, distance/1.2) w, accessible from ge union all select to_id, from_id, coalesce(duration, distance/1.2), accessible from ge) z join (values (true), (false)) o(acc) on z.accessible or not o.acc group by src, dst, acc),
 di(s, n, acc, w) using key (s, n, acc) as (select an.end_id, an.node_id, o.acc, min(an.d/1.2) from an join (select distinct from_id, acc from tr) o on o.from_id = an.end_id group by all
   union select di.s, ad.dst, di.acc, min(di.w + ad.w) from di join ad on ad.src = di.n and ad.acc = di.acc left join recurring.di old on old.s = di.s and old.n = ad.dst and old.acc = di.acc where old.w is null or di.w + ad.w < old.w - 1e-12 group by di.s, ad.dst, di.acc),
 rt as (select t.query_id, min(di.w + an.d/1.2) w from tr t join di on di.s = t.from_id and di.acc = t.acc join an on an.end_id = t.to_id and an.node_id = di.n group by 1)"""


def _ends(c: Campus) -> DataFrame:
    nodes = c.nodes().select("node_id", "plane_id", "x", "y").unionByName(c.site_nodes().select("node_id", (-F.col("project_id") - 1).alias("plane_id"), "x", "y"))
    places = c.view("c_place").withColumnRenamed("floor_id", "plane_id")
    return endpoints.resolved(c.view("c_end").withColumnRenamed("floor_id", "plane_id"), places, c.spaces(), nodes, c.walls(), c.entrances())


@query(ANCHORS + " select end_id, node_id, round(d, 6) distance from an")
def n13_route_ends(c: Campus) -> DataFrame:
    """The nodes of each end of a route: a node, a room, a free position, or a place with or without a stated room."""
    return _ends(c).select("end_id", "node_id", r(F.col("distance")).alias("distance"))


def _trips(c: Campus) -> DataFrame:
    return c.view("c_trip").select("query_id", F.col("from_poi").alias("from_id"), F.col("to_poi").alias("to_id"), "require_accessible")


def _routed(c: Campus) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(trips, ends, routes under each trip's own options, routes without options)."""
    trips, ends = _trips(c), trip_routes.written(_ends(c))
    adjacent, planes = trip_routes.written(graph.adjacency(edges(c), _nodes(c))), places(c).withColumnRenamed("node", "node_id")
    free = trip_routes.PlaneWays(adjacent, planes, ends).trips(trips, ends, ends)
    strict = trip_routes.PlaneWays(graph.passable(adjacent, require_accessible=True), planes, ends).trips(trips.filter("require_accessible"), ends, ends)
    free = trip_routes.written(free)
    return trips, ends, strict.unionByName(free.join(trips.filter("not require_accessible").select("query_id"), "query_id", "left_semi")), free


@query(TRIPS + " select query_id, round(w, 6) weight from rt")
def n14_trip_routes(c: Campus) -> DataFrame:
    """The cost of the fastest route of every trip, under its own options."""
    return _routed(c)[2].select("query_id", r(F.col("weight")).alias("weight"))


@query(TRIPS + """, tf as (select query_id, from_id, to_id from tr where acc and query_id not in (select query_id from rt)),
 df(s, n, w) using key (s, n) as (select an.end_id, an.node_id, min(an.d/1.2) from an where an.end_id in (select from_id from tf) group by all
   union select df.s, ad.dst, min(df.w + ad.w) from df join ad on ad.src = df.n and not ad.acc left join recurring.df old on old.s = df.s and old.n = ad.dst where old.w is null or df.w + ad.w < old.w - 1e-12 group by df.s, ad.dst),
 rx as (select distinct query_id from tf join df on df.s = tf.from_id join an on an.end_id = tf.to_id and an.node_id = df.n)
select query_id, case when from_id not in (select end_id from an) then 'start-unreachable' when to_id not in (select end_id from an) then 'end-unreachable' when query_id in (select query_id from rx) then 'blocked-by-options' else 'disconnected' end reason from tr where query_id not in (select query_id from rt)""")
def n17_why_no_route(c: Campus) -> DataFrame:
    """Why each trip without a route has none."""
    trips, ends, own, free = _routed(c)
    return trip_routes.reasons(trips, ends, ends, own, free)


#: li: the cross-floor edges with their group; gr: the groups with what becomes of them.
LINKS = """, pn as materialized (select n.node_id, n.floor_id, n.x, n.y, f.building_id b, f.level, f.elevation from c_nav_node n join c_floor f using (floor_id)),
 li as materialized (select l.*, a.b, (b.elevation > a.elevation or (b.elevation = a.elevation and b.level > a.level)) up from c_link l join pn a on a.node_id = l.from_id join pn b on b.node_id = l.to_id where a.b = b.b and a.floor_id <> b.floor_id),
 le as materialized (select type, from_id u, to_id v from li union select type, to_id, from_id from li),
 lr as (select type, u n, u r from le union select lr.type, lr.n, le.v from lr join le on le.type = lr.type and le.u = lr.r),
 lg as materialized (select type, n node_id, min(r) grp from lr group by all),
 gf as (select b, li.type, grp, bool_and(accessible) acc, count(*) edges, count(*) filter (one_way) ow, count(*) filter (up) up from li join lg on lg.type = li.type and lg.node_id = li.from_id group by all),
 gn as (select lg.type, grp, count(*) nodes, count(distinct pn.floor_id) planes from lg join pn using (node_id) group by all),
 gr as materialized (select *, case when planes < nodes then 'multiple-nodes-on-floor' when ow > 0 and not (type = 'escalator' and ow = edges and (up = 0 or up = edges)) then 'one-way-ambiguous' end reason from gf join gn using (type, grp))"""


def _planned(c: Campus) -> tuple[dict[str, DataFrame], DataFrame]:
    links = c.view("c_link").withColumnRenamed("floor_id", "plane_id")
    return floor_links.planned(links, c.nodes(), c.floors()), links


@query(LINKS + """ select b building_id, type, grp "group", case type when 'walk' then 'ramp' else type end became, acc and type <> 'stairs' accessible, case when ow > 0 then case when up > 0 then 'up' else 'down' end end direction, edges, reason from gr where reason is null
 union all select b, type, grp, null, null, null, nodes, reason from gr where reason is not null""")
def n18_floor_links(c: Campus) -> DataFrame:
    """What each group of edges between floors becomes, or why it stays."""
    plan, _ = _planned(c)
    skipped = plan["skipped"].select("building_id", "type", "group", F.lit(None).cast("string").alias("became"), F.lit(None).cast("boolean").alias("accessible"), F.lit(None).cast("string").alias("direction"), F.col("nodes").alias("edges"), "reason")
    return plan["connectors"].select("building_id", "type", "group", F.col("kind").alias("became"), "accessible", "direction", "edges", F.lit(None).cast("string").alias("reason")).unionByName(skipped)


@query(LINKS + """, sh as (select space_id, floor_id, ord, x0, y0, x1, y1 from c_space where space_id % 6 = 1)
select 'edge' kind, edge_id id, null::bigint node_id, null::bigint space_id from c_link where edge_id not in (select li.edge_id from li join lg on lg.type = li.type and lg.node_id = li.from_id join gr on gr.type = lg.type and gr.grp = lg.grp where reason is null)
 union all select 'stop', 'link-' || lg.type || '-' || lg.grp, lg.node_id, (select arg_min(space_id, (ord, space_id)) from sh where sh.floor_id = pn.floor_id and pn.x >= x0 and pn.x < x1 and pn.y >= y0 and pn.y < y1) from lg join gr using (type, grp) join pn using (node_id) where reason is null""")
def b6_links_converted(c: Campus) -> DataFrame:
    """The edges that stay and the stops of the new connectors; every sixth room is a staircase here."""
    plan, links = _planned(c)
    shafts = c.spaces().withColumn("type", F.when(F.col("space_id") % 6 == 1, "stairs").otherwise("room")).withColumn("holes", F.slice("holes", 1, 0))
    stay, stops = floor_links.applied(plan, links, c.nodes(), shafts)
    left = stay.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("long").alias("space_id"))
    return left.union(stops.select(F.lit("stop"), "connector_id", "node_id", "space_id"))
