"""Queries of routes that are replaced while positions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.plans.registry import query
from atrium.sources.campus import Campus
from atrium.streaming import journeys

LASTS = "3 days"

#: sp: a user's routes, each from a seventh of the positions on; al: the alerts of each route.
JOURNEYS = """, rt as (select user_id, event_id rid, ts starts, lead(ts) over (partition by user_id order by ts, event_id) nxt, case when event_id % 2 = 0 then 2 else 6 end rad from c_ping where event_id % 7 = 0),
 sp as (select *, least(starts + interval 3 days, coalesce(nxt, starts + interval 3 days)) ends from rt),
 m as (select s.user_id, rid, p.event_id, p.ts, p.floor_id, x, y, accuracy, rad, sqrt((x-50)*(x-50)+(y-12)*(y-12)) e,
   case when x between 5 and 50 then abs(y-2) when x < 5 then sqrt((x-5)*(x-5)+(y-2)*(y-2)) else sqrt((x-50)*(x-50)+(y-2)*(y-2)) end d1,
   case when y between 2 and 12 then abs(x-50) when y < 2 then sqrt((x-50)*(x-50)+(y-2)*(y-2)) else sqrt((x-50)*(x-50)+(y-12)*(y-12)) end d2 from c_ping p join sp s on p.user_id = s.user_id and p.ts >= starts and p.ts < ends),
 f as (select *, e <= rad + accuracy arrives, least(d1, d2) > 4 + accuracy off from m),
 g as (select *, coalesce(max(case when arrives then 1 else 0 end) over (partition by rid order by ts, event_id rows between unbounded preceding and 1 preceding), 0) done, coalesce(lag(off) over (partition by rid order by ts, event_id), false) was from f),
 al as (select * from g where done = 0 and (arrives or (off and not was)))"""


def _given(c: Campus) -> tuple[DataFrame, DataFrame]:
    p = c.pings().select("user_id", F.col("event_id").alias("ping_id"), "ts", "plane_id", "x", "y", "accuracy")
    seg = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("ax", "ay", "bx", "by"), strict=True)])
    floors = c.floors().select("plane_id")
    start = p.filter("ping_id % 7 = 0").select(F.col("ping_id").alias("key"), "user_id", F.col("ts").alias("starts"), F.when(F.col("ping_id") % 2 == 0, 2.0).otherwise(6.0).alias("arrival_radius"), (F.col("ping_id") % 500).alias("to_id"), (F.col("user_id") % 25).alias("building_id"))
    way = start.join(floors.withColumn("building_id", F.floor(F.col("plane_id") / 10)), "building_id").drop("building_id")
    end = F.struct(F.lit(50.0).alias("x"), F.lit(12.0).alias("y"))
    return p, way.select("*", F.array(seg(5, 2, 50, 2), seg(50, 2, 50, 12)).alias("segments"), end.alias("end"), F.lit(4.0).alias("off_route"))


@query(JOURNEYS + " select rid as key, user_id, event_id ping_id, case when arrives then 'route.arrived' else 'route.offRoute' end kind, case when not arrives then round(least(d1, d2), 6) end distance from al")
def t5_journey_alerts(c: Campus) -> DataFrame:
    """Alerts of every user's routes; each new route starts guidance anew."""
    return journeys.alerts(*_given(c), LASTS).select("key", "user_id", "ping_id", "kind", F.round("distance", 6).alias("distance"))


@query(JOURNEYS + " select rid as key, user_id, event_id ping_id, floor_id plane_id, round(x, 6) x, round(y, 6) y, rid % 500 to_id from al where not arrives")
def t8_reroute_requests(c: Campus) -> DataFrame:
    """Where each user that strays would start anew, and where to."""
    p, routes = _given(c)
    out = journeys.reroutes(journeys.alerts(p, routes, LASTS), routes)
    return out.select("key", "user_id", "ping_id", "plane_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "to_id")
