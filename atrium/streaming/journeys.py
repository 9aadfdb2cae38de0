"""Routes that start, end and are replaced while positions arrive: each position belongs to its user's latest route.

Guidance starts anew with every route, so alerts are kept by route.  A route ends when its user starts the next one, or some
time after its start; then a timer drops its state, so state is bounded by the routes that are under way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from atrium.streaming import guidance

#: How long a route is under way at most.
LASTS = "12 hours"
ALERT = ["key", "user_id", "ts", "ping_id", "plane_id", "x", "y", "kind", "distance"]


def spans(routes: DataFrame, lasts: str = LASTS) -> DataFrame:
    """key, user_id, starts, ends of each route; of routes that start together the one with the largest key counts."""
    w = Window.partitionBy("user_id").orderBy("starts", "key")
    own = routes.select("key", "user_id", "starts").distinct()
    return own.withColumn("ends", F.least(F.col("starts") + F.expr(f"interval {lasts}"), F.lead("starts").over(w))).filter("starts < ends")


def on_route(pings: DataFrame, routes: DataFrame, lasts: str = LASTS) -> DataFrame:
    """Positions (user_id, ts, ping_id, plane_id, x, y, accuracy) with the key and the end of the route they belong to; others are left out.

    A position meets the routes of its user that are under way on its day, so a user with many routes costs no pairs of all
    positions and all routes.
    """
    day = lambda c: F.to_date(c)
    s = spans(routes, lasts).withColumn("day", F.explode(F.sequence(day(F.col("starts")), day(F.col("ends")))))
    return pings.withColumn("day", day(F.col("ts"))).join(s, ["user_id", "day"]).filter("ts >= starts and ts < ends").drop("day", "starts")


def _carried(pings: DataFrame) -> DataFrame:
    """The position goes along with the ping's id."""
    return pings.withColumn("ping_id", F.struct("ping_id", "user_id", F.col("plane_id").alias("plane"), F.col("x").alias("px"), F.col("y").alias("py"), "ends"))


def _bare(df: DataFrame) -> DataFrame:
    for c, name in (("user_id", "user_id"), ("plane", "plane_id"), ("px", "x"), ("py", "y"), ("ends", "ends"), ("ping_id", "ping_id")):
        df = df.withColumn(name, F.col(f"ping_id.{c}"))
    return df


def alerts(pings: DataFrame, routes: DataFrame, lasts: str = LASTS) -> DataFrame:
    """key, user_id, ts, ping_id, plane_id, x, y, kind, distance: the alerts of every route, as a batch.

    ``routes``: key (of one route), user_id, starts, and what guidance needs of it (plane_id, segments, end, optional
    arrival_radius and off_route), a row for each plane.
    """
    return _bare(guidance.alerts(_carried(on_route(pings, routes, lasts)), routes)).select(*ALERT)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    arrived, off, last = state.get if state.exists else (False, False, -(2**62))
    rows = pd.concat(list(frames)).sort_values(["ts", "ping_id"])
    ends = int(rows["ends"].iloc[0].timestamp() * 1000)
    rows = rows[rows["at"] >= last]
    if not arrived and len(rows):
        live = rows[rows["arrives"].cumsum() - rows["arrives"] == 0]
        strays = live["off"] & ~live["off"].shift(fill_value=off)
        said = live[live["arrives"] | strays].copy()
        said["kind"] = said["arrives"].map({True: "route.arrived", False: "route.offRoute"})
        said["distance"] = said["to_route"].where(~said["arrives"])
        arrived, off, last = bool(live["arrives"].iloc[-1]), bool(live["off"].iloc[-1]), int(live["at"].iloc[-1])
        yield said[ALERT]
    state.update((arrived, off, last))
    state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))


def alert_stream(pings: DataFrame, routes: DataFrame, lasts: str = LASTS, late: str = "10 minutes") -> DataFrame:
    """The same alerts from a stream of positions; those that come too late, or older than the last one of their route that was handled, are dropped."""
    m = _bare(guidance.measured(_carried(on_route(pings.withWatermark("ts", late), routes, lasts)), routes)).withColumn("at", F.unix_micros("ts"))
    kinds = dict(m.dtypes) | {"kind": "string", "distance": "double"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ALERT)
    return m.groupBy("key").applyInPandasWithState(_advance, schema, "arrived boolean, off boolean, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def reroutes(found: DataFrame, routes: DataFrame) -> DataFrame:
    """key, user_id, ts, plane_id, x, y, to_id: a request for a new route from where a user has strayed, to where the route led.

    ``routes`` has the end's id as ``to_id``.  The requests are ends of kind position for a search of trips.
    """
    goal = routes.select("key", "to_id").distinct()
    return found.filter("kind = 'route.offRoute'").join(goal, "key").select("key", "user_id", "ts", "ping_id", "plane_id", "x", "y", "to_id")


def reroute_feed(found: DataFrame, routes: DataFrame, answer: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the requests of each micro-batch of a stream of alerts to ``answer``, with the batch's number, which stays the same on a rerun."""
    return found.writeStream.foreachBatch(lambda batch, number: answer(reroutes(batch, routes), number)).option("checkpointLocation", checkpoint).start()
