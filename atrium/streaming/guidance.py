"""Arrival and off-route alerts from positions, as a batch over all pings and as a stateful stream with the same answers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from atrium.functions import geom

#: Metres within which a visitor has arrived, and beyond which one has strayed.
ARRIVAL_RADIUS, OFF_ROUTE = 5.0, 10.0


def measured(pings: DataFrame, routes: DataFrame) -> DataFrame:
    """Pings (key, ts, plane_id, x, y, accuracy) with ``to_end`` (null off the last plane) and ``to_route`` (null on planes not visited).

    ``routes``: key, plane_id, segments (array of ax, ay, bx, by), end (x, y on the last plane, else null), and optional
    arrival_radius and off_route of each route.  Positions that are null are left out.
    """
    reach = [c for c in ("arrival_radius", "off_route") if c in routes.columns]
    known = routes.select("key", *reach).distinct()
    there = routes.select("key", "plane_id", "segments", "end")
    p = pings.filter("x is not null and y is not null and plane_id is not null").join(known, "key").join(there, ["key", "plane_id"], "left")
    near = F.array_min(F.transform("segments", lambda s: geom.distance_to_segment(F.col("x"), F.col("y"), s.ax, s.ay, s.bx, s.by)))
    end = geom.distance(F.col("x"), F.col("y"), F.col("end.x"), F.col("end.y"))
    acc = F.greatest(F.lit(0.0), F.coalesce("accuracy", F.lit(0.0)))
    radius = F.coalesce("arrival_radius", F.lit(ARRIVAL_RADIUS)) if "arrival_radius" in reach else F.lit(ARRIVAL_RADIUS)
    limit = F.coalesce("off_route", F.lit(OFF_ROUTE)) if "off_route" in reach else F.lit(OFF_ROUTE)
    out = p.withColumn("to_route", near).withColumn("arrives", F.coalesce(end <= radius + acc, F.lit(False)))
    return out.withColumn("off", F.coalesce(F.col("to_route") > limit + acc, F.lit(True))).select("key", "ts", "ping_id", "to_route", "arrives", "off")


def alerts(pings: DataFrame, routes: DataFrame) -> DataFrame:
    """key, ts, ping_id, kind, distance: the first arrival of each route, and the start of each excursion before it."""
    m = measured(pings, routes)
    w = Window.partitionBy("key").orderBy("ts", "ping_id")
    done = F.max(F.col("arrives").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = m.withColumn("done", F.coalesce(done, F.lit(0))).filter("done = 0").withColumn("was", F.coalesce(F.lag("off").over(w), F.lit(False)))
    kind = F.when(F.col("arrives"), "route.arrived").when(F.col("off") & ~F.col("was"), "route.offRoute")
    return live.withColumn("kind", kind).filter("kind is not null").select("key", "ts", "ping_id", "kind", F.when(F.col("kind") == "route.offRoute", F.col("to_route")).alias("distance"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    arrived, off, last = state.get if state.exists else (False, False, None)
    out: list[tuple[Any, ...]] = []
    rows = pd.concat(list(frames)).sort_values(["ts", "ping_id"])
    for row in rows.itertuples():
        stamp = row.ts.isoformat()
        if arrived or last is not None and stamp < last:
            continue
        last = stamp
        if row.arrives:
            arrived = True
            out.append((key[0], row.ts, row.ping_id, "route.arrived", None))
        else:
            if row.off and not off:
                out.append((key[0], row.ts, row.ping_id, "route.offRoute", row.to_route))
            off = bool(row.off)
    state.update((arrived, off, last))
    yield pd.DataFrame(out, columns=["key", "ts", "ping_id", "kind", "distance"])


def alert_stream(pings: DataFrame, routes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same alerts from a stream; pings older than the last one handled of their route are dropped."""
    m = measured(pings.withWatermark("ts", late), routes)
    kind = m.schema["key"].dataType.simpleString()
    ident = m.schema["ping_id"].dataType.simpleString()
    return m.groupBy("key").applyInPandasWithState(_advance, f"key {kind}, ts timestamp, ping_id {ident}, kind string, distance double", "arrived boolean, off boolean, last string", "append", GroupStateTimeout.NoTimeout)
