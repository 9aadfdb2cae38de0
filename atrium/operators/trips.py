"""Polylines of trips: arc lengths, places along them, densifying, and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.functions import geom

#: Points closer than this to the one before are the same point.
SAME = 1e-6
#: Fixed values of the timeline: seconds are shortened, bounded, and walked at this speed.
SHORTEN, SHORTEST, LONGEST, USUAL, PACE = 8.0, 1.5, 4.0, 2.5, 1.3


def legs(steps: DataFrame) -> DataFrame:
    """Steps (route_id, ord, plane_id, x, y) with ``leg_no``: it grows where the plane changes."""
    w = Window.partitionBy("route_id").orderBy("ord")
    changed = F.when(F.col("plane_id") == F.lag("plane_id").over(w), 0).otherwise(1)
    return steps.withColumn("_new", changed).withColumn("leg_no", F.sum("_new").over(w)).drop("_new")


def arc_lengths(points: DataFrame) -> DataFrame:
    """Points (path_id, ord, x, y) without repeats, with ``along``: metres from the path's start."""
    w = Window.partitionBy("path_id").orderBy("ord")
    gap = lambda: geom.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    kept = points.withColumn("_gap", gap()).filter(F.col("_gap").isNull() | (F.col("_gap") > SAME))
    return kept.withColumn("_gap", F.coalesce(gap(), F.lit(0.0))).withColumn("along", F.sum("_gap").over(w)).drop("_gap")


def segments(measured: DataFrame) -> DataFrame:
    """path_id, d0, d1, ax, ay, bx, by from measured points."""
    w = Window.partitionBy("path_id").orderBy("ord")
    nxt = lambda c: F.lead(c).over(w)
    return measured.select("path_id", F.col("along").alias("d0"), nxt("along").alias("d1"), F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by")).filter("d1 is not null")


def places_along(measured: DataFrame, asked: DataFrame) -> DataFrame:
    """ask_id, x, y, dx, dy: the point and direction at ``metres`` along path_id, clamped to the path."""
    s = segments(measured)
    ends = s.groupBy("path_id").agg(F.max("d1").alias("total"))
    a = asked.join(ends, "path_id").withColumn("d", F.greatest(F.lit(0.0), F.least("metres", "total")))
    hit = a.join(s, "path_id").filter("d >= d0 and (d < d1 or (d1 = total and d = total))")
    t = (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    length = F.col("d1") - F.col("d0")
    return hit.select("ask_id", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"), ((F.col("bx") - F.col("ax")) / length).alias("dx"), ((F.col("by") - F.col("ay")) / length).alias("dy"))


def densified(measured: DataFrame, step: float) -> DataFrame:
    """Points at most ``step`` apart: path_id, d, x, y (the first point of each segment's parts, and the path's end)."""
    own = geom.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))  # a difference of sums is off by their rounding
    s = segments(measured).withColumn("n", F.greatest(F.lit(1), F.ceil(own / step).cast("int")))
    cut = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("t", F.col("i") / F.col("n"))
    rows = cut.select("path_id", (F.col("d0") + F.col("t") * (F.col("d1") - F.col("d0"))).alias("d"), (F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).alias("y"))
    return measured.filter("along = 0").select("path_id", F.col("along").alias("d"), "x", "y").union(rows)


def timeline(parts: DataFrame) -> DataFrame:
    """Parts of a trip (trip_id, ord, kind: walk or change, metres, seconds) with start and length in playback seconds and metres walked before."""
    w = Window.partitionBy("trip_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    pause = F.least(F.lit(LONGEST), F.greatest(F.lit(SHORTEST), F.coalesce(F.col("seconds") / SHORTEN, F.lit(USUAL))))
    lasts = F.when(F.col("kind") == "walk", F.col("metres") / PACE).otherwise(pause)
    walked = F.when(F.col("kind") == "walk", F.col("metres")).otherwise(0.0)
    out = parts.withColumn("lasts", lasts).withColumn("_walked", walked)
    return out.withColumn("starts", F.coalesce(F.sum("lasts").over(w), F.lit(0.0))).withColumn("walked_before", F.coalesce(F.sum("_walked").over(w), F.lit(0.0))).drop("_walked")
