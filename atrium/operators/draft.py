"""Cleaning of stroke tables (plan_id, stroke_id, orientation, offset_px, start_px, end_px, thickness_px), a plan being the key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from atrium.operators.components import cell, components
from atrium.operators.routing import written


def length(start: str = "start_px", end: str = "end_px") -> Column:
    """Pixel ranges include both ends."""
    return F.col(end) - F.col(start) + 1


def dominant_thickness(strokes: DataFrame) -> DataFrame:
    """plan_id, dominant: going from the thickest stroke down, the thickness at which 30 % of all length is reached.

    Lengths are summed for each thickness first, so the window has one row for each thickness of a plan.
    """
    each = strokes.groupBy("plan_id", "thickness_px").agg(F.sum(length()).alias("n"))
    down = Window.partitionBy("plan_id").orderBy(F.desc("thickness_px"))
    run = each.withColumn("run", F.sum("n").over(down)).withColumn("total", F.sum("n").over(Window.partitionBy("plan_id")))
    return run.filter("run >= total * 0.3").groupBy("plan_id").agg(F.max("thickness_px").alias("dominant"))


def split(strokes: DataFrame, least: float, auto: bool = True) -> DataFrame:
    """Strokes with ``part``: wall or thin; blobs and strokes thinner than ``least`` are left out."""
    good = strokes.filter((F.col("thickness_px") >= least) & (length() >= F.col("thickness_px") * 2))
    if not auto:
        return good.withColumn("part", F.lit("wall"))
    out = good.join(dominant_thickness(good), "plan_id")
    heavy = F.col("dominant") >= max(4.0, least * 2)
    return out.withColumn("part", F.when(heavy & (F.col("thickness_px") < F.col("dominant") * 0.5), "thin").otherwise("wall")).drop("dominant")


def without_fringes(strokes: DataFrame, gap: float, band: float = 8.0, piece: float = 64.0) -> DataFrame:
    """Strokes that do not run beside a longer one covering them.

    Two keys make it an equi join.  A stroke stands in one band of offsets and, by its start, in one piece of the axis.  A
    possible cover stands in all bands that it can reach, given its own thickness and the thickest stroke of its plan, and in all
    pieces in which what it covers can start.  So a thick stroke widens the search of its own plan only.
    """
    keys = ["plan_id", "orientation"]
    widest = strokes.groupBy(*keys).agg(F.max("thickness_px").alias("widest"))
    cores = strokes.join(widest, keys).withColumn("reach", (F.col("thickness_px") + F.col("widest")) / 2 + gap + 1)
    span = lambda a, b, size: F.sequence(F.floor(a / size), F.floor(b / size))
    cores = cores.withColumn("band", F.explode(span(F.col("offset_px") - F.col("reach"), F.col("offset_px") + F.col("reach"), band)))
    cores = cores.withColumn("piece", F.explode(span(F.col("start_px") - gap, F.col("end_px") + gap, piece)))
    cores = cores.select(*keys, "band", "piece", F.col("stroke_id").alias("c_id"), F.col("offset_px").alias("c_off"), F.col("start_px").alias("c_start"), F.col("end_px").alias("c_end"), F.col("thickness_px").alias("c_thick"))
    s = strokes.withColumn("band", F.floor(F.col("offset_px") / band)).withColumn("piece", F.floor(F.col("start_px") / piece))
    covers = (
        (s["plan_id"] == cores["plan_id"]) & (s["orientation"] == cores["orientation"]) & (s["band"] == cores["band"]) & (s["piece"] == cores["piece"]) & (F.col("c_id") != F.col("stroke_id"))
        & (length("c_start", "c_end") > length()) & (F.col("c_start") <= F.col("start_px") + gap) & (F.col("c_end") >= F.col("end_px") - gap)
        & (F.abs(F.col("c_off") - F.col("offset_px")) <= (F.col("c_thick") + F.col("thickness_px")) / 2 + gap + 1)
    )
    return s.join(cores, covers, "left_anti").drop("band", "piece")


def fused(strokes: DataFrame, gap: float) -> DataFrame:
    """Strokes of equal offset that overlap or nearly touch become one: extent, number, greatest thickness."""
    w = Window.partitionBy("plan_id", "orientation", "offset_px").orderBy("start_px", "end_px", "stroke_id")
    before = F.max("end_px").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = strokes.withColumn("_new", F.when(F.col("start_px") <= before + gap + 1, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w)).drop("_new")
    return rows.groupBy("plan_id", "orientation", "offset_px", "_island").agg(F.min("start_px").alias("start_px"), F.max("end_px").alias("end_px"), F.max("thickness_px").alias("thickness_px"), F.count(F.lit(1)).alias("strokes")).drop("_island")


def united(strokes: DataFrame, gap: float, least_reach: float = 1.5, piece: float = 64.0) -> DataFrame:
    """Strokes of one line become one (plan_id, orientation, offset_px, start_px, end_px, thickness_px, strokes): extent, greatest thickness, offset weighted by length.

    Two strokes are of one line if their offsets differ by no more than ``least_reach`` or half the thicker one's thickness, and they overlap or are
    at most ``gap`` apart; lines are what such pairs connect.  Strokes meet in bands of offsets as wide as the largest reach of their plan, and in the
    pieces of the axis that both touch.
    """
    keys = ["plan_id", "orientation"]
    widest = strokes.groupBy(*keys).agg(F.greatest(F.lit(least_reach), F.max("thickness_px") / 2).alias("widest"))
    s = strokes.join(widest, keys).withColumn("band", F.floor(F.col("offset_px") / F.col("widest"))).withColumn("piece", F.explode(F.sequence(F.floor((F.col("start_px") - gap) / piece), F.floor((F.col("end_px") + gap) / piece))))
    other = s.select(*keys, "piece", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("stroke_id").alias("o_id"), F.col("offset_px").alias("o_at"), F.col("start_px").alias("o0"), F.col("end_px").alias("o1"), F.col("thickness_px").alias("o_thick"))
    near = F.abs(F.col("offset_px") - F.col("o_at")) <= F.greatest(F.lit(least_reach), F.greatest("thickness_px", "o_thick") / 2)
    pair = s.join(other, [*keys, "band", "piece"]).filter((F.col("stroke_id") < F.col("o_id")) & near & (F.col("start_px") <= F.col("o1") + gap) & (F.col("end_px") >= F.col("o0") - gap))
    name = lambda c: F.struct("plan_id", F.col(c).alias("stroke_id"))
    lies = F.col("orientation") == "horizontal"
    where = cell(F.struct("plan_id", "orientation"), F.when(lies, F.col("start_px")).otherwise(F.col("offset_px")), F.when(lies, F.col("offset_px")).otherwise(F.col("start_px")))
    at = F.struct(where[0].alias("square"), where[1].alias("cell")).alias("at")
    lines = components(strokes.select(name("stroke_id").alias("node"), at), pair.select(name("stroke_id").alias("a"), name("o_id").alias("b"), at))
    marked = strokes.join(lines.select("node.plan_id", "node.stroke_id", F.col("component.stroke_id").alias("line")), ["plan_id", "stroke_id"])
    middle = F.sum(F.col("offset_px") * length()) / F.sum(length())
    return marked.groupBy(*keys, "line").agg(middle.alias("offset_px"), F.min("start_px").alias("start_px"), F.max("end_px").alias("end_px"), F.max("thickness_px").alias("thickness_px"), F.count(F.lit(1)).alias("strokes")).drop("line")


def median_thickness(walls: DataFrame, least: float = 0.06, most: float = 0.6, few: int = 3) -> DataFrame:
    """plan_id, median, odd_scale: the upper median thickness of plans with ``few`` walls or more, and whether it lies outside the range."""
    w = Window.partitionBy("plan_id")
    ranked = walls.withColumn("k", F.row_number().over(w.orderBy("thickness", "wall_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    mid = ranked.filter((F.col("n") >= few) & (F.col("k") == F.floor(F.col("n") / 2) + 1))
    return mid.select("plan_id", F.col("thickness").alias("median"), ~F.col("thickness").between(least, most)).toDF("plan_id", "median", "odd_scale")


def _shared_lengths(schema, wide: float, most_gap: float, least_gap: float, least_overlap: float, columns: int = 4096):
    """What adds up, for the lines of one band (``wide``), the shared lengths with lines ``least_gap`` to ``most_gap`` beyond; strokes stand on a grid of eighths, so sums are exact.

    Two strokes share ``least_overlap`` or more if they still meet when both are cut short by it at their ends, and what they then share is less by
    just that.  So counts of strokes at the places of a line are all that is needed, and pairs of lines are products of matrices.
    """
    import numpy as np
    import pyarrow as pa

    def merged(parts):
        """One (offset and place, number) of each offset and place."""
        at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, which = np.unique(at, return_inverse=True)
        return at, np.bincount(which, n, len(at))

    def add(key, batches):
        band, at, last, rows = key[2].as_py(), [], [], 0
        for batch in batches:
            o, a, b = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("offset_px", "start_px", "end_px"))
            at.append((o + 1j * a, np.ones(len(o))))
            last.append((o + 1j * (b - least_overlap + 1), np.ones(len(o))))
            rows += len(o)
            if rows > 500000:  # equal places are merged as they come
                at, last, rows = [merged(at)], [merged(last)], 0
        (starts, s_n), (ends, e_n) = merged(at), merged(last)
        lines = np.unique(starts.real)
        places = np.unique(np.concatenate([starts.imag, ends.imag]))
        own = np.flatnonzero(np.floor(lines / wide) == band)
        s_line, s_at = np.searchsorted(lines, starts.real), np.searchsorted(places, starts.imag)
        e_line, e_at = np.searchsorted(lines, ends.real), np.searchsorted(places, ends.imag)
        total, here = np.zeros((len(own), len(lines))), np.zeros(len(lines))
        for low in range(0, len(places), columns):  # bounded in memory
            x = places[low : low + columns]
            begun, ended = np.zeros((len(lines), len(x))), np.zeros((len(lines), len(x)))
            for into, line, place, n in ((begun, s_line, s_at, s_n), (ended, e_line, e_at, e_n)):
                seen = (place >= low) & (place < low + columns)
                into[line[seen], place[seen] - low] = n[seen]
            beyond = here[:, None] + np.cumsum(begun - ended, axis=1)  # alive between a place and the next one
            alive = beyond + ended
            width = np.diff(places[low : low + columns + 1], append=places[-1])[: len(x)]
            total += (beyond[own] * width) @ beyond.T + least_overlap * (begun[own] @ alive.T + (alive - begun)[own] @ begun.T)
            here = beyond[:, -1]
        distance = lines[None, :] - lines[own][:, None]
        met = (distance >= least_gap) & (distance <= most_gap) & (total > 0)
        gap, which = np.unique(np.floor(distance[met] + 0.5), return_inverse=True)
        n = np.bincount(which, total[met])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(gap), schema.field(0).type), pa.array(gap.astype("int64")), pa.array(n)], schema=schema)

    stream = Iterator[pa.RecordBatch]
    add.__annotations__ = {"key": tuple, "batches": stream, "return": stream}  # by which Spark knows the form that reads batch by batch
    return add


def _met_lengths(strokes: DataFrame, most_gap: float, least_overlap: float, least_gap: float, piece: float) -> DataFrame:
    """plan_id, gap, n: the same sums from pairs of strokes, in bands of ``most_gap`` and in the first piece of the axis that both touch; equal strokes meet once, with their number."""
    keys = ["plan_id", "orientation"]
    equal = strokes.groupBy(*keys, "offset_px", "start_px", "end_px").agg(F.count(F.lit(1)).cast("double").alias("times"))
    equal = equal.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start_px") / piece), F.floor((F.col("end_px") + 1) / piece))))
    own = equal.select(*keys, "piece", F.floor(F.col("offset_px") / most_gap).alias("band"), F.col("offset_px").alias("a"), F.col("start_px").alias("a0"), F.col("end_px").alias("a1"), F.col("times").alias("a_times"))
    other = equal.select(*keys, "piece", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.floor(F.col("offset_px") / most_gap) - i)).alias("band"), F.col("offset_px").alias("b"), F.col("start_px").alias("b0"), F.col("end_px").alias("b1"), F.col("times").alias("b_times"))
    pair = own.join(other, [*keys, "band", "piece"]).filter(F.col("piece") == F.floor(F.greatest("a0", "b0") / piece))
    pair = pair.withColumn("distance", F.col("b") - F.col("a")).withColumn("overlap", F.least("a1", "b1") - F.greatest("a0", "b0") + 1)
    pair = pair.filter(F.col("distance").between(least_gap, most_gap) & (F.col("overlap") >= least_overlap)).withColumn("overlap", F.col("overlap") * F.col("a_times") * F.col("b_times"))
    return pair.groupBy("plan_id", F.floor(F.col("distance") + 0.5).alias("gap")).agg(F.sum("overlap").alias("n"))


def face_gaps(strokes: DataFrame, most_gap: float, least_overlap: float, least_gap: float = 3.0, share: float = 0.08, piece: float = 64.0) -> DataFrame:
    """plan_id, gap, weight: the commonest distance of strokes that run side by side, weighted by how long they do.

    Weights are smoothed over neighbouring whole gaps; ties go to the smaller gap.  A plan in which no gap weighs ``share`` of
    all its stroke length has no row.  Where strokes stand on a grid of eighths, lines of strokes meet as counts, in bands of offsets; other
    plans meet stroke by stroke.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    places = ("offset_px", "start_px", "end_px")
    even = lambda c: (F.abs(c) < 2.0**40) & (c * 8 == F.floor(c * 8))
    whole = [even(F.col(k)) for k in places]
    apart = strokes.groupBy("plan_id").agg(F.bool_and(F.coalesce(whole[0] & whole[1] & whole[2], F.lit(True))).alias("even")).filter("not even").select("plan_id")
    gridded = all(float(x) * 8 == int(x * 8) for x in (most_gap, least_gap, least_overlap)) and least_overlap > 0
    apart = written(apart if gridded else strokes.select("plan_id").distinct())
    known = strokes.filter(F.col("offset_px").isNotNull() & F.col("start_px").isNotNull() & (length() >= least_overlap) & F.col("orientation").isNotNull() & F.col("plan_id").isNotNull())
    wide = 4.0 * most_gap
    lined = known.join(apart, "plan_id", "left_anti").select("plan_id", "orientation", F.explode(F.sequence(F.floor((F.col("offset_px") - most_gap) / wide), F.floor(F.col("offset_px") / wide))).alias("band"), *[F.col(k).cast("double").alias(k) for k in places])
    schema = T.StructType([T.StructField("plan_id", strokes.schema["plan_id"].dataType), T.StructField("gap", T.LongType()), T.StructField("n", T.DoubleType())])
    bins = lined.groupBy("plan_id", "orientation", "band").applyInArrow(_shared_lengths(to_arrow_schema(schema), wide, float(most_gap), float(least_gap), float(least_overlap)), schema)
    if not apart.isEmpty():
        bins = bins.unionByName(_met_lengths(strokes.join(apart, "plan_id", "left_semi"), most_gap, least_overlap, least_gap, piece))
    bins = bins.groupBy("plan_id", "gap").agg(F.sum("n").alias("n"))
    near = Window.partitionBy("plan_id").orderBy("gap").rangeBetween(-1, 1)
    best = bins.withColumn("weight", F.sum("n").over(near)).groupBy("plan_id").agg(F.max(F.struct("weight", (-F.col("gap")).alias("down"))).alias("b"))
    total = strokes.groupBy("plan_id").agg(F.sum(length()).alias("total"))
    found = best.join(total, "plan_id").filter(F.col("b.weight") >= F.col("total") * share)
    return found.select("plan_id", (-F.col("b.down")).alias("gap"), F.col("b.weight").alias("weight"))
