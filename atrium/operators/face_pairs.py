"""Walls drawn as two lines: pairs of parallel strokes, closest first, each stretch of a stroke used once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.operators.routing import written

KEY = ["plan_id", "stroke_id"]
_SPANS = "array<struct<s:double,e:double>>"


def _without(start: Column, end: Column, taken: Column) -> Column:
    """The pieces of an inclusive range of pixels outside all ``taken`` ones."""
    span = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))
    none = F.array().cast(_SPANS)

    def cut(pieces: Column, t: Column) -> Column:
        rest = lambda p: F.concat(F.when(t.s > p.s, span(p.s, t.s - 1)).otherwise(none), F.when(t.e < p.e, span(t.e + 1, p.e)).otherwise(none))
        return F.flatten(F.transform(pieces, lambda p: F.when((t.e < p.s) | (t.s > p.e), F.array(p).cast(_SPANS)).otherwise(rest(p))))

    return F.aggregate(taken, span(start, end).cast(_SPANS), cut)


def candidates(strokes: DataFrame, gaps: DataFrame, least_overlap: float) -> DataFrame:
    """plan_id, a, b (a < b), rank, low, high: pairs of strokes that may be the faces of one wall, given each plan's usual ``gap``.

    Strokes meet in bands as wide as the largest distance of their plan, so a pair is at most one band apart.
    """
    s = strokes.join(gaps.select("plan_id", "gap"), "plan_id").withColumn("least_gap", F.greatest(F.lit(3.0), F.col("gap") * 0.3)).withColumn("most_gap", F.col("gap") * 2.2)
    band = F.floor(F.col("offset_px") / F.col("most_gap"))
    own = s.select("plan_id", "orientation", band.alias("band"), "least_gap", "most_gap", F.col("stroke_id").alias("i"), F.col("offset_px").alias("o"), F.col("start_px").alias("s0"), F.col("end_px").alias("e0"))
    other = s.select("plan_id", "orientation", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("stroke_id").alias("j"), F.col("offset_px").alias("p"), F.col("start_px").alias("s1"), F.col("end_px").alias("e1"))
    pair = own.join(other, ["plan_id", "orientation", "band"]).filter("i < j").withColumn("distance", F.abs(F.col("o") - F.col("p")))
    pair = pair.filter(F.col("distance").between(F.col("least_gap"), F.col("most_gap"))).withColumn("low", F.greatest("s0", "s1")).withColumn("high", F.least("e0", "e1"))
    pair = pair.filter(F.col("high") - F.col("low") + 1 >= F.greatest(F.lit(float(least_overlap)), F.col("distance") * 1.5))
    rank = F.struct("distance", (F.col("low") - F.col("high")).alias("shorter"), F.col("i"), F.col("j"))
    return pair.select("plan_id", F.col("i").alias("a"), F.col("j").alias("b"), rank.alias("rank"), "low", "high")


def paired(strokes: DataFrame, gaps: DataFrame, least_overlap: float) -> tuple[DataFrame, DataFrame]:
    """(walls, unpaired): walls in the middle of two faces (plan_id, orientation, offset_px, start_px, end_px, thickness_px, a, b), and the stretches of strokes left over.

    Pairs are taken in the order of distance, then of shared length, then of ids, and get what is left of their shared stretch on both
    strokes.  A round takes all pairs that come first on both of their strokes: pairs only compete on a stroke they
    share, so this gives what one walk through the whole order gives.
    """
    open_pairs = written(candidates(strokes, gaps, least_overlap))
    faces = written(strokes.select(*KEY, "orientation", "offset_px", "thickness_px", "start_px", "end_px"))
    used, walls = None, None
    none = F.array().cast(_SPANS)
    while not open_pairs.isEmpty():
        first = open_pairs.select("plan_id", F.explode(F.array("a", "b")).alias("stroke_id"), "rank").groupBy(*KEY).agg(F.min("rank").alias("first"))
        side = lambda end: first.select("plan_id", F.col("stroke_id").alias(end), F.col("first").alias(f"first_{end}"))  # noqa: B023, E731
        ready = written(open_pairs.join(side("a"), ["plan_id", "a"]).join(side("b"), ["plan_id", "b"]).filter("rank = first_a and rank = first_b").drop("first_a", "first_b"))
        got = ready.withColumn("taken", none)
        if used is not None:
            spans = used.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # the pieces of one stroke
            of = lambda end: spans.select("plan_id", F.col("stroke_id").alias(end), F.col("spans").alias(f"spans_{end}"))  # noqa: B023, E731
            got = ready.join(of("a"), ["plan_id", "a"], "left").join(of("b"), ["plan_id", "b"], "left").withColumn("taken", F.concat(F.coalesce("spans_a", none), F.coalesce("spans_b", none)))
        pieces = got.withColumn("piece", F.explode(_without(F.col("low"), F.col("high"), F.col("taken")))).select("plan_id", "a", "b", "rank.distance", "piece.s", "piece.e")
        pieces = written(pieces.filter(F.col("e") - F.col("s") + 1 >= F.greatest(F.lit(float(least_overlap)), F.col("distance") * 1.5)))
        walls = pieces if walls is None else walls.union(pieces)
        new = pieces.select("plan_id", F.explode(F.array("a", "b")).alias("stroke_id"), "s", "e")
        used = new if used is None else used.union(new)
        open_pairs = written(open_pairs.join(ready.select("plan_id", "a", "b"), ["plan_id", "a", "b"], "left_anti"))
    left = faces.withColumn("spans", none)
    if used is not None:
        left = faces.join(used.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans")), KEY, "left").withColumn("spans", F.coalesce("spans", none))
    left = left.withColumn("piece", F.explode(_without(F.col("start_px"), F.col("end_px"), F.col("spans")))).filter(F.col("piece.e") - F.col("piece.s") + 1 >= least_overlap)
    left = left.select(*KEY, "orientation", "offset_px", F.col("piece.s").alias("start_px"), F.col("piece.e").alias("end_px"), "thickness_px")
    if walls is None:
        return faces.select("plan_id", "orientation", "offset_px", "start_px", "end_px", "thickness_px", F.col("stroke_id").alias("a"), F.col("stroke_id").alias("b")).limit(0), left
    face = lambda end: faces.select("plan_id", F.col("stroke_id").alias(end), F.col("offset_px").alias(f"off_{end}"), F.col("thickness_px").alias(f"thick_{end}"), *(["orientation"] if end == "a" else []))
    done = walls.join(face("a"), ["plan_id", "a"]).join(face("b"), ["plan_id", "b"])
    done = done.select("plan_id", "orientation", ((F.col("off_a") + F.col("off_b")) / 2).alias("offset_px"), F.col("s").alias("start_px"), F.col("e").alias("end_px"), (F.col("distance") + (F.col("thick_a") + F.col("thick_b")) / 2).alias("thickness_px"), "a", "b")
    return done, left
