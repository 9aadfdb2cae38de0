"""Scores of recognised plans against truth: lengths of walls, floor areas on a raster, rooms found, points matched.

Every table has plan_id; predictions and truth meet in cells of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from atrium.functions import geom
from atrium.operators import spatial
from atrium.operators.routing import written

#: Cells along one side of a tile.
TILE = 256


def _length() -> Column:
    return geom.distance(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))


def covered_length(walls: DataFrame, reference: DataFrame, tolerance: float = 0.2, every: float = 0.1) -> DataFrame:
    """plan_id, metres, covered: the length of ``walls`` (plan_id, wall_id, sx, sy, ex, ey) and how much of it runs within ``tolerance`` of a reference wall.

    A wall is sampled in equal pieces of ``every`` metres at most, each judged at its middle.
    """
    w = walls.withColumn("metres", _length())
    piece = w.filter("metres > 0").withColumn("n", F.greatest(F.ceil(F.col("metres") / every), F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = (F.col("i") + 0.5) / F.col("n")
    piece = piece.select("plan_id", "wall_id", "i", (F.col("metres") / F.col("n")).alias("own"), (F.col("sx") + (F.col("ex") - F.col("sx")) * t).alias("x"), (F.col("sy") + (F.col("ey") - F.col("sy")) * t).alias("y"))
    box = F.struct(F.least("sx", "ex").alias("x0"), F.least("sy", "ey").alias("y0"), F.greatest("sx", "ex").alias("x1"), F.greatest("sy", "ey").alias("y1"))
    ref = spatial.with_cells(reference.select("plan_id", "sx", "sy", "ex", "ey"), box, tolerance)
    near = geom.distance_to_segment(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")) <= tolerance
    p, q = spatial.at_cell(piece).alias("p"), ref.alias("q")
    at = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in ("plan_id", "cx", "cy")]
    hit = p.join(q, at[0] & at[1] & at[2] & near, "left_semi").groupBy("plan_id").agg(F.sum("own").alias("covered"))
    return w.groupBy("plan_id").agg(F.sum("metres").alias("metres")).join(hit, "plan_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def wall_score(predicted: DataFrame, truth: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """plan_id, precision, recall of wall lengths; null where there is no length to divide by."""
    p = covered_length(predicted, truth, tolerance).toDF("plan_id", "p_metres", "p_covered")
    t = covered_length(truth, predicted, tolerance).toDF("plan_id", "t_metres", "t_covered")
    return p.join(t, "plan_id", "full").select("plan_id", F.try_divide("p_covered", "p_metres").alias("precision"), F.try_divide("t_covered", "t_metres").alias("recall"))


def _tiled(spaces: DataFrame, origin: DataFrame, side: int) -> DataFrame:
    """The spaces of one side, once for each tile that their box touches: their rings (outline first) and the range of their cells."""
    s = spaces.filter(F.size("polygon") >= 3).withColumn("b", geom.box(F.col("polygon"))).join(origin, "plan_id")
    at = lambda v, o: F.floor((F.col(v) - F.col(o)) / F.col("cell"))
    s = s.withColumn("span", F.struct(at("b.x0", "ox").alias("x0"), at("b.y0", "oy").alias("y0"), at("b.x1", "ox").alias("x1"), at("b.y1", "oy").alias("y1")))
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / TILE), F.floor(F.col(hi) / TILE)))
    s = s.withColumn("tx", tiles("span.x0", "span.x1")).withColumn("ty", tiles("span.y0", "span.y1"))
    rings = F.concat(F.array("polygon"), F.filter("holes", lambda h: F.size(h) >= 3))
    return s.select("plan_id", "tx", "ty", F.lit(side).alias("side"), "ord", "space_id", rings.alias("rings"), "span.*", "ox", "oy", "cell")


def shared_cells(predicted: DataFrame, truth: DataFrame, origin: DataFrame, tile_rows: int = 50_000) -> DataFrame:
    """plan_id, p, t, n: on how many cells of a plan which predicted space meets which true one; null where no space is.

    A cell belongs to the last space in order (``ord``, then id) that covers its middle.  ``origin``: plan_id, ox, oy, cell (metres).  A plan is cut
    into tiles of ``TILE`` cells a side; a task paints one tile at a time, space by space in order, so it holds no more than that tile's
    cells and the ids of its spaces.
    """
    spark = predicted.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(predicted.count() + truth.count()) // tile_rows))
    tile = ["plan_id", "tx", "ty"]
    both = _tiled(predicted, origin, 0).union(_tiled(truth, origin, 1)).repartition(n, *tile).sortWithinPartitions(*tile, "side", "ord", "space_id")
    kinds = [predicted.schema["plan_id"].dataType, predicted.schema["space_id"].dataType, truth.schema["space_id"].dataType, T.LongType()]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(("plan_id", "p", "t", "n"), kinds, strict=True)])
    size = TILE

    def inside(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
        """Rows y by columns x (ascending): which points a ring of edges p, q holds, as ``geom.inside`` tells it."""
        edge, row = ((py[:, None] > y) != (qy[:, None] > y)).nonzero()
        at = (qx - px)[edge] * (y[row] - py[edge]) / (qy - py)[edge] + px[edge]
        known = at == at  # a corner without a coordinate crosses nothing
        ends = row[known] * (len(x) + 1) + x.searchsorted(at[known])  # the columns before it are left of the edge
        crossed = np.bincount(ends, minlength=len(y) * (len(x) + 1)).reshape(len(y), -1)
        return (crossed[:, :0:-1].cumsum(1)[:, ::-1] & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        canvas, ids, now = np.zeros((2, size, size), "int32"), ([None], [None]), None
        out: list[tuple] = []

        def done() -> None:
            seen = canvas[:, (canvas[0] | canvas[1]) != 0].astype("int64")
            keys, counts = np.unique(seen[0] * len(ids[1]) + seen[1], return_counts=True)
            out.extend((now[0], ids[0][k // len(ids[1])], ids[1][k % len(ids[1])], c) for k, c in zip(keys.tolist(), counts.tolist(), strict=True))

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], names=["plan_id", "p", "t", "n"])
            out.clear()
            return batch

        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if arrow is None:
                arrow = [col["plan_id"].type, col["space_id"].type, col["space_id"].type, pa.int64()]
            rings = col["rings"]
            first, corners = rings.offsets.to_numpy(), rings.values
            start, points = corners.offsets.to_numpy(), corners.values
            px, py = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            after = np.arange(1, len(px) + 1)
            some = start[1:] > start[:-1]
            after[start[1:][some] - 1] = start[:-1][some]  # a ring's last corner goes to its first
            qx, qy = px[after], py[after]
            names = ("plan_id", "tx", "ty", "side", "space_id", "x0", "y0", "x1", "y1", "ox", "oy", "cell")
            for i, (plan, tx, ty, side, space, x0, y0, x1, y1, ox, oy, cell) in enumerate(zip(*(col[c].to_pylist() for c in names), strict=True)):
                if now != (plan, tx, ty):
                    if now is not None:
                        done()
                    now, ids = (plan, tx, ty), ([None], [None])
                    canvas[:] = 0
                left, top = tx * size, ty * size
                a, b, c, d = max(x0 - left, 0), min(x1 - left, size - 1) + 1, max(y0 - top, 0), min(y1 - top, size - 1) + 1
                x, y = ox + (np.arange(left + a, left + b) + 0.5) * cell, oy + (np.arange(top + c, top + d) + 0.5) * cell
                held = None
                for k in range(first[i], first[i + 1]):
                    of = slice(start[k], start[k + 1])
                    own = inside(x, y, px[of], py[of], qx[of], qy[of])
                    held = own if held is None else held & ~own
                ids[side].append(space)
                canvas[side, c:d, a:b][held] = len(ids[side]) - 1
            if out:
                yield rows()
        if now is not None:
            done()
        if out:
            yield rows()

    return both.mapInArrow(run, schema).groupBy("plan_id", "p", "t").agg(F.sum("n").alias("n"))


def origins(predicted: DataFrame, truth: DataFrame, cell: float = 0.1, most: int | None = 4_000_000) -> DataFrame:
    """plan_id, ox, oy, cell: the corner of all that is drawn in a plan, and a cell that doubles until ``most`` cells hold it (None: it never does)."""
    b = predicted.select("plan_id", "polygon").union(truth.select("plan_id", "polygon")).select("plan_id", geom.box(F.col("polygon")).alias("b"))
    box = b.groupBy("plan_id").agg(F.min("b.x0").alias("ox"), F.min("b.y0").alias("oy"), F.max("b.x1").alias("mx"), F.max("b.y1").alias("my"))
    if most is None:
        return box.select("plan_id", "ox", "oy", F.lit(float(cell)).alias("cell"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(F.lit(2.0), k) * cell)
    fits = F.filter(sizes, lambda c: F.ceil((F.col("mx") - F.col("ox")) / c + 1) * F.ceil((F.col("my") - F.col("oy")) / c + 1) <= most)
    return box.select("plan_id", "ox", "oy", F.get(fits, F.lit(0)).alias("cell"))


def floor_score(predicted: DataFrame, truth: DataFrame, cell: float = 0.1, room_iou: float = 0.5, most: int | None = 4_000_000) -> DataFrame:
    """plan_id, precision, recall, iou, predicted_area, truth_area and rooms found (a truth room that one predicted room overlaps by ``room_iou``)."""
    origin = written(origins(predicted, truth, cell, most))
    pairs = written(shared_cells(predicted, truth, origin))
    own = lambda side: F.sum(F.when(F.col(side).isNotNull(), F.col("n")))
    both = F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), F.col("n")))
    total = pairs.groupBy("plan_id").agg(own("p").alias("np"), own("t").alias("nt"), F.coalesce(both, F.lit(0)).alias("nb"), F.sum("n").alias("nu"))
    cells = lambda side: F.sum("n").over(Window.partitionBy("plan_id", side))
    rated = pairs.withColumn("tn", cells("t")).withColumn("pn", cells("p")).filter("p is not null and t is not null")
    rooms = rated.filter(F.col("n") / (F.col("tn") + F.col("pn") - F.col("n")) >= room_iou).groupBy("plan_id").agg(F.countDistinct("t").alias("rooms"))
    area = F.col("cell") * F.col("cell")
    out = total.join(origin, "plan_id").join(rooms, "plan_id", "left")
    return out.select("plan_id", F.try_divide("nb", "np").alias("precision"), F.try_divide("nb", "nt").alias("recall"), F.try_divide("nb", "nu").alias("iou"), (F.coalesce("np", F.lit(0)) * area).alias("predicted_area"), (F.coalesce("nt", F.lit(0)) * area).alias("truth_area"), F.coalesce("rooms", F.lit(0)).alias("rooms"))


def matched_points(predicted: DataFrame, truth: DataFrame, reach: float) -> DataFrame:
    """plan_id, truth_id, point_id, distance: going through the truth in order (``ord``), each takes the nearest prediction within ``reach`` that is still free.

    Rounds replace the walk: in each, a truth item whose nearest free prediction is wanted by no earlier one that is still open takes it.
    The earliest open item of each plan is always served, and rounds end when nothing is left to take.
    """
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    p = predicted.select("plan_id", "point_id", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("i", step).withColumn("j", step)
    p = p.select("plan_id", "point_id", "px", "py", (F.floor(F.col("px") / reach) + F.col("i")).alias("cx"), (F.floor(F.col("py") / reach) + F.col("j")).alias("cy"))
    near = spatial.at_cell(truth.select("plan_id", "truth_id", "ord", "x", "y"), reach).join(p, ["plan_id", "cx", "cy"]).withColumn("distance", geom.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
    open_pairs = written(near.filter(F.col("distance") <= reach).select("plan_id", "truth_id", "ord", "point_id", "distance"))
    found = None
    while not open_pairs.isEmpty():
        first = F.min(F.struct("ord", "truth_id")).over(Window.partitionBy("plan_id", "point_id"))
        best = F.min(F.struct("distance", "point_id")).over(Window.partitionBy("plan_id", "truth_id"))
        free = open_pairs.withColumn("first", first).withColumn("best", best)
        taken = written(free.filter((F.col("best.point_id") == F.col("point_id")) & (F.col("first.truth_id") == F.col("truth_id"))).select("plan_id", "truth_id", "point_id", "distance"))
        found = taken if found is None else found.union(taken)
        open_pairs = written(open_pairs.join(taken.select("plan_id", "truth_id"), ["plan_id", "truth_id"], "left_anti").join(taken.select("plan_id", "point_id"), ["plan_id", "point_id"], "left_anti"))
    return found if found is not None else open_pairs.select("plan_id", "truth_id", "point_id", "distance")
