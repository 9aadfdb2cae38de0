"""Walls of a draft plan as a planar graph: splitting and snapping strokes, pruning, straight chains, faces and rooms.

Strokes: plan_id, stroke_id, orientation, offset_px, start_px, end_px, thickness_px.  A graph is a table of edges (plan_id, edge_id, a, b,
ax, ay, bx, by, thickness_px), where a and b name nodes within the plan: (x, y) of the first point of the node.  A plan
is part of every key and never a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.operators.components import cell, components, cycles
from atrium.operators.routing import written

#: Two edges at a node go straight on if the cosine of their directions is below this.
STRAIGHT = -0.995


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def split_at_crossings(strokes: DataFrame, reach: float = 3.0, square: float = 64.0) -> DataFrame:
    """Pieces (plan_id, stroke_id, x0, y0, x1, y1, thickness_px) of strokes between their ends and the strokes across that they come within ``reach`` of.

    A stroke stands in the squares along it; one across it stands with it in the square of their crossing alone.
    """
    across, along = F.floor(F.col("offset_px") / square), F.explode(_cells(F.col("start_px") - reach, F.col("end_px") + reach, square))
    flat, upright = (strokes.filter(F.col("orientation") == o) for o in ("horizontal", "vertical"))
    h = flat.select("plan_id", along.alias("cx"), across.alias("cy"), F.col("stroke_id").alias("h"), F.col("offset_px").alias("y"), F.col("start_px").alias("h0"), F.col("end_px").alias("h1"))
    v = upright.select("plan_id", across.alias("cx"), along.alias("cy"), F.col("stroke_id").alias("v"), F.col("offset_px").alias("x"), F.col("start_px").alias("v0"), F.col("end_px").alias("v1"))
    near = lambda at, low, high: F.col(at).between(F.col(low) - reach, F.col(high) + reach)
    met = h.join(v, ["plan_id", "cx", "cy"]).filter(near("x", "h0", "h1") & near("y", "v0", "v1"))
    clamped = lambda at, low, high: F.greatest(low, F.least(high, at))
    cuts = met.select("plan_id", F.inline(F.array(F.struct(F.col("h").alias("stroke_id"), clamped("x", "h0", "h1").alias("at")), F.struct(F.col("v").alias("stroke_id"), clamped("y", "v0", "v1").alias("at")))))
    ends = strokes.select("plan_id", "stroke_id", F.explode(F.array("start_px", "end_px")).alias("at"))
    breaks = cuts.union(ends).distinct()
    w = Window.partitionBy("plan_id", "stroke_id").orderBy("at")
    pieces = breaks.withColumn("to", F.lead("at").over(w)).filter("to is not null").join(strokes.select("plan_id", "stroke_id", "orientation", "offset_px", "thickness_px"), ["plan_id", "stroke_id"])
    lies = F.col("orientation") == "horizontal"
    x = lambda at: F.when(lies, F.col(at)).otherwise(F.col("offset_px"))
    y = lambda at: F.when(lies, F.col("offset_px")).otherwise(F.col(at))
    return pieces.select("plan_id", "stroke_id", x("at").alias("x0"), y("at").alias("y0"), x("to").alias("x1"), y("to").alias("y1"), "thickness_px")


def snapped(points: DataFrame, reach: float = 3.0) -> DataFrame:
    """plan_id, x, y, node (x, y of its smallest point), nx, ny of points (plan_id, x, y, n: how often it occurs).

    Points that a chain of steps of at most ``reach`` joins are one node, in the middle of them by their numbers.
    """
    square = max(reach, 1e-9)
    keyed = points.withColumn("cx", F.floor(F.col("x") / square)).withColumn("cy", F.floor(F.col("y") / square))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = keyed.select("plan_id", F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", F.explode(offsets).alias("o")).select("plan_id", "ox", "oy", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    near = keyed.join(around, ["plan_id", "cx", "cy"]).filter((dx * dx + dy * dy <= reach * reach) & ((F.col("x") < F.col("ox")) | ((F.col("x") == F.col("ox")) & (F.col("y") < F.col("oy")))))
    name = lambda x, y: F.struct("plan_id", F.col(x).alias("x"), F.col(y).alias("y"))
    labels = components(points.select(name("x", "y").alias("node")), near.select(name("x", "y").alias("a"), name("ox", "oy").alias("b")), lambda k: cell(k.plan_id, k.x, k.y))
    placed = points.join(labels.select("node.plan_id", "node.x", "node.y", F.struct("component.x", "component.y").alias("node")), ["plan_id", "x", "y"])
    middle = placed.groupBy("plan_id", "node").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("nx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("ny"))
    return placed.join(middle, ["plan_id", "node"]).select("plan_id", "x", "y", "node", "nx", "ny")


def planar_graph(strokes: DataFrame, reach: float = 3.0) -> DataFrame:
    """The edges of strokes split at their crossings, with near ends snapped together; of edges between the same nodes the first stroke's stays (horizontal ones first)."""
    pieces = written(split_at_crossings(strokes, reach).join(strokes.select("plan_id", "stroke_id", "orientation"), ["plan_id", "stroke_id"]))
    ends = pieces.select("plan_id", F.inline(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))))
    nodes = written(snapped(ends.groupBy("plan_id", "x", "y").agg(F.count(F.lit(1)).alias("n")), reach))
    at = lambda i, k: nodes.select("plan_id", F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.struct(F.col("node").alias("node"), F.col("nx").alias("x"), F.col("ny").alias("y")).alias(k))
    ended = pieces.join(at(0, "p"), ["plan_id", "x0", "y0"]).join(at(1, "q"), ["plan_id", "x1", "y1"]).filter("p.node <> q.node")
    first, second = F.least("p", "q"), F.greatest("p", "q")
    rows = ended.select("plan_id", first.alias("p"), second.alias("q"), F.struct("orientation", "stroke_id", "x0", "y0", "thickness_px").alias("own"))
    rows = rows.groupBy("plan_id", "p", "q").agg(F.min("own").alias("own"))
    cols = [F.col(f"{e}.node").alias(n) for e, n in (("p", "a"), ("q", "b"))] + [F.col(f"{e}.{c}").alias(f"{n}{c}") for e, n in (("p", "a"), ("q", "b")) for c in ("x", "y")]
    return rows.select("plan_id", F.struct(F.col("p.node").alias("a"), F.col("q.node").alias("b")).alias("edge_id"), *cols, F.col("own.thickness_px").alias("thickness_px"))


def _length() -> Column:
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return F.sqrt(dx * dx + dy * dy)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("plan_id", "edge_id", F.explode(F.array("a", "b")).alias("node"))


def without_stubs(edges: DataFrame, stub: float) -> DataFrame:
    """Edges without dangling ones that are no longer than ``stub`` or than they are thick, again and again; an edge that hangs on nothing at both ends stays."""
    left = written(edges)
    while True:
        ends = _ends(left)
        leaf = ends.groupBy("plan_id", "node").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("edge_id")).filter("n = 1")
        hanging = leaf.groupBy("plan_id", "edge_id").agg(F.count(F.lit(1)).alias("loose")).filter("loose = 1")
        short = left.filter(_length() <= F.greatest(F.lit(float(stub)), F.col("thickness_px")))
        gone = written(short.join(hanging, ["plan_id", "edge_id"], "left_semi").select("plan_id", "edge_id"))
        if gone.isEmpty():
            return left
        left = written(left.join(gone, ["plan_id", "edge_id"], "left_anti"))


def pruned(edges: DataFrame, stub: float, least: float, share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(edges that stay, edges of dropped pieces): no stubs, and no connected piece shorter than ``least`` or than ``share`` of its plan's longest."""
    left = without_stubs(edges, stub)
    name = lambda k: F.struct("plan_id", F.col(k).alias("node"))
    labels = components(_ends(left).select(name("node").alias("node")), left.select(name("a").alias("a"), name("b").alias("b")), lambda k: cell(k.plan_id, k.node.x, k.node.y))
    marked = written(left.join(labels.select("node.plan_id", F.col("node.node").alias("a"), F.col("component.node").alias("piece")), ["plan_id", "a"]))
    sizes = marked.groupBy("plan_id", "piece").agg(F.sum(_length()).alias("size"))
    longest = sizes.groupBy("plan_id").agg(F.max("size").alias("longest"))
    kept = sizes.join(longest, "plan_id").filter(F.col("size") >= F.greatest(F.lit(float(least)), F.col("longest") * share)).select("plan_id", "piece")
    return tuple(marked.join(kept, ["plan_id", "piece"], how).select(*edges.columns) for how in ("left_semi", "left_anti"))


def straight_walls(edges: DataFrame) -> DataFrame:
    """plan_id, a, b, ax, ay, bx, by, thickness_px (by length), edges: edges that go straight on through a node as one wall.

    Two edges go on if each is the other's only one in that direction (about 6 degrees).
    """
    out = lambda here, there, x0, y0, x1, y1: F.struct(F.col(here).alias("node"), ((F.col(x1) - F.col(x0)) / _length()).alias("dx"), ((F.col(y1) - F.col(y0)) / _length()).alias("dy"))
    darts = edges.select("plan_id", "edge_id", F.inline(F.array(out("a", "b", "ax", "ay", "bx", "by"), out("b", "a", "bx", "by", "ax", "ay"))))
    other = darts.select("plan_id", "node", F.col("edge_id").alias("o_id"), F.col("dx").alias("ox"), F.col("dy").alias("oy"))
    pair = darts.join(other, ["plan_id", "node"]).filter((F.col("edge_id") != F.col("o_id")) & (F.col("dx") * F.col("ox") + F.col("dy") * F.col("oy") < STRAIGHT))
    only = pair.groupBy("plan_id", "node", "edge_id").agg(F.count(F.lit(1)).alias("n"), F.min("o_id").alias("o_id")).filter("n = 1").drop("n")
    back = only.select("plan_id", "node", F.col("o_id").alias("edge_id"), F.col("edge_id").alias("o_id"))
    links = written(only.join(back, ["plan_id", "node", "edge_id", "o_id"], "left_semi"))
    name = lambda k: F.struct("plan_id", F.col(k).alias("edge_id"))
    labels = components(edges.select(name("edge_id").alias("node")), links.select(name("edge_id").alias("a"), name("o_id").alias("b")), lambda k: cell(k.plan_id, k.edge_id.a.x, k.edge_id.a.y))
    marked = written(edges.join(labels.select("node.plan_id", "node.edge_id", F.col("component.edge_id").alias("wall")), ["plan_id", "edge_id"]))
    walls = marked.groupBy("plan_id", "wall").agg((F.sum(F.col("thickness_px") * _length()) / F.sum(_length())).alias("thickness_px"), F.count(F.lit(1)).alias("edges"))
    tip = lambda n, x, y: F.struct(F.col(n).alias("node"), F.col(x).alias("x"), F.col(y).alias("y"))
    tips = marked.select("plan_id", "wall", F.explode(F.array(tip("a", "ax", "ay"), tip("b", "bx", "by"))).alias("tip"))
    tips = tips.groupBy("plan_id", "wall", "tip").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")  # inner nodes of a wall occur twice
    tips = tips.groupBy("plan_id", "wall").agg(F.min("tip").alias("p"), F.max("tip").alias("q"))
    return walls.join(tips, ["plan_id", "wall"]).select("plan_id", F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"), "thickness_px", "edges")


def faces(edges: DataFrame) -> DataFrame:
    """plan_id, face, place, size, node, x, y, step: the corners of every face of the graph in walking order, the outer one included.

    A dart is an edge walked one way.  The next dart leaves its end by the neighbour that follows in the order of angles (ties by node),
    so darts are a permutation whose cycles are the faces.  A dangling edge is walked both ways within its face and adds no area.
    ``step`` is what the dart adds to twice the area; inner faces are negative, the outer one of a connected piece is positive.
    """
    dart = lambda u, v, x0, y0, x1, y1: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(x0).alias("x"), F.col(y0).alias("y"), F.col(x1).alias("to_x"), F.col(y1).alias("to_y"))
    darts = written(edges.select("plan_id", F.inline(F.array(dart("a", "b", "ax", "ay", "bx", "by"), dart("b", "a", "bx", "by", "ax", "ay")))).dropDuplicates(["plan_id", "u", "v"]))
    around = Window.partitionBy("plan_id", "u").orderBy(F.atan2(F.col("to_y") - F.col("y"), F.col("to_x") - F.col("x")), "v")
    every = Window.partitionBy("plan_id", "u").orderBy(F.atan2(F.col("to_y") - F.col("y"), F.col("to_x") - F.col("x")), "v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = darts.select("plan_id", F.col("u").alias("at"), F.col("v").alias("came_from"), F.coalesce(F.lead("v").over(around), F.first("v").over(every)).alias("goes_to"))
    name = lambda u, v: F.struct("plan_id", F.col(u).alias("u"), F.col(v).alias("v"))
    ring = cycles(turns.select(name("came_from", "at").alias("item"), name("at", "goes_to").alias("next")), lambda k: cell(k.plan_id, k.u.x, k.u.y))
    ring = ring.select("item.plan_id", "item.u", "item.v", F.struct("cycle.u", "cycle.v").alias("face"), "place", "size")
    step = F.col("x") * F.col("to_y") - F.col("to_x") * F.col("y")
    return ring.join(darts, ["plan_id", "u", "v"]).select("plan_id", "face", "place", "size", F.col("u").alias("node"), "x", "y", step.alias("step"))


def rooms(corners: DataFrame, least_area: float) -> DataFrame:
    """The corners of the faces without the largest one of each plan (of equal ones a positive one) and those smaller than ``least_area``, with area."""
    areas = corners.groupBy("plan_id", "face", "size").agg((F.sum("step") / 2).alias("signed")).filter("size >= 3")
    rank = Window.partitionBy("plan_id").orderBy(F.desc(F.round(F.abs("signed"), 6)), F.desc("signed"), "face")
    inner = areas.withColumn("_k", F.row_number().over(rank)).filter((F.col("_k") > 1) & (F.abs("signed") >= least_area))
    return corners.drop("size", "step").join(inner.select("plan_id", "face", F.abs("signed").alias("area")), ["plan_id", "face"])
