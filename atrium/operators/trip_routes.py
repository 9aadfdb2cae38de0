"""Fastest routes of any number of trips over planes that few nodes join.

A path that leaves a plane does so at a gate: a node with an edge to another plane.  So a route is the way from the start to a gate of its
plane, the way between two gates, and the way from a gate to the end; or it stays on its plane.  Ways within a plane are
searched from its gates alone (there and back), ways between gates over a graph of gates alone, and only trips within one plane need a
search of their own from each distinct start.  Trips then join three small tables, so a million trips cost joins and no search.
All ways are exact: every fastest path is a chain of such parts.

Where nodes have coordinates, blocks of a bounded number of nodes (``routing.blocks``) are the planes, so a way within one is found in a single
pass over its block, and a search of a trip's own sees one block only, and of that no more than lies nearer than its ends.  They are smaller than
those of other searches: of many trips few stay in one, and each of these costs a search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.operators import routing
from atrium.operators.graph import WALKING_SPEED
from atrium.operators.routing import searches, searches_by_block, why_none, written

COST = ("weight", "metres", "seconds")
#: About how many nodes a block of trips has at most.
BLOCK = 4096


def blocks(places: DataFrame) -> DataFrame:
    return routing.blocks(places, BLOCK)


def _cost(*parts: str) -> Column:
    """The sum of cost structs."""
    return F.struct(*[sum((F.col(f"{p}.{c}") for p in parts[1:]), F.col(f"{parts[0]}.{c}")).alias(c) for c in COST])


def _ways(starts: DataFrame, adjacent: DataFrame, block_of: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    done = searches(starts, adjacent) if block_of is None else searches_by_block(starts, adjacent, block_of, goals)
    return done.select(F.col("search_id").alias("a"), F.col("node").alias("b"), F.struct(*COST).alias("way"))


class PlaneWays:
    """Ways within planes and between gates, for one adjacency table (src, dst, edge_id, weight, metres, seconds) and nodes (node_id, plane_id, and x, y if known).

    Ways to and from other nodes than gates are kept for those of ``ends`` (node_id) only, if given.
    """

    def __init__(self, adjacent: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> None:
        self.block_of = None
        if {"x", "y"} <= set(nodes.columns):
            self.block_of = written(blocks(nodes.withColumnRenamed("node_id", "node")))
            self.nodes = self.block_of.select(F.col("node").alias("node_id"), F.col("block").alias("plane_id"))
        else:
            self.nodes = written(nodes.select("node_id", "plane_id").distinct())
        side = lambda end: self.nodes.select(F.col("node_id").alias(end), F.col("plane_id").alias(f"{end}_plane"))
        placed = written(adjacent.join(side("src"), "src").join(side("dst"), "dst"))
        across = placed.filter("src_plane <> dst_plane")
        self.inside = written(placed.filter("src_plane = dst_plane").select(*adjacent.columns))
        gates = written(across.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        starts = gates.select(F.col("node").alias("search_id"), "node", F.lit(0.0).alias("extra"))
        back = self.inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in adjacent.columns if c not in ("src", "dst")])
        #: from a gate to the nodes of its plane, and from those to the gate
        kept = None if ends is None else written(ends.select(F.col("node_id").alias("b")).union(gates).distinct())
        keep = lambda ways: ways if kept is None else ways.join(kept, "b", "left_semi").select("a", "b", "way")
        self.out = written(keep(_ways(starts, self.inside, self.block_of)))
        self.into = written(keep(_ways(starts, back, self.block_of)).select(F.col("b").alias("a"), F.col("a").alias("b"), "way"))
        between = self.out.join(gates.withColumnRenamed("node", "b"), "b", "left_semi").filter("a <> b")
        hops = between.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("plane").alias("edge_id"), *[F.col(f"way.{c}").alias(c) for c in COST])
        hops = hops.unionByName(across.select("src", "dst", "edge_id", *COST))
        #: between any two gates, over all planes
        self.gates = written(_ways(starts, hops))
        of = lambda end: self.nodes.select(F.col("node_id").alias(end), F.col("plane_id").alias(f"{end}_plane"))
        #: between two gates of one plane
        self.beside = written(self.gates.filter("a <> b").join(of("a"), "a").join(of("b"), "b").filter("a_plane = b_plane").select("a", "b", "way"))

    def _needed(self, costs: DataFrame, end: str, gate: str) -> DataFrame:
        """``costs`` (end, gate, cost) without gates that are passed by another gate of the end and of their plane at no more cost; what such a gate gives the other one gives too.

        The gates of one end meet each other first, so what is joined grows with them and not with all gates.
        """
        there, here = ("a", "b") if end == "from_id" else ("b", "a")
        via = self.beside.select(F.col(there).alias("via"), F.col(here).alias(gate), "way")
        other = costs.select(end, F.col(gate).alias("via"), F.col("cost").alias("first"))
        sums = [F.col(f"first.{c}") + F.col(f"way.{c}") <= F.col(f"cost.{c}") for c in COST[:2]]
        first = (F.col("way.weight") > 0) | (F.col("via") < F.col(gate))
        passed = costs.join(other, end).join(via, ["via", gate]).filter(sums[0] & sums[1] & first).select(end, gate)
        return costs.join(passed, [end, gate], "left_anti")

    def trips(self, trips: DataFrame, starts: DataFrame, goals: DataFrame, speed: float = WALKING_SPEED) -> DataFrame:
        """query_id, weight, metres, seconds of the fastest route of each trip (query_id, from_id, to_id) that has one.

        ``starts`` and ``goals`` (end_id, node_id, distance) hold the nodes of each end, with the metres walked to it.
        """
        walk = F.struct((F.col("distance") / speed).alias("weight"), F.col("distance").alias("metres"), (F.col("distance") / speed).alias("seconds"))
        s, g = (written(df.join(self.nodes, "node_id").select("end_id", "node_id", "plane_id", walk.alias("walk"))) for df in (starts, goals))
        least = lambda df, *keys: df.groupBy(*keys).agg(F.min("cost").alias("cost"))
        leave = written(least(s.join(self.into.withColumnRenamed("a", "node_id"), "node_id").select(F.col("end_id").alias("from_id"), F.col("b").alias("p"), _cost("walk", "way").alias("cost")), "from_id", "p"))
        arrive = written(least(self.out.withColumnRenamed("b", "node_id").join(g, "node_id").select(F.col("end_id").alias("to_id"), F.col("a").alias("q"), _cost("way", "walk").alias("cost")), "to_id", "q"))
        leave, arrive = written(self._needed(leave, "from_id", "p")), written(self._needed(arrive, "to_id", "q"))
        # the few gates of an end travel as one row, so that a trip is one row up to the least of its ways
        listed = lambda df, end, gate, name: df.groupBy(end).agg(F.collect_list(F.struct(gate, "cost")).alias(name))
        far = trips.select("query_id", "from_id", "to_id").join(listed(leave, "from_id", "p", "firsts"), "from_id").join(listed(arrive, "to_id", "q", "lasts"), "to_id")
        far = far.select("query_id", F.explode("firsts").alias("f"), "lasts").select("query_id", F.col("f.p").alias("p"), F.col("f.cost").alias("first"), F.explode("lasts").alias("l"))
        far = far.select("query_id", "p", F.col("l.q").alias("q"), "first", F.col("l.cost").alias("last"))
        far = far.join(self.gates.select(F.col("a").alias("p"), F.col("b").alias("q"), "way"), ["p", "q"]).select("query_id", _cost("first", "way", "last").alias("cost"))
        # trips that can stay on one plane: one search from each distinct start
        planes = lambda df, end: df.select(F.col("end_id").alias(end), "plane_id").distinct()
        near = written(trips.join(planes(s, "from_id"), "from_id").join(planes(g, "to_id"), ["to_id", "plane_id"]))
        own = s.join(near.select(F.col("from_id").alias("end_id"), "plane_id").distinct(), ["end_id", "plane_id"], "left_semi")
        starts_own = own.select(F.col("end_id").alias("search_id"), F.col("node_id").alias("node"), F.col("walk.weight").alias("extra"), F.col("walk.metres").alias("walked"))
        goal = g.select(F.col("end_id").alias("to_id"), "node_id", "walk")
        asked = near.join(g.select(F.col("end_id").alias("to_id"), "plane_id", "node_id"), ["to_id", "plane_id"]).select(F.col("from_id").alias("search_id"), F.col("node_id").alias("node"))
        direct = written(_ways(starts_own, self.inside, self.block_of, asked)).select(F.col("a").alias("from_id"), F.col("b").alias("node_id"), "way")
        stay = near.select("query_id", "from_id", "to_id").join(goal, "to_id").join(direct, ["from_id", "node_id"]).select("query_id", _cost("way", "walk").alias("cost"))
        return least(far.unionByName(stay), "query_id").select("query_id", *[F.col(f"cost.{c}").alias(c) for c in COST])


def reasons(trips: DataFrame, starts: DataFrame, goals: DataFrame, reached: DataFrame, relaxed: DataFrame) -> DataFrame:
    """query_id, reason of the trips (query_id, from_id, to_id) that no route was found for; ``relaxed``: those that have one without options."""
    start_ok = trips.join(starts.select(F.col("end_id").alias("from_id")).distinct(), "from_id", "left_semi")
    end_ok = trips.join(goals.select(F.col("end_id").alias("to_id")).distinct(), "to_id", "left_semi")
    return why_none(trips.select("query_id"), start_ok, end_ok, reached, relaxed)
