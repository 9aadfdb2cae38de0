"""Fastest routes of many searches at once, by relaxation of a frontier over the adjacency table.

One search serves all destinations of a start.  A hop joins the nodes that improved last with their edges,
keeps the best arrival at each node, and goes on with those that beat what was known.  A round makes several hops in one plan and
writes one table of what is known and what goes on.  Rounds end when nothing improves; weights are not negative, so there are at
most as many hops as nodes.

Where nodes have coordinates, planes are cut into blocks of a bounded number of nodes (``blocks``), and ``searches_by_block`` settles whole
blocks: a round is one pass over the blocks that were entered anew, so rounds grow with the blocks along a route and not with its hops.
"""

from __future__ import annotations

import heapq
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hops between two written tables.
HOPS = 3
#: About how many nodes a block has at most, and how many searches one task takes through it at once.
BLOCK, AT_ONCE = 16384, 64
STATE = ["search_id", "node", "weight", "hops", "prev_node", "prev_edge", "metres", "seconds"]


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-atrium-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` through Parquet files in the shared folder, which cuts its lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def searches(starts: DataFrame, adjacent: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Every settled (search, node) from starts (search_id, node, extra seconds, and ``walked`` metres if any): weight, hops, previous node and edge, metres, seconds."""
    none = F.lit(None).cast(adjacent.schema["src"].dataType)
    walked = F.col("walked") if "walked" in starts.columns else F.lit(0.0)
    first = starts.groupBy("search_id", "node").agg(F.min(F.struct("extra", walked.alias("walked"))).alias("f"))
    best = written(first.select("search_id", "node", F.col("f.extra").alias("weight"), F.lit(0).alias("hops"), none.alias("prev_node"), F.lit(None).cast("string").alias("prev_edge"), F.col("f.walked").alias("metres"), F.col("f.extra").alias("seconds")))
    edges = written(adjacent.select("src", "dst", F.col("edge_id").cast("string").alias("edge_id"), F.col("weight").alias("w"), F.col("metres").alias("m"), F.col("seconds").alias("s")))
    state, done = best.withColumn("fresh", F.lit(True)), 0
    while most_rounds is None or done < most_rounds:
        hops = HOPS if most_rounds is None else min(HOPS, most_rounds - done)
        known = state.select("search_id", "node", F.col("weight").alias("old"))
        step, found = state.filter("fresh").select(*STATE), None
        for hop in range(1, hops + 1):
            reach = step.join(edges, step["node"] == edges["src"]).select("search_id", F.col("dst").alias("node"), F.struct((F.col("weight") + F.col("w")).alias("weight"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("prev_node"), F.col("edge_id").alias("prev_edge"), (F.col("metres") + F.col("m")).alias("metres"), (F.col("seconds") + F.col("s")).alias("seconds")).alias("a"))
            arrived = reach.groupBy("search_id", "node").agg(F.min("a").alias("a"))
            step = arrived.join(known, ["search_id", "node"], "left").filter("old is null or a.weight < old - 1e-12").select("search_id", "node", "a.*")
            rows = step.select("search_id", "node", F.struct(*STATE[2:], F.lit(hop).alias("hop")).alias("a"))
            found = rows if found is None else found.union(rows)
        best = found.groupBy("search_id", "node").agg(F.min("a").alias("a"))
        # what was reached by the last hop goes on; what an earlier hop reached best has gone on already
        won = F.col("a").isNotNull() & (F.col("weight").isNull() | (F.col("a.weight") < F.col("weight") - 1e-12))
        merged = state.select(*STATE).join(best, ["search_id", "node"], "full_outer")
        state = written(merged.select("search_id", "node", *[F.when(won, F.col(f"a.{c}")).otherwise(F.col(c)).alias(c) for c in STATE[2:]], (won & (F.col("a.hop") == hops)).alias("fresh")))
        if state.filter("fresh").isEmpty():
            break
        done += hops
    return state.select(*STATE)


def blocks(places: DataFrame, limit: int = BLOCK) -> DataFrame:
    """node, block of places (node, plane_id, x, y): planes, halved near the middle of their longer side until no part has more than ``limit`` nodes."""
    at = written(places.groupBy("node").agg(F.min(F.struct("plane_id", "x", "y")).alias("p")).select("node", "p.*", F.lit(1).cast("long").alias("cut")))
    ends = [f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]
    while True:
        wide = at.groupBy("plane_id", "cut").agg(F.count(F.lit(1)).alias("n"), *ends, *[F.percentile_approx(c, 0.5, 1000).alias(f"{c}m") for c in ("x", "y")]).filter(F.col("n") > limit).drop("n")
        wide = written(wide)
        if wide.isEmpty():
            return at.select("node", F.concat_ws(":", "plane_id", "cut").alias("block"))
        beyond = lambda c: F.when(F.col(f"{c}m") < F.col(f"{c}1"), F.col(c) > F.col(f"{c}m")).otherwise(F.col(c) >= F.col(f"{c}m"))
        wx, wy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        side = F.when((wx <= 0) & (wy <= 0), F.pmod(F.xxhash64("node", "cut"), F.lit(2)) == 1).when(wx >= wy, beyond("x")).otherwise(beyond("y"))
        cut = F.when(F.col("x0").isNull(), F.col("cut")).otherwise(F.col("cut") * 2 + side.cast("long"))
        at = written(at.join(wide, ["plane_id", "cut"], "left").select("node", "plane_id", "x", "y", cut.alias("cut")))


def _settler(schema: pa.Schema, outside: bool):
    """What settles one block for some searches: from labels to labels of nodes outside (those that edges out of the block reach) or of its own."""
    names = STATE[2:]

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        leads, beyond = {}, set()
        for src, dst, edge, w, m, s, inside in zip(*(right.column(c).to_pylist() for c in ("src", "dst", "edge_id", "w", "m", "s", "inside"))):
            if inside or outside:
                leads.setdefault(src, []).append((dst, edge, w, m, s))
            if not inside:
                beyond.add(dst)
        first, goals = {}, {}
        for search, node, goal, *label in zip(*(left.column(c).to_pylist() for c in ("search_id", "node", "goal", *names))):
            if goal:
                goals.setdefault(search, set()).add(node)
            else:
                first.setdefault(search, []).append((*label, node))
        rows = []
        for search, heap in first.items():
            done, asked = set(), goals.get(search)
            ahead = set(asked) if asked is not None else None
            heapq.heapify(heap)
            while heap:
                weight, hops, _, _, metres, seconds, node = label = heapq.heappop(heap)
                if node in done:
                    continue
                done.add(node)
                if (node in beyond) == outside if asked is None else node in asked:
                    rows.append((search, node, *label[:6]))
                if ahead is not None:
                    ahead.discard(node)
                    if not ahead:
                        break
                for dst, edge, w, m, s in leads.get(node, ()):
                    if dst not in done:
                        heapq.heappush(heap, (weight + w, hops + 1, node, edge, metres + m, seconds + s, dst))
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return settle


def _tracer(schema: pa.Schema):
    """What walks back inside one block: from labels and asked nodes (``goal``) to the steps of each asked node and the node before them, outside."""
    names = STATE[2:]

    def trace(left: pa.Table, right: pa.Table) -> pa.Table:
        leads = {}
        for src, dst, edge, w, m, s, inside in zip(*(right.column(c).to_pylist() for c in ("src", "dst", "edge_id", "w", "m", "s", "inside"))):
            if inside:
                leads.setdefault(src, []).append((dst, edge, w, m, s))
        first, asked = {}, {}
        for search, node, goal, *label in zip(*(left.column(c).to_pylist() for c in ("search_id", "node", "goal", *names))):
            if goal:
                asked.setdefault(search, set()).add(node)
            else:
                first.setdefault(search, []).append((*label, node, True))
        rows = []
        for search, goals in asked.items():
            heap, came, ahead = first.get(search, []), {}, set(goals)
            heapq.heapify(heap)
            while heap and ahead:
                weight, hops, before, by, metres, seconds, node, entry = heapq.heappop(heap)
                if node in came:
                    continue
                came[node] = (hops, before, by, entry)
                ahead.discard(node)
                for dst, edge, w, m, s in leads.get(node, ()):
                    if dst not in came:
                        heapq.heappush(heap, (weight + w, hops + 1, node, edge, metres + m, seconds + s, dst, False))
            for goal in goals & came.keys():
                steps, node, entry = [], goal, False
                while not entry:
                    hops, before, by, entry = came[node]
                    steps.append({"ord": hops, "node": node, "edge_id": by})
                    node = before
                rows.append((search, goal, steps, node))
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return trace


class Entered:
    """The best labels of searches at all nodes where a block (``block_of``: node, block) is entered, from which blocks are settled on demand.

    A round takes the labels that improved at such nodes through their blocks, and keeps the best labels at the nodes that edges
    between blocks reach.  Rounds end when none improves.
    """

    def __init__(self, starts: DataFrame, adjacent: DataFrame, block_of: DataFrame) -> None:
        kind = adjacent.schema["src"].dataType
        self.block_of = block_of
        walked = F.col("walked") if "walked" in starts.columns else F.lit(0.0)
        first = starts.groupBy("search_id", "node").agg(F.min(F.struct(F.col("extra").cast("double").alias("extra"), walked.cast("double").alias("walked"))).alias("f"))
        best = first.select("search_id", F.col("node").cast(kind).alias("node"), F.col("f.extra").alias("weight"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("prev_node"), F.lit(None).cast("string").alias("prev_edge"), F.col("f.walked").alias("metres"), F.col("f.extra").alias("seconds"))
        best = written(self.home(best, "node", "block"))
        edges = adjacent.select("src", F.col("dst").cast(kind).alias("dst"), F.col("edge_id").cast("string").alias("edge_id"), *[F.col(a).cast("double").alias(b) for a, b in (("weight", "w"), ("metres", "m"), ("seconds", "s"))])
        edges = self.home(self.home(edges, "src", "block"), "dst", "to").withColumn("inside", F.col("block") == F.col("to")).drop("to")
        self.edges = edges = written(edges)
        self.state = best.select(*STATE).schema
        fresh = None if edges.filter("not inside").isEmpty() else best
        while fresh is not None and not fresh.isEmpty():
            heard = self.settled(_labelled(fresh), True).groupBy("search_id", "node").agg(F.min(F.struct(*STATE[2:])).alias("a"))
            known = best.select("search_id", "node", F.col("weight").alias("old"))
            better = heard.join(known, ["search_id", "node"], "left").filter("old is null or a.weight < old - 1e-12").select("search_id", "node", "a.*")
            fresh = written(self.home(better, "node", "block"))
            best = written(best.join(fresh.select("search_id", "node"), ["search_id", "node"], "left_anti").unionByName(fresh))
        self.best = best

    def home(self, df: DataFrame, node: str, name: str) -> DataFrame:
        of = self.block_of.select(F.col("node").alias(node), F.col("block").alias(name))
        return df.join(of, node, "left").withColumn(name, F.coalesce(name, F.concat(F.lit("node "), F.col(node).cast("string"))))

    def spread(self, rows: DataFrame, make, schema) -> DataFrame:
        """What ``make(arrow schema)`` gives for each block and part of the searches in it."""
        from pyspark.sql.pandas.types import to_arrow_schema

        parts = rows.groupBy("block").agg(F.ceil(F.count_distinct("search_id") / AT_ONCE).cast("int").alias("parts"))
        left = rows.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("search_id"), F.col("parts")).cast("int"))
        right = self.edges.join(parts.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "block")
        met = left.select("block", "part", "goal", *STATE).groupBy("block", "part").cogroup(right.groupBy("block", "part"))
        return met.applyInArrow(make(to_arrow_schema(schema)), schema)

    def settled(self, rows: DataFrame, outside: bool) -> DataFrame:
        return self.spread(rows, lambda schema: _settler(schema, outside), self.state)

    def asked(self, goals: DataFrame) -> DataFrame:
        """The labels of the blocks in which ``goals`` (search_id, node) lie, and the goals themselves."""
        asked = self.home(goals.select("search_id", "node").distinct(), "node", "block").join(self.best.select("search_id", "block").distinct(), ["search_id", "block"], "left_semi")
        rows = _labelled(self.best).join(asked.select("search_id", "block").distinct(), ["search_id", "block"], "left_semi")
        return rows.unionByName(asked.withColumn("goal", F.lit(True)), allowMissingColumns=True)

    def labels(self, goals: DataFrame | None = None) -> DataFrame:
        """The labels of all nodes of all blocks entered, or of ``goals``."""
        return self.settled(_labelled(self.best) if goals is None else self.asked(goals), False)

    def paths(self, found: DataFrame) -> DataFrame:
        """As ``paths``: a round walks back through one block of each route, and routes that enter it at the same node do so once."""
        node = self.state["node"].dataType.simpleString()
        schema = T.StructType([self.state["search_id"], self.state["node"], *T.StructType.fromDDL(f"steps array<struct<ord:int,node:{node},edge_id:string>>, before {node}")])
        at = written(found.filter("node is not null").select("query_id", "search_id", F.col("node").cast(node).alias("node")))
        steps = None
        while not at.isEmpty():
            traced = written(self.spread(self.asked(at), _tracer, schema))
            rows = at.join(traced.select("search_id", "node", "steps"), ["search_id", "node"]).select("query_id", F.inline("steps"))
            steps = rows if steps is None else steps.union(rows)
            at = written(at.join(traced.filter("before is not null").select("search_id", "node", "before"), ["search_id", "node"]).select("query_id", "search_id", F.col("before").alias("node")))
        return steps if steps is not None else at.select("query_id", F.lit(0).alias("ord"), "node", F.lit("").alias("edge_id"))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("goal", F.lit(False))


def searches_by_block(starts: DataFrame, adjacent: DataFrame, block_of: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """As ``searches``, with blocks (node, block) settled as wholes; ``goals`` (search_id, node) restrict the result to them."""
    return Entered(starts, adjacent, block_of).labels(goals)


def routes(settled: DataFrame, goals: DataFrame) -> DataFrame:
    """query_id, search_id, node, weight, metres, seconds: the best goal (query_id, search_id, node, extra) of each query; null where none is reached."""
    hit = goals.join(settled, ["search_id", "node"]).withColumn("total", F.col("weight") + F.col("extra"))
    best = hit.groupBy("query_id").agg(F.min(F.struct("total", "node", "search_id", "metres", (F.col("seconds") + F.col("extra")).alias("seconds"))).alias("b"))
    return goals.select("query_id").distinct().join(best, "query_id", "left").select("query_id", "b.search_id", "b.node", F.col("b.total").alias("weight"), "b.metres", "b.seconds")


def paths(settled: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, ord (from the start), node, edge_id: the steps of each found route, walked back from its end."""
    at = found.filter("node is not null").select("query_id", "search_id", "node")
    state = settled.select("search_id", "node", "hops", "prev_node", "prev_edge")
    steps = None
    while True:
        here = written(at.join(state, ["search_id", "node"]))
        if here.isEmpty():
            break
        rows = here.select("query_id", F.col("hops").alias("ord"), "node", F.col("prev_edge").alias("edge_id"))
        steps = rows if steps is None else steps.union(rows)
        at = here.filter("prev_node is not null").select("query_id", "search_id", F.col("prev_node").alias("node"))
    return steps if steps is not None else at.select("query_id", F.lit(0).alias("ord"), "node", F.lit("").alias("edge_id")).limit(0)


def why_none(queries: DataFrame, start_ok: DataFrame, end_ok: DataFrame, reached: DataFrame, relaxed: DataFrame) -> DataFrame:
    """query_id, reason of queries without a route: no start, no end, only the options forbid it, or not joined at all."""
    mark = lambda df, name: df.select("query_id", F.lit(True).alias(name)).distinct()
    q = queries.join(reached.select("query_id"), "query_id", "left_anti").join(mark(start_ok, "s"), "query_id", "left").join(mark(end_ok, "e"), "query_id", "left").join(mark(relaxed, "r"), "query_id", "left")
    reason = F.when(F.col("s").isNull(), "start-unreachable").when(F.col("e").isNull(), "end-unreachable").when(F.col("r").isNotNull(), "blocked-by-options").otherwise("disconnected")
    return q.select("query_id", reason.alias("reason"))
