"""Edges drawn by hand between floors become connectors with stops, where that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import spatial
from atrium.operators.components import components
from atrium.operators.routing import written

#: The connector that each type of edge becomes.
CONNECTOR_OF = {"elevator": "elevator", "stairs": "stairs", "escalator": "escalator", "walk": "ramp"}


def planned(edges: DataFrame, nodes: DataFrame, floors: DataFrame) -> dict[str, DataFrame]:
    """What becomes of the edges that join two floors of a building: ``connectors``, ``stops``, ``replaced`` edges and ``skipped`` groups.

    Edges (edge_id, plane_id, from_id, to_id, type, accessible, one_way) of one type that share nodes are a group (columns building_id, type,
    group: its smallest node).  It is skipped if two of its nodes are on one floor (multiple-nodes-on-floor), or if it has one-way edges and is not
    an escalator on which all run up or all run down (one-way-ambiguous).  Stairs are never accessible, others if all edges are.
    """
    placed = nodes.select("node_id", "plane_id").join(floors.select("plane_id", "building_id", "level", "elevation"), "plane_id")
    side = lambda n, end: placed.select(F.col("node_id").alias(end), F.col("building_id").alias(f"{n}_building"), F.col("plane_id").alias(f"{n}_plane"), F.struct("elevation", "level").alias(f"{n}_height"))
    across = edges.join(side("a", "from_id"), "from_id").join(side("b", "to_id"), "to_id").filter("a_building = b_building and a_plane <> b_plane")
    across = written(across.withColumnRenamed("a_building", "building_id"))
    name = lambda end: F.struct("building_id", "type", F.col(end).alias("node_id"))
    ends = across.select(F.explode(F.array(name("from_id"), name("to_id"))).alias("node"))
    labels = components(ends, across.select(name("from_id").alias("a"), name("to_id").alias("b")))
    of_node = labels.select("node.building_id", "node.type", "node.node_id", F.col("component.node_id").alias("group"))
    key = ["building_id", "type", "group"]
    members = written(of_node.join(placed.drop("building_id"), "node_id"))
    rows = written(across.join(of_node.withColumnRenamed("node_id", "from_id"), ["building_id", "type", "from_id"]))
    up = F.col("b_height") > F.col("a_height")
    one_way = F.coalesce("one_way", F.lit(False))
    facts = rows.groupBy(*key).agg(F.bool_and("accessible").alias("accessible"), F.count(F.lit(1)).alias("edges"), F.count_if(one_way).alias("one_way"), F.count_if(up).alias("up"))
    floors_of = members.groupBy(*key).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("plane_id").alias("planes"))
    same_way = (F.col("type") == "escalator") & (F.col("one_way") == F.col("edges")) & F.col("up").isin(F.lit(0), F.col("edges"))
    reason = F.when(F.col("planes") < F.col("nodes"), "multiple-nodes-on-floor").when((F.col("one_way") > 0) & ~same_way, "one-way-ambiguous")
    groups = written(facts.join(floors_of, key).withColumn("reason", reason))
    kind = F.coalesce(*[F.when(F.col("type") == t, k) for t, k in CONNECTOR_OF.items()])
    direction = F.when(F.col("one_way") > 0, F.when(F.col("up") > 0, "up").otherwise("down"))
    good = groups.filter("reason is null")
    ident = F.concat_ws("-", F.lit("link"), "type", F.col("group").cast("string")).alias("connector_id")
    return {
        "connectors": good.select(*key, ident, kind.alias("kind"), (F.col("accessible") & (F.col("type") != "stairs")).alias("accessible"), direction.alias("direction"), "edges"),
        "stops": members.join(good.select(*key, ident), key).select("connector_id", "building_id", "plane_id", "node_id", "elevation", "level"),
        "replaced": rows.join(good.select(*key, ident), key).select("connector_id", "plane_id", "edge_id"),
        "skipped": groups.filter("reason is not null").select(*key, "nodes", "reason"),
    }


def applied(plan: dict[str, DataFrame], edges: DataFrame, nodes: DataFrame, spaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the edges that stay, the new stops with the first stairs or elevator room that each stands in)."""
    shafts = spaces.filter(F.col("type").isin("stairs", "elevator"))
    stops = plan["stops"].join(nodes.select("node_id", "x", "y"), "node_id")
    own = F.struct("connector_id", "node_id")
    home = spatial.first_space(stops.select(own.alias("stop"), "plane_id", "x", "y"), shafts, "stop").select("stop.connector_id", "stop.node_id", "space_id")
    return edges.join(plan["replaced"].select("edge_id"), "edge_id", "left_anti"), stops.drop("x", "y").join(home, ["connector_id", "node_id"], "left")
