"""Bulk changes of map tables: deletes with their references, placements, rehoming and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.operators import spatial


def without(df: DataFrame, gone: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows whose key is not in ``gone`` (kind, id)."""
    ids = gone.filter(F.col("kind") == kind).select(F.col("id").alias(key)).distinct()
    return df.join(ids, key, "left_anti")


def cleared(df: DataFrame, gone: DataFrame, column: str, kind: str) -> DataFrame:
    """``df`` with references to deleted ids set to null."""
    ids = gone.filter(F.col("kind") == kind).select(F.col("id").alias(column), F.lit(True).alias("_gone")).distinct()
    return df.join(ids, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone").select(*df.columns)


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """What is left of spaces, walls, entrances, pois, nodes and edges after deleting ``gone``: references cleared, edges of deleted nodes dropped."""
    out = dict(tables)
    keys = {"spaces": ("space_id", "space"), "walls": ("wall_id", "wall"), "entrances": ("entrance_id", "entrance"), "pois": ("poi_id", "poi"), "nodes": ("node_id", "node"), "edges": ("edge_id", "edge")}
    for name, (key, kind) in keys.items():
        if name in out:
            out[name] = without(out[name], gone, key, kind)
    for name, columns in (("entrances", (("space_a", "space"), ("space_b", "space"), ("wall_id", "wall"))), ("pois", (("space_id", "space"),))):
        for column, kind in columns:
            if name in out and column in out[name].columns:
                out[name] = cleared(out[name], gone, column, kind)
    if "edges" in out:
        for end in ("from_id", "to_id"):
            out["edges"] = without(out["edges"], gone, end, "node")
    return out


def stripped_groups(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members (group_id, member_id) left; a group that lost a member and has one or none left is dissolved."""
    ids = gone.select(F.col("id").alias("member_id")).distinct()
    hit = members.join(ids, "member_id", "left_semi").select("group_id").distinct()
    left = members.join(ids, "member_id", "left_anti")
    poor = left.groupBy("group_id").count().filter("count <= 1").select("group_id").join(hit, "group_id", "left_semi")
    return left.join(poor, "group_id", "left_anti")


def stops_after(stops: DataFrame, gone: DataFrame) -> DataFrame:
    """Stops whose floor and node remain; deleted spaces are cleared."""
    left = without(without(stops, gone, "plane_id", "floor"), gone, "node_id", "node")
    return cleared(left, gone, "space_id", "space") if "space_id" in stops.columns else left


def upserted_stops(old: DataFrame, new: DataFrame) -> DataFrame:
    """One stop for each connector and floor; a new one replaces an old one."""
    both = old.withColumn("_rank", F.lit(1)).unionByName(new.withColumn("_rank", F.lit(0)))
    order = Window.partitionBy("connector_id", "plane_id").orderBy("_rank", "node_id")
    return both.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_rank")


def rehomed(objects: DataFrame, spaces: DataFrame, key: str) -> DataFrame:
    """Objects with ``space_id`` set to the first space they stand in, or null."""
    home = spatial.first_space(objects.select(key, "plane_id", "x", "y"), spaces, key)
    return objects.drop("space_id").join(home, key, "left")


def new_groups(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Groups (group_id, members) from asked (group_id, member_id): members already grouped or groups themselves drop out; two are needed."""
    taken = members.select("member_id").union(members.select("group_id")).distinct()
    free = asked.join(taken, "member_id", "left_anti")
    return free.groupBy("group_id").agg(F.array_sort(F.collect_set("member_id")).alias("members")).filter(F.size("members") >= 2)


def without_stops(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stops at none of ``nodes`` (node_id)."""
    return stops.join(nodes.select("node_id").distinct(), "node_id", "left_anti")


def ungrouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (group_id, member_id) of the groups that are not in ``groups`` (group_id); the members themselves stay on the map."""
    return members.join(groups.select("group_id").distinct(), "group_id", "left_anti")
