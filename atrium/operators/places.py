"""Lookups and search over many places at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atrium.functions import geom, text
from atrium.operators import spatial


def ground_floors(floors: DataFrame) -> DataFrame:
    """building_id, plane_id: level 1, else 0, else the lowest not below 0, else the first (by ``ord``)."""
    level = F.col("level")
    rank = F.when(level == 1, 0).when(level == 0, 1).when(level >= 0, 2).otherwise(3)
    order = F.struct(rank, F.when(rank == 2, level).otherwise(0), "ord")
    return floors.groupBy("building_id").agg(F.min_by("plane_id", order).alias("plane_id"))


def outlines(buildings: DataFrame, spaces: DataFrame, floors: DataFrame) -> DataFrame:
    """building_id, outline: the footprint, else the hull of all its rooms' corners."""
    corners = spaces.join(floors.select("plane_id", "building_id"), "plane_id").select("building_id", F.explode("polygon").alias("p"))
    by_rooms = spatial.hulls(corners, "building_id")
    given = F.col("footprint") if "footprint" in buildings.columns else F.lit(None).cast("array<struct<x:double,y:double>>")
    return buildings.join(by_rooms, "building_id", "left").select("building_id", F.coalesce(given, "hull").alias("outline"))


def search(queries: DataFrame, places: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, rank, kind, id, score of the best ``limit`` places (kind, id, name, texts: array) for each query (query_id, text).

    The query table is broadcast by Spark where it is small; scores are computed once for each pair and only hits leave the join.
    """
    asked = queries.withColumn("asked", text.normalized(text.fold(F.col("text")))).filter("asked <> ''").select("query_id", "asked")
    best = F.array_max(F.transform("texts", lambda t: text.score(t, F.col("asked"))))
    places = places.withColumn("texts", F.split(text.fold(F.array_join("texts", "\n")), "\n"))
    hit = places.join(asked, text.normalized(F.array_join("texts", "\n")).contains(F.col("asked")) | F.col("asked").rlike("^[ㄱ-ㅎ]+$")).withColumn("score", best).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "kind", "id")
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "rank", "kind", "id", "score")


def object_counts(objects: DataFrame) -> DataFrame:
    """plane_id and one column of counts for each kind of object (plane_id, kind)."""
    kinds = ["space", "wall", "entrance", "poi", "node"]
    return objects.groupBy("plane_id").pivot("kind", kinds).count().na.fill(0)


def in_window(rings: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, id, mode: rings (plane_id, id, polygon) wholly inside a rectangle ("window") or touching it ("crossing")."""
    w = windows.select("window_id", "plane_id", "wx0", "wy0", "wx1", "wy1")
    b = rings.withColumn("b", geom.box(F.col("polygon"))).join(w, "plane_id").filter("b.x0 <= wx1 and wx0 <= b.x1 and b.y0 <= wy1 and wy0 <= b.y1")
    inner = F.forall("polygon", lambda p: p.x.between(F.col("wx0"), F.col("wx1")) & p.y.between(F.col("wy0"), F.col("wy1")))
    corner = lambda x, y: geom.point(F.col(x), F.col(y))
    frame = F.array(corner("wx0", "wy0"), corner("wx1", "wy0"), corner("wx1", "wy1"), corner("wx0", "wy1"))
    some = F.exists("polygon", lambda p: p.x.between(F.col("wx0"), F.col("wx1")) & p.y.between(F.col("wy0"), F.col("wy1")))
    meets = F.exists(geom.edges(F.col("polygon")), lambda e: F.exists(geom.edges(frame), lambda f: geom.crossing(e.a, e.b, f.a, f.b).isNotNull()))
    return b.withColumn("mode", F.when(inner, "window").when(some | meets, "crossing")).filter("mode is not null").select("window_id", "id", "mode")


def object_kinds(tables: dict[str, tuple[DataFrame, str]], asked: DataFrame) -> DataFrame:
    """id, kind, plane_id of each asked id (``id``): ``tables`` maps a kind to its table and key; ids that nothing has keep null kinds."""
    index = None
    for kind, (df, key) in tables.items():
        own = df.select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("kind"), "plane_id")
        index = own if index is None else index.union(own)
    return asked.select(F.col("id").cast("string")).distinct().join(index, "id", "left")


def group_of(members: DataFrame, asked: DataFrame) -> DataFrame:
    """id, group_id: the first group (by ``ord``, then id) that has each asked id as a member; ids in no group have no row."""
    at = members.select(F.col("member_id").alias("id"), "group_id", "ord")
    return asked.select("id").distinct().join(at, "id").groupBy("id").agg(F.min_by("group_id", F.struct("ord", "group_id")).alias("group_id"))
