"""A synthetic campus: map tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The views of FIXTURES.md, in the order in which they build on each other.
VIEWS = {
    "c_site": """select cast(r_regionkey as bigint) project_id, concat('site-', r_regionkey) site_id, r_name name, case when r_regionkey < 4 then cast(127.0 + r_regionkey as double) end lon, case when r_regionkey < 4 then cast(37.5 as double) end lat from region""",
    "c_building": """select cast(n_nationkey as bigint) building_id, cast(n_regionkey as bigint) project_id, n_name name, cast((n_nationkey % 5) * 300 as double) ox, cast(floor(n_nationkey / cast(5 as double)) * 300 as double) oy, cast((n_nationkey * 37) % 360 as double) bearing from nation""",
    "c_floor": """select b.building_id * 10 + l.level floor_id, b.building_id, b.project_id, l.level, case when b.building_id % 6 = 0 then cast(0 as double) else cast((l.level - 1) * 4 as double) end elevation from c_building b cross join (values (1),(2),(3)) l(level)""",
    "c_slot": """select p_partkey, (p_partkey % 25) * 10 + cast(floor(p_partkey / cast(25 as double)) as bigint) % 3 + 1 floor_id, cast(floor(p_partkey / cast(75 as double)) as bigint) slot, p_name, p_brand, p_type, p_size from part""",
    "c_space": """select p_partkey space_id, floor_id, slot ord, slot % 10 col, cast(floor(slot / cast(10 as double)) as bigint) row_no, p_name name, p_brand code, case when p_size % 9 = 0 then 'unknown' when p_size % 9 = 1 then 'corridor' when p_size % 9 = 2 then 'store' else 'room' end type, p_size, cast((slot % 10) * 6 as double) x0, cast(floor(slot / cast(10 as double)) * 5 as double) y0, cast((slot % 10) * 6 + case when p_partkey % 11 = 0 then 7 else 5 end as double) x1, cast(floor(slot / cast(10 as double)) * 5 + 4 as double) y1, case when p_partkey % 17 = 0 then p_partkey - p_partkey % 2 else p_partkey end external_id from c_slot""",
    "c_hole": """select space_id, x0 + 1 hx0, y0 + 1 hy0, x0 + 2 hx1, y0 + 2 hy1 from c_space where space_id % 13 = 0""",
    "c_wall": """select space_id * 2 wall_id, floor_id, x0 sx, y0 sy, x1 ex, y0 ey, cast(0.2 as double) thickness, case when space_id % 5 = 0 then cast(2.0 as double) end height from c_space
  union all select space_id * 2 + 1, floor_id, x0, y0, case when space_id % 97 = 0 then x0 else x0 end, case when space_id % 97 = 0 then y0 else y1 end, case when space_id % 89 = 0 then cast(0 as double) else cast(0.2 as double) end, cast(null as double) from c_space""",
    "c_entrance": """select space_id entrance_id, floor_id, x0 + 2.5 x, y0 y, case when space_id % 7 = 0 then 'window' else 'door' end type, case when space_id % 19 = 0 then -space_id - 1 else space_id end space_a, space_id * 2 wall_id, cast(0.9 as double) width, case when space_id % 5 = 0 then cast(2.2 as double) end height from c_space""",
    "c_poi": """select c_custkey poi_id, (c_custkey % 25) * 10 + cast(floor(c_custkey / cast(25 as double)) as bigint) % 3 + 1 floor_id, c_name name, c_mktsegment segment, cast((c_custkey * 17) % 600 as double) / cast(10 as double) x, cast((c_custkey * 29) % 150 as double) / cast(10 as double) y from customer""",
    "c_nav_node": """select space_id * 2 node_id, floor_id, x0 + 2.5 x, y0 y, 'entrance' type, col, row_no from c_space
  union all select space_id * 2 + 1, floor_id, x0 + 2.5, y0 - 0.5, 'normal', col, row_no from c_space""",
    "c_nav_edge": """select concat('d', space_id) edge_id, floor_id, space_id * 2 from_id, space_id * 2 + 1 to_id, 'walk' type, cast(0.5 as double) distance, true accessible from c_space
  union all select concat('h', a.space_id), a.floor_id, a.space_id * 2 + 1, b.space_id * 2 + 1, 'walk', case when a.space_id % 23 = 0 then cast(12 as double) else cast(6 as double) end, true from c_space a join c_space b on a.floor_id = b.floor_id and a.row_no = b.row_no and b.col = a.col + 1
  union all select concat('v', a.space_id), a.floor_id, a.space_id * 2 + 1, b.space_id * 2 + 1, 'walk', cast(5 as double), a.space_id % 4 <> 0 from c_space a join c_space b on a.floor_id = b.floor_id and a.col = 0 and b.col = 0 and b.row_no = a.row_no + 1""",
    "c_stop": """select b.building_id * 10 + k.kind connector_id, b.building_id, f.floor_id, k.kind, s.space_id * 2 + 1 node_id, f.level, f.elevation from c_building b cross join (values (1),(2)) k(kind) join c_floor f on f.building_id = b.building_id join c_space s on s.floor_id = f.floor_id and s.row_no = 0 and s.col = case when k.kind = 1 then 0 else 1 end""",
    "c_ping": """select event_id, ts, user_id, (user_id % 25) * 10 + cast(round(value * 100) as bigint) % 3 + 1 floor_id, cast((cast(round(value * 100) as bigint) * 7) % 6000 as double) / cast(100 as double) x, cast((cast(round(value * 100) as bigint) * 13) % 1500 as double) / cast(100 as double) y, case when event_type = 'error' then cast(20 as double) else cast(0 as double) end accuracy, event_type, props from events""",
    "c_trip": """select o_orderkey query_id, o_custkey from_poi, (o_orderkey * 7) % (select count(*) from customer) to_poi, o_orderpriority = '1-URGENT' require_accessible from orders""",
    "c_stroke": """select l_orderkey * 8 + l_linenumber stroke_id, l_suppkey % 75 plan_id, case when l_linenumber % 2 = 0 then 'horizontal' else 'vertical' end orientation, cast(l_partkey % 200 as double) offset_px, cast(l_orderkey % 500 as double) start_px, cast(l_orderkey % 500 + 15 + l_quantity as double) end_px, cast(1 + l_linenumber % 6 as double) thickness_px from lineitem""",
    "c_link": """select concat('l', a.p_partkey) edge_id, a.floor_id, case when a.slot % 8 = 6 or a.p_partkey % 41 = 0 then b.p_partkey else a.p_partkey end * 2 + 1 from_id, case when a.slot % 8 = 6 or a.p_partkey % 41 = 0 then a.p_partkey else b.p_partkey end * 2 + 1 to_id, case a.slot % 4 when 0 then 'elevator' when 1 then 'stairs' when 2 then 'escalator' else 'walk' end type, a.p_partkey % 5 <> 0 accessible, a.slot % 4 = 2 or a.p_partkey % 37 = 0 one_way from c_slot a join c_slot b on b.p_partkey = a.p_partkey + 25 and b.slot = a.slot
  union all select concat('m', a.p_partkey), a.floor_id, a.p_partkey * 2 + 1, b.p_partkey * 2 + 1, case a.slot % 4 when 0 then 'elevator' when 1 then 'stairs' when 2 then 'escalator' else 'walk' end, true, false from c_slot a join c_slot b on b.p_partkey = a.p_partkey + 100 and b.slot = a.slot + 1 where a.slot % 7 = 0
  union all select edge_id, floor_id, from_id, to_id, type, accessible, false from c_nav_edge""",
    "c_furniture": """select space_id * 3 furniture_id, floor_id, case when space_id % 29 = 0 then -space_id - 1 when space_id % 5 <> 0 then space_id end home, x0 + 1.5 x, y0 + 2 y, cast(0.8 + (space_id % 3) * 0.4 as double) width, cast(0.5 as double) depth, cast((space_id * 15) % 360 as double) turn from c_space""",
    "c_member": """select space_id % 50 group_id, floor_id, concat(case space_id % 7 when 0 then 'space-' when 1 then 'wall-' when 2 then 'entrance-' when 3 then 'node-' when 4 then 'edge-d' when 5 then 'furniture-' else 'poi-' end, case space_id % 7 when 1 then space_id * 2 when 3 then space_id * 2 + 1 when 5 then space_id * 3 else space_id end + case when space_id % 31 = 0 then 1000000000 else 0 end) member_id from c_space""",
    "c_place": """select p.poi_id, p.floor_id, p.x, p.y, s.space_id from c_poi p left join c_space s on s.floor_id = p.floor_id and s.ord = p.poi_id % 7 and p.poi_id % 4 = 0""",
    "c_end": """select poi_id end_id, case when poi_id % 5 = 0 then 'node' when poi_id % 5 = 1 then 'space' when poi_id % 5 = 2 then 'position' else 'poi' end kind, case when poi_id % 5 = 0 then (poi_id % (select count(*) from part)) * 2 + 1 when poi_id % 5 = 1 then poi_id % (select count(*) from part) + 1 else poi_id end ref_id, floor_id, x, y from c_poi""",
    "c_grid": """select p_partkey, floor_id, slot % 10 col, cast(floor(slot / cast(10 as double)) as bigint) row_no from c_slot""",
    "c_plan_stroke": """select p_partkey * 10 stroke_id, floor_id plan_id, 'horizontal' orientation, cast(row_no * 50 + p_partkey % 3 - 1 as double) offset_px, cast(col * 60 as double) start_px, cast(col * 60 + case when p_partkey % 5 = 0 then 66 else 60 end as double) end_px, cast(4 + p_partkey % 4 as double) thickness_px from c_grid where p_partkey % 17 <> 3
  union all select p_partkey * 10 + 1, floor_id, 'vertical', cast(col * 60 + p_partkey % 3 - 1 as double), cast(row_no * 50 as double), cast(row_no * 50 + 50 as double), cast(4 + p_partkey % 3 as double) from c_grid
  union all select p_partkey * 10 + 2, floor_id, 'horizontal', cast(row_no * 50 + 25 as double), cast(col * 60 + 20 as double), cast(col * 60 + 35 as double), cast(3 as double) from c_grid where p_partkey % 23 = 0
  union all select p_partkey * 10 + 3, floor_id, 'vertical', cast(col * 60 + 30 as double), cast(row_no * 50 as double), cast(row_no * 50 + 20 as double), cast(4 as double) from c_grid where p_partkey % 19 = 0
  union all select p_partkey * 10 + 4 + k.k, floor_id, case when k.k < 2 then 'horizontal' else 'vertical' end, cast(case when k.k < 2 then row_no * 50 + 10 + k.k * 30 else col * 60 + 10 + (k.k - 2) * 30 end as double), cast(case when k.k < 2 then col * 60 + 10 else row_no * 50 + 10 end as double), cast(case when k.k < 2 then col * 60 + 40 else row_no * 50 + 40 end as double), cast(4 as double) from c_grid cross join (values (0),(1),(2),(3)) k(k) where p_partkey % 31 = 0""",
    "c_site_node": """select -1 - building_id node_id, project_id, building_id, ox + 2.5 x, oy - 10 y, 'normal' type from c_building""",
    "c_site_edge": """select concat('g', b.building_id) edge_id, b.project_id, -1 - b.building_id from_id, s.space_id * 2 to_id, 'walk' type, cast(1 as double) distance, true accessible from c_building b join c_floor f on f.building_id = b.building_id and f.level = 1 join c_space s on s.floor_id = f.floor_id and s.ord = 0
  union all select concat('r', a.building_id), a.project_id, -1 - a.building_id, -1 - b.building_id, 'walk', cast(300 as double), true from c_building a join c_building b on b.project_id = a.project_id and b.building_id = a.building_id + 5""",
    "c_rule": """select * from (values (1, 'click', 'k', 'gt', '50', 'panel.open'), (2, 'purchase', 'k', 'lt', '20', 'marker.add'), (3, 'view', 'k', 'equals', '7', 'poi.focus'), (4, 'view', 'k', 'between', '1', 'panel.open')) r(rule_id, event, field, operator, value, action)""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def prelude() -> str:
    """The views as common table expressions, for an engine in which the base tables are registered."""
    return "with recursive " + ", ".join(f"{name} as ({sql})" for name, sql in VIEWS.items()) + " "


def needed(name: str) -> tuple[list[str], list[str]]:
    """The base tables and the views (in order) that a view is built on, itself included."""
    base: set[str] = set()
    views = {name}
    for view in reversed(VIEWS):
        if view in views:
            words = set(re.findall(r"\w+", VIEWS[view]))
            views |= words & VIEWS.keys()
            base |= words & set(BASE)
    return sorted(base), [v for v in VIEWS if v in views]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the Parquet tables of a folder."""
    base, views = needed(name)
    parts = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in base] + [f"{v} as ({VIEWS[v]})" for v in views]
    return spark.sql(f"with {', '.join(parts)} select * from {name}")


class Campus:
    """The campus as entity tables; a plane is a floor, or the site for outdoor nodes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.views: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        if name not in self.views:
            self.views[name] = table(self.spark, self.sf_dir, name)
        return self.views[name]

    def floors(self) -> DataFrame:
        f, b = self.view("c_floor"), self.view("c_building").select("building_id", "ox", "oy", "bearing")
        return f.join(b, "building_id").withColumnRenamed("floor_id", "plane_id")

    def spaces(self) -> DataFrame:
        """space_id, plane_id, ord, polygon, holes and the descriptive columns."""
        point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        box = lambda a, b, c, d: F.array(point(a, b), point(c, b), point(c, d), point(a, d))
        hole = self.view("c_hole").select("space_id", F.array(box("hx0", "hy0", "hx1", "hy1")).alias("holes"))
        none = F.array().cast("array<array<struct<x:double,y:double>>>")
        s = self.view("c_space").join(hole, "space_id", "left")
        return s.select("space_id", F.col("floor_id").alias("plane_id"), "ord", "name", "code", "type", "external_id", box("x0", "y0", "x1", "y1").alias("polygon"), F.coalesce("holes", none).alias("holes"))

    def walls(self) -> DataFrame:
        return self.view("c_wall").withColumnRenamed("floor_id", "plane_id")

    def entrances(self) -> DataFrame:
        return self.view("c_entrance").withColumnRenamed("floor_id", "plane_id")

    def pois(self) -> DataFrame:
        return self.view("c_poi").withColumnRenamed("floor_id", "plane_id")

    def pings(self) -> DataFrame:
        return self.view("c_ping").withColumnRenamed("floor_id", "plane_id")

    def nodes(self) -> DataFrame:
        """Indoor nodes: node_id, plane_id, building_id, project_id, x, y, type."""
        f = self.view("c_floor").select("floor_id", "building_id", "project_id")
        return self.view("c_nav_node").join(f, "floor_id").select("node_id", F.col("floor_id").alias("plane_id"), "building_id", "project_id", "x", "y", "type")

    def site_nodes(self) -> DataFrame:
        return self.view("c_site_node")

    def edges(self) -> DataFrame:
        f = self.view("c_floor").select("floor_id", "project_id")
        return self.view("c_nav_edge").join(f, "floor_id").withColumnRenamed("floor_id", "plane_id").withColumn("one_way", F.lit(False))

    def site_edges(self) -> DataFrame:
        return self.view("c_site_edge").withColumn("one_way", F.lit(False))

    def stops(self) -> DataFrame:
        return self.view("c_stop").withColumnRenamed("floor_id", "plane_id").withColumn("type", F.when(F.col("kind") == 1, "elevator").otherwise("stairs"))
