"""Queries of the validation rules over the campus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators import validate as v
from atrium.plans.geometry import OVERLAPS
from atrium.plans.registry import query
from atrium.sources.campus import Campus

COLUMNS = ("severity", "type", "object_id", "message")
row = lambda severity, kind, ident, message="''": f"'{severity}' severity, '{kind}' type, cast({ident} as varchar) object_id, {message} message"


def _out(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


V4 = f"select {row('warning', 'unknown-space-type', 'space_id')} from c_space where type = 'unknown'"
V5 = f"""select {row('error', 'overlapping-spaces', 'space_a', "'overlaps ' || space_b")} from o where area > 1e-9
  union all select {row('error', 'overlapping-spaces', 'space_b', "'overlaps ' || space_a")} from o where area > 1e-9"""
V6 = f"""select {row('error', 'degenerate-wall', 'wall_id')} from c_wall where sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) < 0.01
  union all select {row('error', 'invalid-wall-thickness', 'wall_id')} from c_wall where thickness <= 0"""
V9 = f"""select {row('warning', 'opening-above-wall', 'e.entrance_id')} from c_entrance e join c_wall w on w.wall_id = e.wall_id and w.floor_id = e.floor_id
  where coalesce(e.height, case when e.type = 'window' then 1.2 else 2.1 end) + case when e.type = 'window' then 0.9 else 0 end > coalesce(w.height, 2.4)"""
V10 = f"select {row('error', 'disconnected-entrance', 'entrance_id')} from c_entrance e where space_a is not null and not exists (select 1 from c_space s where s.space_id = e.space_a and s.floor_id = e.floor_id)"
V15 = f"""select {row('warning', 'inaccurate-edge-distance', 'e.edge_id')} from c_nav_edge e join c_nav_node a on a.node_id = e.from_id join c_nav_node b on b.node_id = e.to_id
  where a.floor_id = b.floor_id and abs(e.distance - sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) > greatest(0.2*sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 1.0)"""
V17 = f"""select {row('warning', 'disconnected-navigation-node', 'n.node_id')} from c_nav_node n where (select count(*) from c_nav_node m where m.floor_id = n.floor_id) > 1
  and n.node_id not in (select from_id from c_nav_edge union all select to_id from c_nav_edge union all select node_id from c_stop union all select from_id from c_site_edge union all select to_id from c_site_edge)"""
V18 = f"""select {row('warning', 'missing-floor-connection', 'f.floor_id')} from c_floor f where (select count(*) from c_floor g where g.building_id = f.building_id) > 1
  and f.floor_id not in (select floor_id from c_stop where connector_id in (select connector_id from c_stop group by 1 having count(distinct floor_id) > 1))"""
V25 = f"""select {row('warning', 'duplicate-external-id', 'space_id', 'cast(external_id as varchar)')} from (select space_id, external_id, count(*) over (partition by external_id) n from c_space) where n > 1"""


def _objects(c: Campus) -> DataFrame:
    # one operator's map: ids are unique over the whole campus
    return c.spaces().select(F.lit(0).alias("project_id"), F.col("space_id").alias("object_id"), F.col("external_id").cast("string").alias("external_id"))


def _links(c: Campus) -> DataFrame:
    """Ends of everything that joins nodes: walks, site edges and connectors."""
    stops = c.stops().select(F.col("node_id").alias("from_id"), F.col("node_id").alias("to_id"))
    return c.edges().select("from_id", "to_id").union(c.site_edges().select("from_id", "to_id")).union(stops)


@query(V4)
def v4_unknown_type(c: Campus) -> DataFrame:
    return _out(v.unknown_type(c.spaces()))


@query(OVERLAPS + V5)
def v5_overlapping_spaces(c: Campus) -> DataFrame:
    return _out(v.overlaps(c.spaces()))


@query(V6)
def v6_walls(c: Campus) -> DataFrame:
    return _out(v.walls(c.walls()))


@query(V9)
def v9_above_walls(c: Campus) -> DataFrame:
    return _out(v.above_walls(c.entrances(), c.walls()))


@query(V10)
def v10_disconnected_entrances(c: Campus) -> DataFrame:
    return _out(v.disconnected_entrances(c.entrances(), c.spaces()))


@query(V15)
def v15_inaccurate_edges(c: Campus) -> DataFrame:
    return _out(v.inaccurate_edges(c.edges(), c.nodes()))


@query(V17)
def v17_lonely_nodes(c: Campus) -> DataFrame:
    return _out(v.lonely_nodes(c.nodes(), _links(c)))


@query(V18)
def v18_unconnected_floors(c: Campus) -> DataFrame:
    return _out(v.unconnected_floors(c.floors(), c.stops()))


@query(V25)
def v25_duplicate_external_ids(c: Campus) -> DataFrame:
    return _out(v.duplicate_external_ids(_objects(c)))


def _every(c: Campus) -> list[DataFrame]:
    s, w, e, n = c.spaces(), c.walls(), c.entrances(), c.nodes()
    every_node = n.select("node_id").union(c.site_nodes().select("node_id"))
    stops = c.stops().withColumn("ord", F.col("level"))
    connectors = stops.select("connector_id").distinct()
    return [
        v.too_few_vertices(s), v.self_intersecting(s), v.bad_holes(s), v.unknown_type(s), v.overlaps(s), v.walls(w), v.dimensions(e), v.missing_hosts(e, w), v.above_walls(e, w), v.disconnected_entrances(e, s),
        v.broken_edges(c.edges(), every_node), v.inaccurate_edges(c.edges(), n), v.duplicate_edges(c.edges()), v.lonely_nodes(n, _links(c)), v.unconnected_floors(c.floors(), c.stops(), c.edges(), c.nodes()),
        v.connector_stops(connectors, stops, c.floors(), n), v.broken_edges(c.site_edges(), every_node), v.duplicate_external_ids(_objects(c)), v.duplicate_floor_links(c.edges(), c.stops()),
    ]


@query(OVERLAPS + f", every as ({V4} union all {V5} union all {V6} union all {V9} union all {V10} union all {V15} union all {V17} union all {V18} union all {V25}) select severity, type, count(*) issues, count(distinct object_id) objects from every group by severity, type")
def v_validate_campus(c: Campus) -> DataFrame:
    """All rules together, counted by severity and type (those of rules without a defect here are absent on both sides)."""
    return v.combined(_every(c)).groupBy("severity", "type").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("object_id").alias("objects"))


@query(OVERLAPS + f", every as ({V4} union all {V5} union all {V6} union all {V9} union all {V10} union all {V15} union all {V17} union all {V18} union all {V25}) select sum(case when severity = 'error' then 1 else 0 end)::bigint errors, sum(case when severity = 'warning' then 1 else 0 end)::bigint warnings from every")
def a2_issue_counts(c: Campus) -> DataFrame:
    s = F.col("severity")
    return v.combined(_every(c)).agg(F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"))
