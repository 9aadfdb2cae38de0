"""Searches that settle blocks equal searches by hops, and their rounds do not grow with the hops of a route."""

import random

from pyspark.sql import functions as F

from atrium.operators import routing

EDGE = "src long, dst long, edge_id string, weight double, metres double, seconds double"


def _rows(df):
    return {(r.search_id, r.node): (round(r.weight, 9), r.hops, r.prev_node, r.prev_edge, round(r.metres, 9)) for r in df.collect()}


def test_blocks_equal_hops(spark):
    rng = random.Random(7)
    rows = []
    for i in range(12):
        for j in range(12):
            for k, l in ((i + 1, j), (i, j + 1)):
                if k < 12 and l < 12 and rng.random() < 0.9:
                    w = rng.uniform(1, 9)
                    rows += [(i * 12 + j, k * 12 + l, f"e{i},{j},{k}", w, w, w), (k * 12 + l, i * 12 + j, f"e{i},{j},{k}", w + 0.5, w, w)]
    edges = spark.createDataFrame(rows, EDGE)
    starts = spark.createDataFrame([("a", 0, 0.5), ("a", 143, 2.0), ("b", 70, 0.0)], "search_id string, node long, extra double")
    places = spark.range(144).selectExpr("id node", "0L plane_id", "cast(id % 12 as double) x", "cast(floor(id / 12) as double) y")
    cut = routing.blocks(places, 20)
    assert cut.groupBy("block").count().agg(F.max("count")).first()[0] <= 20
    assert _rows(routing.searches_by_block(starts, edges, cut)) == _rows(routing.searches(starts, edges))


def test_equal_places_are_cut_too(spark):
    places = spark.range(200).selectExpr("id node", "0L plane_id", "1.0D x", "2.0D y")
    sizes = [r["count"] for r in routing.blocks(places, 30).groupBy("block").count().collect()]
    assert max(sizes) <= 30 and sum(sizes) == 200


def test_a_long_corridor_takes_few_rounds(spark, monkeypatch):
    n, tables = 4000, []
    edges = spark.range(n - 1).selectExpr("id src", "id + 1 dst", "cast(id as string) edge_id", "1.0D weight", "1.0D metres", "1.0D seconds")
    places = spark.range(n).selectExpr("id node", "0L plane_id", "cast(id as double) x", "0.0D y")
    starts = spark.createDataFrame([(1, 0, 0.0)], "search_id long, node long, extra double")
    real = routing.written
    monkeypatch.setattr(routing, "written", lambda df: tables.append(1) or real(df))
    got = routing.searches_by_block(starts, edges, routing.blocks(places, 1000)).agg(F.count("node"), F.max("weight"), F.max("hops")).first()
    assert tuple(got) == (n, n - 1.0, n - 1) and len(tables) < 30
