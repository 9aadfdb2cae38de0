"""Routes that are replaced while positions arrive: the stream gives what the batch gives, and its state ends with the routes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from atrium.streaming import journeys

START = datetime(2024, 3, 1, 8)
PING = "user_id long, ping_id long, ts timestamp, plane_id long, x double, y double, accuracy double"
ROUTE = "key long, user_id long, starts timestamp, plane_id long, to_id long, segments array<struct<ax:double,ay:double,bx:double,by:double>>, end struct<x:double,y:double>"


def route(key, user, minutes, plane=1):
    return (key, user, START + timedelta(minutes=minutes), plane, key * 10, [(0.0, 0.0, 40.0, 0.0)], (40.0, 0.0))


def at(user, ping, minutes, x, y, plane=1):
    return (user, ping, START + timedelta(minutes=minutes), plane, float(x), float(y), 0.0)


def said(df):
    return sorted((r.key, r.ping_id, r.kind, r.distance) for r in df.collect())


def test_a_new_route_starts_anew(spark):
    routes = spark.createDataFrame([route(1, 1, 0), route(2, 1, 60), route(3, 1, 60), route(4, 2, 0)], ROUTE)
    rows = [
        at(1, 0, -5, 40, 0),  # before any route
        at(1, 1, 5, 10, 30), at(1, 2, 6, 10, 31), at(1, 3, 10, 39, 0),  # strays once, arrives
        at(1, 4, 20, 10, 30),  # nothing after the arrival
        at(1, 5, 60, 10, 30), at(1, 6, 70, 39, 0),  # route 3 counts, as it starts with route 2
        at(2, 7, 13 * 60, 39, 0),  # route 4 has ended
        at(3, 8, 5, 39, 0),  # no route
        (2, 9, START, 1, None, 0.0, None),
        at(2, 10, 1, 5, 0, plane=9),  # a plane that the route does not visit
    ]
    found = journeys.alerts(spark.createDataFrame(rows, PING), routes)
    assert said(found) == [(1, 1, "route.offRoute", 30.0), (1, 3, "route.arrived", None), (3, 5, "route.offRoute", 30.0), (3, 6, "route.arrived", None), (4, 10, "route.offRoute", None)]
    asked = {(r.key, r.user_id, r.plane_id, r.x, r.y, r.to_id) for r in journeys.reroutes(found, routes).collect()}
    assert asked == {(1, 1, 1, 10.0, 30.0, 10), (3, 1, 1, 10.0, 30.0, 30), (4, 2, 9, 5.0, 0.0, 40)}


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(3)
    pings = [at(rng.randrange(5), i, i * 7, rng.randrange(0, 41), rng.choice([0, 0, 3, 30])) for i in range(600)]
    routes = [route(100 + i, rng.randrange(5), rng.randrange(0, 4200)) for i in range(30)]
    return pings, spark.createDataFrame(routes, ROUTE)


def test_the_stream_equals_the_batch_and_forgets(spark, days, tmp_path):
    pings, routes = days
    for i in range(0, 600, 150):
        spark.createDataFrame(pings[i : i + 150], PING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    later = spark.createDataFrame([at(77, 9999, 20000, 0, 0)], PING)  # far behind all routes
    later.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = journeys.alert_stream(stream, routes)
    q = found.writeStream.format("memory").queryName("journeys").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    want = said(journeys.alerts(spark.createDataFrame(pings, PING), routes))
    assert said(spark.sql("select * from journeys")) == want and len(want) > 20
    # a state lives from its route's start until the watermark, which is ten minutes behind the batch before, has passed its end
    live = journeys.spans(routes).collect()
    length = timedelta(minutes=150 * 7)
    most = max(sum(r.starts < START + (i + 1) * length and r.ends > START + i * length - timedelta(minutes=17) for r in live) for i in range(4))
    assert held[-1] == 0 and max(held) <= most < len(live)


def test_requests_leave_a_stream(spark, days, tmp_path):
    pings, routes = days
    spark.createDataFrame(pings, PING).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PING).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/requests"
    q = journeys.reroute_feed(journeys.alert_stream(stream, routes), routes, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    want = journeys.reroutes(journeys.alerts(spark.createDataFrame(pings, PING), routes), routes)
    keys = lambda df: sorted((r.key, r.ping_id, r.to_id) for r in df.collect())
    assert keys(spark.read.parquet(out)) == keys(want) != []
