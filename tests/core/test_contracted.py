"""Components and cycles contract links within runs before anything goes in rounds."""

import random

from pyspark.sql import functions as F

from atrium.operators import components as c
from atrium.operators import routing


def _grid(spark, n):
    """A comb of n x n named points, some links left out."""
    rng = random.Random(5)
    links = [(f"n{i * n + j:06d}", f"n{k * n + m:06d}") for i in range(n) for j in range(n) for k, m in ((i + 1, j), (i, j + 1)) if k < n and m < n and (j == m or rng.random() < 0.3) and rng.random() < 0.9]
    parent = {f"n{i:06d}": f"n{i:06d}" for i in range(n * n)}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return spark.createDataFrame([(v,) for v in parent], "node string"), spark.createDataFrame(links, "a string, b string"), {v: find(v) for v in parent}


def test_components_in_one_run_and_in_many(spark, monkeypatch):
    nodes, links, want = _grid(spark, 30)
    assert {r.node: r.component for r in c.components(nodes, links).collect()} == want
    assert c._jumped(nodes, links).count() == len(want)
    number = lambda k: F.substring(k, 2, 6).cast("int")
    near = lambda k: [F.floor(number(k) / 300), number(k)]
    calls, real = [], routing.written
    monkeypatch.setattr(c, "written", lambda df: calls.append(1) or real(df))
    assert {r.node: r.component for r in c.components(nodes, links, near).collect()} == want
    assert len(calls) <= 3  # no rounds
    monkeypatch.setattr(c, "RUN", 0)  # what crosses runs goes in rounds
    assert {r.node: r.component for r in c.components(nodes, links, near).collect()} == want


def test_cycles_within_and_across_runs(spark, monkeypatch):
    rng = random.Random(3)
    items = list(range(600))
    rng.shuffle(items)
    follow, want, i = [], {}, 0
    for size in (1, 2, 3, 14, 80, 500):
        ring = items[i : i + size]
        i += size
        k = ring.index(min(ring))
        for place, v in enumerate(ring[k:] + ring[:k]):
            want[v] = (min(ring), place, size)
        follow += [(v, ring[(j + 1) % size]) for j, v in enumerate(ring)]
    df = spark.createDataFrame(follow, "item long, next long")
    rows = lambda out: {r["item"]: (r["cycle"], r["place"], r["size"]) for r in out.collect()}
    assert rows(c.cycles(df.coalesce(1))) == want
    assert rows(c.cycles(df, lambda k: [F.floor(k / 50), k])) == want
    calls, real = [], routing.written
    monkeypatch.setattr(c, "written", lambda df: calls.append(1) or real(df))
    assert rows(c.cycles(df.coalesce(1))) == want and len(calls) <= 2


def test_empty(spark):
    nodes, links = spark.createDataFrame([], "node long"), spark.createDataFrame([], "a long, b long")
    assert c.components(nodes, links).collect() == []
    assert c.cycles(spark.createDataFrame([], "item long, next long")).collect() == []
