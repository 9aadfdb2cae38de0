"""Routes walk back through whole blocks, not hop by hop."""

from atrium.operators import routing


def test_rounds_grow_with_blocks_not_with_hops(spark, monkeypatch):
    n = 120
    there = spark.range(n - 1).selectExpr("id src", "id + 1 dst", "concat('e', id) edge_id", "1.0D weight", "1.0D metres", "1.0D seconds")
    edges = routing.written(there.unionByName(there.selectExpr("dst src", "src dst", "edge_id", "weight", "metres", "seconds")))
    block_of = spark.range(n).selectExpr("id node", "concat('b', cast(floor(id / 40) as string)) block")
    starts = spark.createDataFrame([(1, 0, 0.0), (2, 119, 0.0)], "search_id long, node long, extra double")
    goals = spark.createDataFrame([(1, 1, 119, 0.0), (2, 1, 119, 0.0), (3, 1, 5, 0.0), (4, 2, 30, 0.0), (5, 3, 7, 0.0)], "query_id long, search_id long, node long, extra double")
    entered = routing.Entered(starts, edges, block_of)
    found = routing.written(routing.routes(entered.labels(goals), goals))
    calls, real = [], routing.written
    monkeypatch.setattr(routing, "written", lambda df: calls.append(1) or real(df))
    got = sorted(tuple(r) for r in entered.paths(found).select("query_id", "ord", "node", "edge_id").collect())
    assert len(calls) <= 8
    monkeypatch.undo()
    settled = routing.written(entered.labels())
    want = {(q, i, a + s * i, None if i == 0 else f"e{min(a + s * i, a + s * (i - 1))}") for q, a, s, hops in ((1, 0, 1, 119), (2, 0, 1, 119), (3, 0, 1, 5), (4, 119, -1, 89)) for i in range(hops + 1)}
    assert set(got) == want and len(got) == len(want)
    short = routing.paths(settled, found.filter("query_id = 3")).select("query_id", "ord", "node", "edge_id").collect()
    assert sorted(map(tuple, short)) == [g for g in got if g[0] == 3]
