"""The query of ladders reads the whole table of strokes."""

import __spark_entry__ as entry


def test_query_reads_every_stroke(spark, tmp_path):
    """Five strokes in a row whose ids are no multiples of five."""
    spark.createDataFrame([(1 + 500 * k, 3 * k, 0, 4, 25.0) for k in range(1, 6)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    ids = {(1 + 500 * k) * 8 + 4 for k in range(1, 6)}
    assert any(i % 5 for i in ids)
    got = {r.stroke_id for r in entry.queries()["d4_ladders"](spark, str(tmp_path)).collect()}
    assert got == ids
