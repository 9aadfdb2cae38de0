"""Parts of a path come from each segment's own length, not from a difference of sums."""

from atrium.operators import trips


def test_whole_steps_on_a_long_path(spark):
    df = spark.createDataFrame([(1, i, 0.0, 0.2 * (i % 2)) for i in range(400)], "path_id int, ord int, x double, y double")
    assert trips.densified(trips.arc_lengths(df), 0.1).count() == 1 + 399 * 2
