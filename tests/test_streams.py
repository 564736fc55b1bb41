"""Streams batch by batch against the same work on tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import normalize as N
from glimmer.streaming import running as R


def write_movie(spark, folder, batches):
    """A file a batch of frames (t, px), in the order given."""
    for i, frames in enumerate(batches):
        spark.createDataFrame(frames, "t int, px array<double>").coalesce(1).write.mode("append").parquet(f"{folder}/movie.parquet")


def test_after_every_batch_the_moments_are_those_of_the_frames_so_far(spark, tmp_path):
    """Frames arrive out of order, some null or of another size."""
    rng = np.random.default_rng(1)
    frames = [(t, rng.normal(size=12).tolist()) for t in range(9)] + [(9, None), (10, [1.0, 2.0])]
    write_movie(spark, f"file://{tmp_path}", [[frames[i] for i in part] for part in ([5, 6, 9], [0, 1, 2, 10], [8, 7, 3, 4])])
    changed = R.changes(R.movie_moments(R.read_stream(spark, f"file://{tmp_path}", "movie", 1), 3, 4), spark).collect()
    last = max(r["batch"] for r in changed)
    assert last == 2
    sent = [5, 6], [5, 6, 0, 1, 2], list(range(9))
    for batch, ts in enumerate(sent):
        table = spark.createDataFrame([frames[t] for t in ts], "t int, px array<double>")
        want = {(r["y"], r["x"]): r for r in N.pixel_moments(table, 3, 4).collect()}
        got = {(r["y"], r["x"]): r for r in changed if r["batch"] == batch}
        assert got.keys() == want.keys()
        for place, row in want.items():
            for name in ("avgx", "var", "high", "low", "vmin", "vmax", "icor"):
                assert got[place][name] == pytest.approx(row[name], rel=1e-9, abs=1e-12)


def test_the_latest_row_of_each_key_is_the_state(spark, tmp_path):
    """A key that no later batch touches keeps its row; windows drop late rows only under a watermark."""
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n, 5)
    for rows in ([(1, 1, 2.0, day(9)), (2, 2, 5.0, day(9))], [(3, 1, 4.0, day(20))], [(4, 3, 1.0, day(1))]):
        spark.createDataFrame(rows, "event_id long, user_id int, value double, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    read = lambda: R.read_stream(spark, f"file://{tmp_path}", "events", 1)
    got = {r["user_id"]: (r["n"], r["total"]) for r in R.drain(R.running_stats(read()), spark, "user_id").collect()}
    assert got == {1: (2, 6.0), 2: (1, 5.0), 3: (1, 1.0)}
    days = lambda found: sorted(r["d"] for r in found.select(F.dayofmonth("w.start").alias("d")).collect())
    assert days(R.drain(R.hourly(read(), None), spark, "w")) == [1, 9, 20]
    assert days(R.drain(R.hourly(read()), spark)) == [9]


def test_an_empty_table_has_no_state(spark, tmp_path):
    spark.createDataFrame([], "t int, px array<double>").write.parquet(f"file://{tmp_path}/movie.parquet")
    assert not R.drain(R.movie_moments(R.read_stream(spark, f"file://{tmp_path}", "movie"), 3, 4), spark, "y", "x").collect()
