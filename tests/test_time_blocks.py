"""The temporal solve by blocks of time against the solve in one task, and the step size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import algebra as A
from glimmer.operators import models as V
from glimmer.operators import peaks as P
from glimmer.operators import time_blocks as B

from .test_stages import COUNT, SIDE, planted  # noqa: F401


def solved(planted, block, tiles, **given):  # noqa: F811
    frames, cells, weights, *_ = planted
    rows = V.temporal(frames, cells, weights, tiles, SIDE, SIDE, COUNT, V.penalty(V.preset(given.pop("config", "a1u1"))), block=block, **given).collect()
    values = {(r["tile"], r["segid"], r["place"]): r["v"] for r in rows if r["what"] == "x"}
    return values, {(r["tile"], r["place"]): (r["v"], r["sigma"]) for r in rows if r["what"] == "loss"}


@pytest.mark.parametrize("block", [20, 70])
def test_blocks_of_time_do_not_change_the_solve(planted, block):  # noqa: F811
    """Eight blocks whose halo reaches over several others, and three of uneven length."""
    tiles = P.tiles(SIDE, SIDE, 1, 2, 3)
    (want, log), (got, logged) = (solved(planted, n, tiles, epochs=3, steps=4) for n in (COUNT, block))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)
    assert {k[1] for k in got} == {0, 1, 2, 3, 4} and {t for t, _ in logged} == {0, 1}
    assert max(place for _, _, place in got) >= COUNT  # spikes after the last frame are sought as well
    assert log.keys() == logged.keys() and all(np.allclose(log[k], logged[k]) for k in log)


def test_tiles_end_on_their_own(planted):  # noqa: F811
    """A tile that gains less than the tolerance ends by patience, in both forms at the same epoch."""
    frames, cells, weights, *_ = planted
    tiles = P.tiles(SIDE, SIDE, 1, 2, 3)
    table = V.tile_frame(frames.sparkSession, tiles)
    rows = V.clipped(weights, table)
    places = {t: len(at) for t, at in V.regions(tiles, SIDE, SIDE).items()}
    sizes = frames.sparkSession.createDataFrame(list(places.items()), "tile int, n int")
    members = V.tile_members(weights, cells, table).join(cells.select("segid", "kind"), "segid").withColumns({"weight": F.lit(1.0), "size": F.lit(1.0)})
    members = members.where("tile = 0 or kind = 'background'")  # the second tile has no cell, only the background
    give = (V.tile_grams(rows.join(members, ["tile", "segid"], "left_semi"), sizes), V.frame_dots(frames, rows.join(members, ["tile", "segid"], "left_semi"), tiles, SIDE, SIDE), members)
    out = B.solve(*give, COUNT, places, V.response(), V.CELL, ("maxnorm", 0.001), 0.0, 1e-4, 0.1, 0.1, 64, 3, 2, tol=10.0, patience=1).collect()
    assert {r["place"] for r in out if r["what"] == "loss"} == {0, 1, 2}  # one gain from nothing, then one wait
    assert {r["segid"] for r in out if r["what"] == "x" and r["tile"] == 1} <= {4}


def test_nothing_to_solve_gives_no_rows(planted):  # noqa: F811
    frames, cells, weights, *_ = planted
    assert V.temporal(frames, cells, weights.where("segid < 0"), P.tiles(SIDE, SIDE, 1, 1, 0), SIDE, SIDE, COUNT, V.Penalty(), block=50, epochs=1, steps=1).count() == 0


@pytest.mark.parametrize("kind", ["l1", "nonneg_l1", "l2", "maxnorm", "none"])
def test_every_penalty_by_blocks(planted, kind):  # noqa: F811
    frames, cells, weights, *_ = planted
    setting = V.Penalty(lu=(kind, 0.01))
    one, cut = ({(r["what"], r["segid"], r["place"]): r["v"] for r in V.temporal(frames, cells, weights, [(0, 0, SIDE, 0, SIDE, 0)], SIDE, SIDE, COUNT, setting, epochs=1, steps=2, block=n).collect()} for n in (COUNT, 80))
    assert one.keys() == cut.keys() and all(abs(one[k] - cut[k]) < 1e-9 for k in one)


def test_largest_eigenvalue():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        rows = rng.normal(size=(n, 2 * n))
        square = rows @ rows.T
        assert A.largest_eigenvalue(square) == pytest.approx(np.linalg.eigvalsh(square)[-1], rel=1e-6)
    assert A.largest_eigenvalue(np.eye(5) * 3) == pytest.approx(3)
    assert [A.largest_eigenvalue(m) for m in (np.zeros((0, 0)), np.zeros((3, 3)), np.full((2, 2), np.nan), np.array([[np.inf]]))] == [1.0] * 4


@pytest.mark.parametrize("block", [10, COUNT])
def test_blocks_equal_the_dense_solve(planted, block):  # noqa: F811
    """Several blocks a task, and one block, against the dense descent over the whole time line."""
    frames, cells, weights, *_ = planted
    spark, tiles, setting = frames.sparkSession, P.tiles(SIDE, SIDE, 1, 2, 3), V.penalty(V.preset("a1u1"))
    table, places, time = V.tile_frame(spark, tiles), V.regions(tiles, SIDE, SIDE), np.arange(COUNT)
    rows = V.clipped(weights, table)
    sums = rows.groupBy("tile", "segid").agg(F.sum("a").alias("weight"), (F.sum("a") / F.max("a")).alias("size"))
    members = V.tile_members(weights, cells, table).join(cells.select("segid", "kind"), "segid").join(sums, ["tile", "segid"])
    sizes = spark.createDataFrame([(t, len(at)) for t, at in places.items()], "tile int, n int")
    dots = V.tile_dots(frames, rows, tiles, SIDE, SIDE).withColumnRenamed("t", "place")
    dense = V.solve_tiles(V.tile_grams(rows, sizes), dots, members, None, {t: time for t in places}, {t: len(at) for t, at in places.items()}, V.response(), setting, 2, 3).collect()
    want = {(r["tile"], r["segid"], r["place"]): r["v"] for r in dense if r["what"] == "x"}
    got, log = solved(planted, block, tiles, epochs=2, steps=3)
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)
    assert all(np.allclose((r["v"], r["sigma"]), log[r["tile"], r["place"]]) for r in dense if r["what"] == "loss")


def test_answers_by_bands_equal_convolution():
    rng = np.random.default_rng(5)
    for places, rows, wide in ((200, 3, 32), (20, 2, 32), (83, 1, 16), (19, 4, 8), (60, 0, 32)):
        spikes, kernel = rng.normal(size=(rows, places)), rng.normal(size=19)
        assert np.allclose(A.answer_places(spikes.T, kernel, wide), A.answer(spikes, kernel).T)


def test_a_long_time_line_of_few_components_needs_no_blocks(spark, monkeypatch):
    """Its values fit a task, so that no step waits for a round of a barrier."""
    count, written = 140_000, []
    monkeypatch.setattr(B, "materialise", lambda df, name, own=B.materialise: written.append(name) or own(df, name))
    frames = spark.range(count).select(F.col("id").cast("int").alias("t"), F.array(*[F.sin(F.col("id") / (5 + k)) for k in range(4)]).alias("px"))
    cells = spark.createDataFrame([(0, "cell", 0, 0)], "segid int, kind string, y int, x int")
    weights = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 0.5)], "segid int, y int, x int, a double")
    rows = V.temporal(frames, cells, weights, [(0, 0, 2, 0, 2, 0)], 2, 2, count, V.Penalty(), epochs=1, steps=2)
    found = rows.collect()
    assert [r["place"] for r in found if r["what"] == "loss"] == [0, 1] and "values" not in written
    assert max(r["place"] for r in found) > 139_000


def test_answers_by_chunks_equal_convolution(monkeypatch):
    rng = np.random.default_rng(6)
    for count, rows, length in ((2_500, 3, 20), (1_030, 2, 33), (300, 1, 70), (10, 2, 20), (50, 0, 20), (40, 1, 1)):
        kernel = rng.normal(size=length)
        cut, spikes, slopes = B.Cut(count, count, 0, length - 1), rng.normal(size=(rows, count + length - 1)), rng.normal(size=(rows, count))
        answer, places = B.Answer(kernel, rows, cut), B.Chunks(rows, count + length - 1, cut.chunk)
        monkeypatch.setattr(B, "HELD", 0)  # the others lie in files
        frames, out = B.Chunks(rows, count + length - 1, cut.chunk), [np.zeros((rows, count)), np.zeros((rows, count + length - 1))]
        monkeypatch.undo()
        places.put(0, spikes)
        frames.put(0, slopes)
        empty = np.zeros((rows, answer.band))
        for c, here, there in places.parts(0, count + length - 1):
            after = places.v[c + 1][:, : answer.band] if c + 1 < len(places.v) else empty
            before = frames.v[c - 1][:, cut.chunk - answer.band :] if c else empty
            out[1][:, there] = answer.back(np.concatenate([before, frames.v[c]], 1))[:, here]
            first = np.array(answer.forward(np.concatenate([places.v[c], after], 1)))[:, here]
            out[0][:, there.start : there.stop] = first[:, : max(0, count - there.start)]
        assert np.allclose(out[0], A.answer(spikes, kernel)) and np.allclose(out[1], A.answer_back(slopes, kernel))
        assert np.allclose(places.cut(3, count).take(0, count - 3), spikes[:, 3:count])


@pytest.mark.parametrize("kind", ["maxnorm", "l2"])
def test_several_chunks_equal_the_dense_descent(kind):
    rng = np.random.default_rng(7)
    count, n, grounds, ny, kernel = 2_300, 4, 2, 9, V.response()
    k, tail = n + grounds, len(kernel) - 1
    feet = np.maximum(rng.normal(size=(k, ny)), 0)
    mean = feet.mean(1)
    cov, out = feet @ feet.T - ny * np.outer(mean, mean), np.outer(mean, mean)
    dot, ground = (feet - mean[:, None]) @ rng.normal(size=(ny, count)), np.array([1e-3, 2e-3])
    fac, eta = 0.01 * ny, A.step_size(cov, count, ny, 0.5)
    low = lambda v, eta: np.sign(v) * np.maximum(np.abs(v) - ground[:, None] * eta, 0)
    x, log = V.descend(
        [np.zeros((n, count + tail)), np.zeros((grounds, count))], lambda z: np.vstack([A.answer(z[0], kernel), z[1]]), lambda g: [A.answer_back(g[:n], kernel), g[n:]],
        lambda z, eta: [A.prox_rows(kind, z[0], eta, fac), low(z[1], eta)], lambda z: A.penalty_rows(kind, z[0], fac) + float((ground[:, None] * np.abs(z[1])).sum()),
        cov, out, dot, count, ny, 0.1, 0.2, 1.0, epochs=2, steps=4,
    )
    cut = B.Cut(count, count, 0, tail)
    task, data = B.Task(cut, kernel, {0: ny}, kind, 0.01, 0.1, 0.2), B.Chunks(k, count + tail, cut.chunk)
    data.put(0, dot)
    row = {"tile": 0, "block": 0, "ks": np.arange(k), "active": np.ones(k, bool), "cells": n, "constant": 1.0, "eta": eta, "ground": ground, "cov": cov.ravel(), "gram": (cov + ny * 0.1 * out).ravel()}
    part = B.Part(task, row, data, [])
    part.movie = part.summed / count
    for epoch in range(3):
        for i in range(4 if epoch else 0):
            part.land(part.slope(part.products()), *A.momentum(i))
        part.narrow(tail)
        assert np.allclose(part.reported(part.products(), *part.penalties()), log[epoch], rtol=1e-10)
    assert np.allclose(part.x.take(0, count + tail)[:n], x[0], rtol=1e-9, atol=1e-12) and np.allclose(part.x.take(0, count)[n:], x[1], rtol=1e-9, atol=1e-12)
