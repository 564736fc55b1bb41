"""Solves by tile on a planted movie, trace conversion, numbering, and odd frames and peaks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import classify as C
from glimmer.operators import footprints as G
from glimmer.operators import models as V
from glimmer.operators import peaks as P
from glimmer.operators import stencils as S

SIDE, COUNT = 20, 160


@pytest.fixture(scope="module")
def planted(spark):
    """Four cells, one in each quarter, and a wide signed background, as a normalised movie."""
    rng = np.random.default_rng(1)
    kernel = V.response()
    yy, xx = np.mgrid[:SIDE, :SIDE]
    centres = [(4, 4), (4, 15), (15, 4), (15, 15), (10, 10)]
    feet = np.stack([np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s**2)) for (y, x), s in zip(centres, (1.5, 1.5, 1.5, 1.5, 5.0))])
    feet[feet < 0.2] = 0
    spikes = np.where(rng.random((4, COUNT + len(kernel) - 1)) < 0.06, 1 + rng.random((4, COUNT + len(kernel) - 1)), 0)
    trace = np.sin(np.arange(COUNT) / 9)
    movie = np.einsum("kt,kyx->tyx", np.vstack([V.answer(spikes, kernel), trace]), feet).reshape(COUNT, -1) + rng.normal(size=(COUNT, SIDE * SIDE)) * 0.05
    movie -= movie.mean(1, keepdims=True)
    movie -= movie.mean(0)
    movie /= np.sqrt((movie**2).mean())
    frames = spark.createDataFrame([(t, px.tolist()) for t, px in enumerate(movie)], "t int, px array<double>").repartition(3)
    cells = spark.createDataFrame([(k, "cell" if k < 4 else "background", y, x) for k, (y, x) in enumerate(centres)], "segid int, kind string, y int, x int")
    weights = spark.createDataFrame([(k, int(y), int(x), float(feet[k, y, x])) for k in range(5) for y, x in zip(*np.nonzero(feet[k]))], "segid int, y int, x int, a double")
    return frames, cells, weights, feet, spikes, trace


def test_solves_by_tile_recover_a_planted_movie(spark, planted):
    frames, cells, weights, feet, spikes, trace = planted
    tiles = P.tiles(SIDE, SIDE, 2, 2, 3)
    setting = V.penalty(V.preset("a1u1"))
    rows = V.temporal(frames, cells, weights, tiles, SIDE, SIDE, COUNT, setting, epochs=60, steps=20).collect()
    assert {r["tile"] for r in rows if r["what"] == "loss"} == {0, 1, 2, 3}  # several groups, each with its own log
    for tile in range(4):
        log = [r["v"] for r in sorted((r for r in rows if r["what"] == "loss" and r["tile"] == tile), key=lambda r: r["place"])]
        assert log[-1] <= log[0]
    assert len({(r["segid"], r["tile"]) for r in rows if r["what"] == "x"}) == 5  # each component comes from the tile that owns it
    found = np.zeros((5, spikes.shape[1]))
    for r in rows:
        if r["what"] == "x":
            found[r["segid"], r["place"]] = r["v"]
    kernel = V.response()
    for k in range(4):
        assert np.corrcoef(V.answer(found[k : k + 1], kernel)[0], V.answer(spikes[k : k + 1], kernel)[0])[0, 1] > 0.9 and found[k].min() >= 0
    assert np.corrcoef(found[4, :COUNT], trace)[0, 1] > 0.8
    trains = spark.createDataFrame([(k, int(u), float(spikes[k, u])) for k in range(4) for u in np.flatnonzero(spikes[k])], "segid int, u int, v double")
    grounds = spark.createDataFrame([(4, t, float(v)) for t, v in enumerate(trace)], "segid int, t int, v double")
    shaped = V.spatial(frames, cells, weights, trains, grounds, tiles, SIDE, SIDE, COUNT, setting, epochs=60, steps=20).where("what = 'x'").collect()
    image = np.zeros((5, SIDE * SIDE))
    for r in shaped:
        image[r["segid"], r["place"]] = r["v"]
    for k in range(4):
        assert np.corrcoef(image[k], feet[k].ravel())[0, 1] > 0.9 and image[k].min() >= 0


def test_traces_of_a_spatial_solve_are_computed_once(spark, planted):
    frames, cells, weights, _, spikes, _ = planted
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    at = [(k, int(u), float(spikes[k, u])) for k in range(4) for u in np.flatnonzero(spikes[k])]
    grounds = [(4, t, float(np.sin(t / 9))) for t in range(COUNT)]
    counted = lambda rows, form: spark.createDataFrame(rows, form).mapInArrow(through, form)
    shaped = V.spatial(frames, cells, weights, counted(at, "segid int, u int, v double"), counted(grounds, "segid int, t int, v double"), P.tiles(SIDE, SIDE, 2, 2, 3), SIDE, SIDE, COUNT, V.penalty(V.preset("a1u1")), epochs=1, steps=1)
    assert {r["segid"] for r in shaped.where("what = 'x'").collect()} == set(range(5))
    assert seen.value == len(at) + len(grounds)


def test_dots_do_not_depend_on_how_weights_reach_the_movie(planted, monkeypatch):
    frames, _, weights, _, _, _ = planted
    tiles = [(0, 0, SIDE, 0, SIDE, 0)]
    rows = weights.withColumn("tile", F.lit(0))
    get = lambda: {(r["k"], r["t"]): r["v"] for r in V.tile_dots(frames, rows, tiles, SIDE, SIDE).collect()}
    sent = get()
    monkeypatch.setattr(V, "SENT_ROWS", 10)
    joined = get()
    assert sent.keys() == joined.keys() and np.allclose([sent[k] for k in sent], [joined[k] for k in sent])


def test_products_need_whole_frames(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 1.0)], "tile int, segid int, y int, x int, a double")
    frames = spark.createDataFrame([(0, [1.0, 2.0])], "t int, px array<double>")
    with pytest.raises(Exception, match="does not have 4 pixels"):
        V.tile_dots(frames, rows, [(0, 0, 2, 0, 2, 0)], 2, 2).collect()


def test_kinds_are_converted_with_their_traces(spark):
    from glimmer.plans.stages import converted

    fixed = spark.createDataFrame([(0, "cell", "cell"), (1, "background", "cell"), (2, "cell", "background"), (3, "background", "background")], "segid int, kind string, old_kind string")
    kernel, n = V.response(), 50
    spikes = spark.createDataFrame([(0, 30, 2.0), (1, 40, 3.0)], "segid int, u int, v double")
    grounds = spark.createDataFrame([(3, 5, -1.0), *((2, t, float(v)) for t, v in enumerate(np.r_[np.zeros(10), kernel, np.zeros(20)]))], "segid int, t int, v double")
    trains, traces = (df.collect() for df in converted(fixed, spikes, grounds, n))
    assert {r["segid"] for r in trains} == {0, 2} and {r["segid"] for r in traces} == {1, 3}
    got = {r["t"]: r["v"] for r in traces if r["segid"] == 1}
    assert all(got[21 + j] == pytest.approx(3 * kernel[j]) for j in range(20))
    top = max((r for r in trains if r["segid"] == 2), key=lambda r: r["v"])
    # the row's least value, here below zero where the response is cut off, is added
    assert top["v"] == pytest.approx(1.0, abs=0.01) and top["u"] == 10 + len(kernel) - 1
    numbered = {r["segid"]: (r["spkid"], r["bgid"]) for r in C.renumber(fixed).collect()}
    assert numbered == {0: (0, -1), 2: (1, -1), 3: (-1, 0), 1: (-1, 1)}  # those of the kind before, then converted ones


def test_survivors_keep_their_spike_rows(spark):
    rows = spark.createDataFrame([(0, "cell", 1.0), (1, "cell", None), (2, "cell", 2.0), (3, "background", None)], "segid int, kind string, signal double")
    got = {r["segid"]: (r["kind"], r["spkid"], r["bgid"]) for r in C.silent_to_remove(rows).collect()}
    assert got == {0: ("cell", 0, -1), 1: ("remove", -1, -1), 2: ("cell", 2, -1), 3: ("background", -1, 0)}


def test_remove_mode_keeps_cells_only(spark):
    rows = spark.createDataFrame([(0, "cell", 9.0), (1, "cell", 1.0), (2, "background", 1.0)], "segid int, kind string, mah double")
    assert [r["kind"] for r in C.fix_kind(rows, {"mah": 4.0}, {}, "remove").orderBy("segid").collect()] == ["remove", "cell", "remove"]
    wide = C.rules("ratio3z4", 2.1, 15.9)
    assert wide["to_background"] == {"radius": 15.9, "aratio": 3.0, "mah": 4.0} and wide["to_cell"] == {"bmax": 10.0, "bsparse": 10.0}


def test_null_and_ragged_frames_have_no_rows(spark):
    frames = spark.createDataFrame([(0, [1.0] * 4), (1, None), (2, [5.0] * 8), (3, [2.0] * 4), (4, [])], "t int, px array<double>").coalesce(1)
    rows = S.image_map(frames, 2, 2, lambda i: i).collect()
    assert sorted((r["t"], r["v"]) for r in rows) == [(0, 1.0)] * 4 + [(3, 2.0)] * 4
    assert S.image_map(frames.where("t = 1"), 2, 2, lambda i: i).count() == 0
    peaks = spark.createDataFrame([(0, 1, 0, 0, 1.0), (1, 9, 0, 0, 1.0), (2, 0, 1, 1, 1.0)], "segid int, t int, y int, x int, radius double")
    assert {r["segid"] for r in G.grow(frames, peaks, 2, 2).collect()} == {2}


def test_no_peaks_give_no_peaks(spark):
    none = spark.createDataFrame([], "y int, x int, t int, radius double, v double")
    assert P.reduce_peaks(none, 1, 4, 1.2).count() == 0
    unknown = spark.createDataFrame([(1, 1, 0, None, None)], "y int, x int, t int, radius double, v double")
    assert P.reduce_peaks(unknown, 1, 4, 1.2).count() == 0


def test_statistics_of_a_stage_are_planned_in_parts(spark, capsys):
    from glimmer.plans.stages import COLUMNS, evaluate

    lacking = [c for c in COLUMNS if c not in ("kind", "segid", "firmness", "old_kind", "spkid", "bgid", "signal", "udense", "unz", "rsn", "zrsn", "hypot", "mah", "bmax", "bsparse")]
    kinds = ["cell"] * 4 + ["background"]
    cells = spark.createDataFrame([(k, kind, 1.0 + k * k) for k, kind in enumerate(kinds)], "segid int, kind string, firmness double").withColumns({c: F.lit(0) for c in lacking})
    spikes = spark.createDataFrame([(k, u, float(1 + u ** (k + 1))) for k in range(3) for u in range(9)], "segid int, u int, v double")  # cell 3 is silent
    found = evaluate(cells, spikes, spark.createDataFrame([(4, t, t - 3.0) for t in range(9)], "segid int, t int, v double"), 9)
    rows = {r["segid"]: r for r in found.collect()}
    assert [rows[k]["kind"] for k in range(5)] == ["cell", "cell", "cell", "remove", "background"] and rows[4]["bmax"] == 5.0
    assert all(rows[k]["mah"] is not None and rows[k]["hypot"] is not None for k in range(3)) and rows[3]["mah"] is None
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("Exchange") < 10  # levels, scores and statistics come from files


def test_cleaning_runs_once_a_stage(spark, planted, monkeypatch, tmp_path):
    from glimmer.plans import stages as L

    seen = []
    monkeypatch.setattr(L, "cleaned", lambda *given, own=L.cleaned: seen.append(0) or own(*given))
    monkeypatch.setattr(L, "EPOCHS", 1)
    monkeypatch.setattr(L, "STEPS", 1)
    monkeypatch.setattr(L.store, "shared_dir", lambda spark: f"file://{tmp_path}")
    made = L.run_stages(spark, "/root/testdata/sf0.001")
    assert len(made["footprints"]) == 2 and len(seen) == 1
