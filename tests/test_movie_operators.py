"""Suppression by rounds, nearest cells and movie files against plain code."""

import numpy as np
import pytest

from glimmer.operators import footprints as G
from glimmer.operators import peaks as P
from glimmer.sources import movies
from tests.test_queries import tif_bytes


def planted_peaks(n, side, seed, step=None):
    """Peaks at different pixels of a frame, with values that tie if ``step`` is given."""
    rng = np.random.default_rng(seed)
    place = rng.choice(side * side, n, replace=False)
    v = rng.random(n) if step is None else rng.integers(0, step, n) / step
    return [(int(p // side), int(p % side), 0, float(rng.choice([0.4, 1.0, 1.5, 2.5, 4.0, 7.0])), float(x), bool(rng.random() < 0.1)) for p, x in zip(place, v, strict=True)]


@pytest.mark.parametrize(("n", "side", "step", "block"), [(400, 60, None, None), (400, 40, 5, 3), (300, 30, 1, 100), (1, 9, None, None)])
def test_suppression_does_not_depend_on_the_dealing(spark, n, side, step, block):
    rows = planted_peaks(n, side, n + side, step)
    table = spark.createDataFrame(rows, "y int, x int, t int, radius double, v double, old_bg boolean").repartition(3)
    y, x, _, radius, v, old = map(np.array, zip(*rows, strict=True))
    kind = P.suppress(y, x, radius, v, 1.0, 5.0, 1.2, old)
    want = sorted((int(a), int(b), {1: "cell", 2: "background"}[k]) for a, b, k in zip(y, x, kind, strict=True) if k)
    got = P.reduce_peaks(table, 1.0, 5.0, 1.2, block=block).collect()
    assert sorted((r["y"], r["x"], r["kind"]) for r in got) == want
    ranked = sorted(got, key=lambda r: (r["kind"] != "cell", -r["firmness"], r["y"], r["x"]))
    assert [r["segid"] for r in ranked] == list(range(len(got)))
    assert {r["kind"] for r in P.reduce_peaks(table, 1.0, 5.0, 1.2, bg_type="remove").collect()} <= {"cell"}


def test_a_chain_over_many_buckets_is_followed(spark):
    """Each peak would go but for the one before it, over 40 buckets."""
    rows = [(0, 3 * k, 0, 2.0, 1.0 - k / 100, False) for k in range(40)]
    table = spark.createDataFrame(rows, "y int, x int, t int, radius double, v double, old_bg boolean")
    got = sorted(r["x"] for r in P.reduce_peaks(table, 1.0, 5.0, 1.6, block=3).collect())
    assert got == [6 * k for k in range(20)]


def nearest_by_definition(rows):
    out = []
    for k, y, x, r in rows:
        others = [(np.hypot(y - b, x - c), o) for o, b, c, _ in rows if o != k]
        if others:
            d, o = min(others)
            out.append((k, o, round(d / r, 9) if r else None))
    return sorted(out)


@pytest.mark.parametrize("case", ["spread", "cluster", "one place", "two", "one", "none"])
def test_nearest_cells(spark, case):
    rng = np.random.default_rng(4)
    rows = {
        "spread": [(k, int(y), int(x), float(1 + k % 3)) for k, (y, x) in enumerate(rng.integers(0, 500, (150, 2)))],
        "cluster": [(k, int(y), int(x), 2.0) for k, (y, x) in enumerate([*rng.integers(0, 12, (150, 2)).tolist(), [400, 900], [-700, 3], [401, 905]])],
        "one place": [(k, 5, 5, 1.0) for k in range(50)] + [(90, 5, 9, 0.0)],
        "two": [(3, 0, 0, 1.0), (9, 0, 4000, 2.0)], "one": [(3, 1, 1, 1.0)], "none": [],
    }[case]
    got = G.nearest(spark.createDataFrame(rows, "segid int, y int, x int, radius double"))
    assert sorted((r["segid"], r["min_dist_id"], None if r["min_dist"] is None else round(r["min_dist"], 9)) for r in got.collect()) == nearest_by_definition(rows)


def frames_of(df):
    return sorted((r["t"], list(r["px"])) for r in df.collect())


@pytest.mark.parametrize("kind", ["npy", "raw", "tif"])
def test_files_are_read_in_ranges(spark, tmp_path, kind):
    """Several tasks a file, and frame numbers that run on over files."""
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 999, (n, 3, 4)).astype("<u2") for n in (7, 1, 150)]
    for k, one in enumerate(parts):
        path = tmp_path / f"m{k}.{kind}"
        if kind == "npy":
            with path.open("wb") as f:
                np.save(f, one)
        else:
            path.write_bytes(one.tobytes() if kind == "raw" else tif_bytes(one, "><"[k % 2], k % 2))
    want = [(t, page.ravel().astype(float).tolist()) for t, page in enumerate(np.concatenate(parts))]
    options = {"height": 3, "width": 4} if kind == "raw" else {}
    for most in (24, 24 * 3, 1 << 20):
        for path in (f"file://{tmp_path}", f"{tmp_path}/m*.{kind}"):
            found = movies.read_files(spark, path, kind, range_bytes=most, **options)
            assert frames_of(found) == want
    assert movies.read_files(spark, str(tmp_path), kind, range_bytes=72, **options).rdd.getNumPartitions() == 3 + 1 + 50


def test_tif_files_are_copied_once(spark, tmp_path):
    movie = np.arange(60, dtype=np.uint16).reshape(5, 3, 4)
    (tmp_path / "m.tif").write_bytes(tif_bytes(movie, "<", False))
    first = frames_of(movies.read_tif(spark, f"{tmp_path}/m.tif", f"file://{tmp_path}/copy"))
    (tmp_path / "m.tif").unlink()
    (tmp_path / "m.tif").write_bytes(tif_bytes(movie[:1], "<", False))
    assert frames_of(movies.read_tif(spark, f"{tmp_path}/m.tif", f"file://{tmp_path}/copy")) == first and len(first) == 5


def test_wrong_files_are_named(spark, tmp_path):
    np.save(tmp_path / "short.npy", np.zeros((4, 3, 3)))
    whole = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-9])
    np.save(tmp_path / "flat.npy", np.zeros(4))
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.zeros((4, 3, 3))))
    np.save(tmp_path / "none.npy", np.zeros((0, 3, 3)))
    (tmp_path / "odd.raw").write_bytes(b"12345")
    (tmp_path / "empty.npy").write_bytes(b"")
    packed = bytearray(tif_bytes(np.zeros((1, 3, 3), np.uint16), "<", False))
    at = packed.index(b"\x03\x01\x03\x00")  # the tag of the compression
    packed[at + 8] = 5
    (tmp_path / "packed.tif").write_bytes(bytes(packed))
    (tmp_path / "short.tif").write_bytes(tif_bytes(np.zeros((2, 9, 9), np.uint16), "<", False)[:100])
    for name, says in [("short.npy", "shorter"), ("flat.npy", "not a"), ("turned.npy", "Fortran"), ("odd.raw", "no whole number"), ("empty.npy", "not an array"), ("packed.tif", "compressed"), ("short.tif", "shorter"), ("gone.npy", "no such file")]:
        with pytest.raises(Exception, match=says) as error:
            movies.read_files(spark, f"{tmp_path}/{name}", name[-3:], height=1, width=3).count()
        assert name in str(error.value)
    assert movies.read_npy(spark, f"{tmp_path}/none.npy").count() == 0


def test_masks_from_files(spark, tmp_path):
    mask = np.zeros((1, 4, 5), np.uint8)
    mask[0, 1:3, 2:4] = 1
    np.save(tmp_path / "mask.npy", mask)
    rng = np.random.default_rng(0)
    movie = rng.random((6, 4, 5))
    np.save(tmp_path / "m.npy", movie)
    held = movies.mask_of(movies.read_npy(spark, f"{tmp_path}/mask.npy"), 5)
    got = movies.crop_to_mask(movies.pixels(movies.read_npy(spark, f"{tmp_path}/m.npy"), 5), held).collect()
    assert sorted((r["t"], r["y"], r["x"], r["v"]) for r in got) == [(t, y, x, movie[t, y + 1, x + 2]) for t in range(6) for y in range(2) for x in range(2)]


def test_a_mask_governs_means_unit_and_peaks(spark):
    """Against numpy; places off the frame and repeats in the mask do not count, an empty one is an error."""
    from glimmer.operators import normalize as N
    from glimmer.operators import stencils as S

    rng = np.random.default_rng(5)
    movie = rng.normal(size=(7, 5, 6))
    frames = spark.createDataFrame([(t, movie[t].ravel().tolist()) for t in range(7)], "t int, px array<double>")
    inside = rng.random((5, 6)) < 0.5
    places = [(int(y), int(x)) for y, x in zip(*np.nonzero(inside), strict=True)]
    mask = spark.createDataFrame([*places, places[0], (99, 0), (-1, 2)], "y int, x int")
    diff = movie - movie[:, inside].mean(-1)[:, None, None]
    got = N.scalar_stats(N.pixel_moments(frames, 5, 6, mask), mask).first()
    unit = np.sqrt(diff.var(0)[inside].mean())
    assert got["std0"] == pytest.approx(unit) and got["max1"] == pytest.approx(((diff.max(0) - diff.mean(0)) / unit).max())
    space = S.log_scales(movie, [0.8, 1.2])
    want = {tuple(map(int, (y, x, t, ri))) for t, ri, y, x in zip(*np.nonzero((space == S.max_pool(space)) & inside), strict=True)}
    assert {(r["y"], r["x"], r["t"], r["ri"]) for r in P.local_peaks(frames, 5, 6, [0.8, 1.2], mask).collect()} == want
    with pytest.raises(ValueError, match="mask"):
        N.pixel_moments(frames, 5, 6, mask.where("y > 50"))
