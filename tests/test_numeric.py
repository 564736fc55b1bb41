"""Numeric kernels against plain loops, finite differences and planted truth; no Spark."""

import numpy as np
import pytest

from glimmer.operators import algebra as A
from glimmer.operators import models as M
from glimmer.operators import stencils as S
from glimmer.operators.peaks import radii, suppress, tiles
from glimmer.operators.traces import double_exp


def blob(h, w, y, x, sigma):
    yy, xx = np.mgrid[:h, :w]
    return np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * sigma**2))


def loop_convolve(image, wy, wx):
    n, m = len(wy) // 2, len(wx) // 2
    out = np.zeros_like(image)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            for a in range(-n, n + 1):
                for b in range(-m, m + 1):
                    if 0 <= y - a < image.shape[0] and 0 <= x - b < image.shape[1]:
                        out[y, x] += wy[a + n] * wx[b + m] * image[y - a, x - b]
    return out


def test_gaussian_and_log_match_loops():
    image = np.random.default_rng(0).normal(size=(9, 11))
    g, s = S.taps(1.2), S.taps(1.2, True)
    assert np.allclose(S.gaussian(image[None], 1.2)[0], loop_convolve(image, g, g))
    assert np.allclose(S.log_filter(image[None], 1.2)[0], loop_convolve(image, s, g) + loop_convolve(image, g, s))


def test_one_blob_peaks_at_its_place_and_scale():
    scales = radii("logscale", 2, 4.5, 5)
    space = S.log_scales(blob(31, 31, 15, 14, 3.0)[None], scales)[0]
    ri, y, x = np.unravel_index(space.argmax(), space.shape)
    assert (y, x) == (15, 14) and abs(scales[ri] - 3) < 0.5


def test_max_pool_and_closing_match_loops():
    image = np.random.default_rng(1).normal(size=(1, 3, 7, 6))
    pooled = S.max_pool(image)
    for r, y, x in np.ndindex(3, 7, 6):
        assert pooled[0, r, y, x] == image[0, max(0, r - 1) : r + 2, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max()
    flat = image[0]
    closed = S.grey_closing(flat, 4)
    assert (closed >= flat - 1e-12).all()
    wide = np.array([[[flat[k, max(0, y - 1) : y + 3, max(0, x - 1) : x + 3].max() for x in range(6)] for y in range(7)] for k in range(3)])
    want = np.array([[[wide[k, max(0, y - 2) : y + 2, max(0, x - 2) : x + 2].min() for x in range(6)] for y in range(7)] for k in range(3)])
    assert np.allclose(closed, want)


def test_neighbor_mean_divides_by_eight_at_edges():
    image = np.ones((1, 4, 4))
    out = S.neighbor_mean(image)[0]
    assert out[0, 0] == pytest.approx(3 / 8) and out[1, 1] == pytest.approx(1) and out[0, 1] == pytest.approx(5 / 8)


def test_region_descends_and_does_not_wrap():
    image = np.array([[3.0, 2, 0, 5], [2, 1, -1, 1], [0, 0, 0, 0]])
    assert S.region(image, 0, 0).tolist() == [[True, True, False, False], [True, True, False, False], [False] * 4]


def test_suppression_boundaries():
    y, x, v = np.array([0.0, 0, 0]), np.array([0.0, 4, 9]), np.array([3.0, 2, 1])
    assert suppress(y, x, np.full(3, 2.0), v, 1, 8, 2).tolist() == [1, 0, 1]  # a distance equal to the ratio is dropped
    assert suppress(y, x, np.array([2.0, 9, 0.5]), v, 1, 8, 1).tolist() == [1, 2, 0]


def test_tiles_cover_and_part_the_frame():
    for h, w, rows, columns, m in ((20, 31, 2, 3, 2), (8, 8, 1, 1, 0), (8, 8, 2, 2, 1)):
        held = np.zeros((h, w), int)
        for _, y0, y1, x0, x1, _ in tiles(h, w, rows, columns, m):
            held[y0:y1, x0:x1] += 1
        assert (held == 1).all()


def test_response_peaks_at_one():
    size, fast, slow, scale = double_exp()
    t = np.linspace(0.01, 20, 20000)
    assert size == 20 and ((np.exp(-t / fast) - np.exp(-t / slow)) / scale).max() == pytest.approx(1, abs=1e-4)


def problem(seed=0, k=3, nx=12, ny=9):
    rng = np.random.default_rng(seed)
    y = np.abs(rng.normal(size=(k, ny)))
    data = rng.normal(size=(ny, nx))
    m = y.mean(1)
    c = y - m[:, None]
    return rng.normal(size=(k, nx)), c @ c.T, np.outer(m, m), c @ data, nx, ny


def test_gradient_matches_finite_differences():
    x, cov, out, dot, nx, ny = problem()
    loss, gradient = A.objective(x, cov, out, dot, nx, ny, 0.1, 0.2)
    for at in ((0, 0), (1, 5), (2, 11)):
        moved = x.copy()
        moved[at] += 1e-6
        assert (A.objective(moved, cov, out, dot, nx, ny, 0.1, 0.2)[0] - loss) / 1e-6 == pytest.approx(gradient[at], rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("kind", ["l1", "nonneg_l1", "maxnorm"])
def test_prox_lowers_its_objective(kind):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(4, 6)) * 3
    if kind == "maxnorm":
        new = A.prox_rows(kind, y, 0.5, 0.4)
        assert (new >= 0).all() and np.allclose(new.max(1), np.maximum(y, 0).max(1))
        return
    value = lambda z: 0.5 * ((z - y) ** 2).sum() + 0.5 * A.penalty_rows(kind, z, 0.4)
    best = A.prox_rows(kind, y, 0.5, 0.4)
    for _ in range(200):
        other = best + rng.normal(size=y.shape) * 0.05
        if kind == "nonneg_l1":
            other = np.maximum(other, 0)
        assert value(best) <= value(other) + 1e-9


def test_fit_recovers_planted_traces():
    rng = np.random.default_rng(5)
    feet = np.zeros((3, 80))
    for k in range(3):
        feet[k, k * 25 : k * 25 + 20] = 1
    truth = np.where(rng.random((3, 150)) < 0.1, rng.random((3, 150)) + 0.5, 0)
    data = feet.T @ truth
    data = data - data.mean(0)
    data = data - data.mean(1, keepdims=True)
    data /= np.sqrt((data**2).mean())
    m = feet.mean(1)
    c = feet - m[:, None]
    prox = lambda z, eta: [A.prox_rows("nonneg_l1", z[0], eta, 1e-3)]
    value = lambda z: A.penalty_rows("nonneg_l1", z[0], 1e-3)
    (x,), log = M.descend([np.zeros((3, 150))], lambda z: z[0], lambda g: [g], prox, value, c @ c.T, np.outer(m, m), c @ data, 150, 80, 0.01, 0.01, rate=0.5, epochs=60, steps=20)
    losses = [loss for loss, _ in log]
    assert min(losses) == losses[-1] or losses[-1] - min(losses) < 1e-3
    assert min(np.corrcoef(x[k], truth[k])[0, 1] for k in range(3)) > 0.95


def test_answer_and_its_transpose():
    rng = np.random.default_rng(2)
    kernel = M.response()
    spikes, traces = rng.random((3, 60)), rng.normal(size=(3, 60 - len(kernel) + 1))
    want = [[sum(kernel[j] * row[t + len(kernel) - 1 - j] for j in range(len(kernel))) for t in range(traces.shape[1])] for row in spikes]
    assert np.allclose(M.answer(spikes, kernel), want)
    assert (M.answer(spikes, kernel) * traces).sum() == pytest.approx((spikes * M.answer_back(traces, kernel)).sum())


def test_two_population_gradient_matches_finite_differences():
    """The objective of spikes behind the response and of signed traces, in both parts."""
    rng = np.random.default_rng(7)
    kernel, nx, ny = M.response(duration=0.3), 30, 50
    feet = rng.random((3, ny))
    m = feet.mean(1)
    c = feet - m[:, None]
    dot, cov, out = c @ rng.normal(size=(ny, nx)), c @ c.T, np.outer(m, m)
    x = [rng.random((2, nx + len(kernel) - 1)), rng.normal(size=(1, nx))]
    z = lambda x: np.vstack([M.answer(x[0], kernel), x[1]])
    loss, slope = A.objective(z(x), cov, out, dot, nx, ny, 0.1, 0.2)
    back = [M.answer_back(slope[:2], kernel), slope[2:]]
    for part, at in ((0, (0, 0)), (0, (1, 20)), (1, (0, 3))):
        moved = [a.copy() for a in x]
        moved[part][at] += 1e-6
        assert (A.objective(z(moved), cov, out, dot, nx, ny, 0.1, 0.2)[0] - loss) / 1e-6 == pytest.approx(back[part][at], rel=1e-3, abs=1e-4)


def test_penalties_and_presets():
    assert M.penalty(M.preset("a10u10")) == M.Penalty()
    assert M.penalty(M.preset("annealing_a10u5"), 3).lu == ("maxnorm", pytest.approx(0.00015)) and M.penalty(M.preset("annealing_a10u5"), 30).lu[1] == 0.0005
    assert M.penalty(M.preset("annealing_a100u10"), 2).la[1] == pytest.approx(0.02) and M.penalty(M.preset("zero")).lb == 0
    other = M.penalty(M.preset("a1u1") | {"la": {"type": "NoPenalty"}, "lu": {"type": "L2", "factor": 2}})
    assert other.la == ("none", 0.0) and other.lu == ("l2", 2.0)
    with pytest.raises(ValueError):
        M.penalty(M.preset("a1u1") | {"la": {"type": "other"}})


def test_old_backgrounds_stay_backgrounds():
    y, x, radius, v = (np.array(a, float) for a in ([0, 10, 10], [0, 0, 1], [2, 2, 2], [3, 2, 1]))
    assert suppress(y, x, radius, v, 1, 5, 1.2).tolist() == [1, 1, 0]
    assert suppress(y, x, radius, v, 1, 5, 1.2, np.array([False, True, False])).tolist() == [1, 2, 1]


def test_penalties_by_kind():
    y = np.array([[-1.0, 2.0]])
    assert A.prox_rows("nonneg_l2", y, 0.5, 2.0).tolist() == [[0.0, 1.0]] and A.penalty_rows("nonneg_l2", np.array([[0.0, 2.0]]), 0.5) == 1.0
    assert A.prox_rows("none", y, 0.5, 2.0) is y and A.penalty_rows("none", y, 2.0) == 0.0
    for f in (lambda: A.prox_rows("l3", y, 0.5, 2.0), lambda: A.penalty_rows("l3", y, 2.0)):
        with pytest.raises(ValueError, match="unknown penalty"):
            f()


def test_the_log_starts_before_the_first_epoch():
    rng = np.random.default_rng(1)
    data, a = rng.normal(size=(20, 50)), rng.random((2, 20))
    m = a.mean(1)
    c = a - m[:, None]
    prox, value = (lambda z, eta: [A.prox_rows("nonneg_l1", z[0], eta, 1e-3)]), (lambda z: A.penalty_rows("nonneg_l1", z[0], 1e-3))
    run = lambda n: M.descend([np.zeros((2, 50))], lambda z: z[0], lambda g: [g], prox, value, c @ c.T, np.outer(m, m), c @ data, 50, 20, 0.0, 0.0, epochs=n, steps=5)[1]
    nm = 50 * 20 + 50 + 20
    assert np.isclose(run(0)[0][0], 0.5 * (np.log(50 * 20) - np.log(nm))) and len(run(3)) == 4 and run(3)[3][0] < run(3)[0][0]


def test_kernels_of_a_table_of_settings(spark):
    from glimmer.operators import traces as T

    rows = [("a", 0.08, 0.16, 1.0, 20.0), ("b", 0.3, 0.1, 0.45, 20.0), ("c", None, 0.1, 1.0, 20.0), ("d", 0.1, 0.1, 1.0, 20.0), ("e", -0.1, 0.1, 1.0, 20.0)]
    got = T.kernels(spark.createDataFrame(rows, "name string, tau1 double, tau2 double, duration double, hz double"), "name").collect()
    assert {r["name"] for r in got} == {"a", "b"}
    for name, *given in rows[:2]:
        want = [r["w"] for r in T.kernel(spark, **dict(zip(("tau1", "tau2", "duration", "hz"), given, strict=True))).orderBy("j").collect()]
        assert np.allclose([r["w"] for r in sorted((r for r in got if r["name"] == name), key=lambda r: r["j"])], want)
