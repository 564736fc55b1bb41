"""Matrix products as join-aggregates, the fit's objective, penalties and one descent step.

A matrix is a table of its entries. With rows y_k over n places, mean m_k and centred rows,
the objective needs only three products: the centred Gram matrix, the outer product of the
means, and the centred rows times the data; the movie is read once for them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gram(rows: DataFrame, n: int, key: str = "segid") -> DataFrame:
    """(i, j, ycov, yout) of sparse rows (key, y, x, a) over ``n`` places: entries that are absent are zero,
    so the centred product is the raw one minus n times the means. Pairs without a common place follow from the means."""
    a = rows.select(F.col(key).alias("i"), "y", "x", F.col("a").alias("ai"))
    b = rows.select(F.col(key).alias("j"), "y", "x", F.col("a").alias("aj"))
    raw = a.join(b, ["y", "x"]).groupBy("i", "j").agg(F.sum(F.col("ai") * F.col("aj")).alias("raw"))
    means = rows.groupBy(F.col(key).alias("k")).agg((F.sum("a") / n).alias("m"))
    return _all_pairs(means).join(raw, ["i", "j"], "left").select(
        "i", "j", (F.coalesce("raw", F.lit(0.0)) - n * F.col("mi") * F.col("mj")).alias("ycov"), (F.col("mi") * F.col("mj")).alias("yout")
    )


def _all_pairs(means: DataFrame, blocks: int = 16) -> DataFrame:
    """The result of a Gram matrix has a row for every pair; rows meet block by block."""
    left = means.select(F.col("k").alias("i"), F.col("m").alias("mi"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    return left.join(means.select(F.col("k").alias("j"), F.col("m").alias("mj"), F.pmod(F.hash("k"), F.lit(blocks)).alias("b")), "b").drop("b")


def data_product(rows: DataFrame, pixels: DataFrame, n: int, key: str = "segid") -> DataFrame:
    """(key, t, v): centred rows times each frame, as the raw product minus the mean times the frame's sum."""
    means = rows.groupBy(key).agg((F.sum("a") / n).alias("m"))
    sums = pixels.groupBy("t").agg(F.sum("v").alias("s"))
    raw = rows.join(pixels, ["y", "x"]).groupBy(key, "t").agg(F.sum(F.col("a") * F.col("v")).alias("raw"))
    return raw.join(means, key).join(sums, "t").select(key, "t", (F.col("raw") - F.col("m") * F.col("s")).alias("v"))


def reconstruct(footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """(t, y, x, v): the sum over components of footprint times trace."""
    return footprints.join(traces.withColumnRenamed("v", "c"), "segid").groupBy("t", "y", "x").agg(F.sum(F.col("a") * F.col("c")).alias("v"))


def variance(ycov: DataFrame, yout: DataFrame, ydot: DataFrame, x: DataFrame, nx: int, ny: int, bx: float, by: float) -> DataFrame:
    """One row (v, loss, sigma) of the objective for traces x(k, t, v) over nx places.

    D = sum(ycov * xx) - 2 sum(ydot * xc) + nx ny; the penalty weighs the means; loss is
    (nm / 2)(ln V - ln nm) and sigma sqrt(V / nm) with nm = nx ny + nx + ny."""
    centred = x.join(x.groupBy("k").agg((F.sum("v") / nx).alias("m")), "k").withColumn("c", F.col("v") - F.col("m"))
    xx = outer_sums(centred.select("k", "t", F.col("c").alias("v")))
    means = centred.select("k", "m").distinct()
    pair = ycov.join(yout, ["i", "j"]).join(xx, ["i", "j"], "left").join(means.select(F.col("k").alias("i"), F.col("m").alias("mi")), "i").join(means.select(F.col("k").alias("j"), F.col("m").alias("mj")), "j")
    first = pair.agg(
        F.sum(F.col("ycov") * F.col("xx")).alias("p1"), F.sum(F.col("yout") * F.col("xx")).alias("p2"), F.sum(F.col("ycov") * F.col("mi") * F.col("mj")).alias("p3")
    )
    dot = ydot.join(centred.select("k", "t", "c"), ["k", "t"]).agg(F.sum(F.col("v") * F.col("c")).alias("d"))
    nm = nx * ny + nx + ny
    v = F.col("p1") - 2 * F.col("d") + nx * ny + ny * bx * F.col("p2") + nx * by * F.col("p3")
    return first.crossJoin(F.broadcast(dot)).select(v.alias("v")).withColumns({"loss": F.lit(nm / 2) * (F.ln("v") - F.ln(F.lit(float(nm)))), "sigma": F.sqrt(F.col("v") / nm)})


def outer_sums(rows: DataFrame) -> DataFrame:
    """(i, j, xx): the sums over t of products of two rows (k, t, v). Rows meet by t once; every task
    adds up its places, and only one sum a pair and task is shuffled."""
    kind = rows.schema["k"].dataType.simpleString()
    packed = rows.groupBy("t").agg(F.collect_list("k").alias("ks"), F.collect_list("v").alias("vs"))

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            ks, vs = batch.column("ks"), batch.column("vs")
            names, spots = np.unique(ks.flatten().to_numpy(), return_inverse=True)
            dense = np.zeros((batch.num_rows, len(names)))
            dense[np.repeat(np.arange(batch.num_rows), np.diff(ks.offsets.to_numpy())), spots] = vs.flatten().to_numpy(zero_copy_only=False)
            part = dense.T @ dense
            old = sums.get("names")
            if old is None:
                sums = {"names": names, "part": part}
            else:
                both = np.union1d(old, names)
                grown = np.zeros((len(both), len(both)))
                for n, p in ((old, sums["part"]), (names, part)):
                    at = np.searchsorted(both, n)
                    grown[np.ix_(at, at)] += p
                sums = {"names": both, "part": grown}
        if sums:
            n = len(sums["names"])
            yield pa.RecordBatch.from_pydict({"i": np.repeat(sums["names"], n), "j": np.tile(sums["names"], n), "xx": sums["part"].ravel()})

    return packed.select("ks", "vs").mapInArrow(run, f"i {kind}, j {kind}, xx double").groupBy("i", "j").agg(F.sum("xx").alias("xx"))


def step(pairs: DataFrame, dots: DataFrame, x: DataFrame, v: DataFrame, nx: int, ny: int, bx: float, by: float, eta: float, fac: float, number: int) -> DataFrame:
    """(k, t, new, z): one accelerated proximal step of the objective from x(k, t, v), dense over nx places,
    with the non-negative L1 penalty; ``pairs`` (i, j, ycov, yout), ``dots`` (k, t, v), ``v`` one row
    with the objective's V at x."""
    nm = nx * ny + nx + ny
    means = x.groupBy("k").agg((F.sum("v") / nx).alias("m"))
    centred = x.join(means, "k").select(F.col("k").alias("j"), "t", (F.col("v") - F.col("m")).alias("c"))
    mixed = pairs.join(centred, "j").groupBy(F.col("i").alias("k"), "t").agg(F.sum((F.col("ycov") + ny * bx * F.col("yout")) * F.col("c")).alias("lin"))
    tied = pairs.join(means.withColumnRenamed("k", "j"), "j").groupBy(F.col("i").alias("k")).agg(F.sum(F.col("ycov") * F.col("m")).alias("tied"))
    level = dots.groupBy("k").agg((F.sum("v") / nx).alias("level"))
    slope = 2 * (F.col("lin") - (F.col("dot") - F.col("level"))) + 2 * by * F.col("tied")
    every = x.join(mixed, ["k", "t"]).join(dots.withColumnRenamed("v", "dot"), ["k", "t"]).join(level, "k").join(tied, "k").crossJoin(F.broadcast(v.select(F.col("v").alias("big"))))
    moved = every.withColumn("y", F.col("v") - eta * nm / (2 * F.col("big")) * slope).withColumn("new", prox("nonneg_l1", F.col("y"), eta, fac))
    t0, t1 = momentum(number)
    return moved.select("k", "t", "new", ((1 - t1) * F.col("new") + t1 * ((1 - t0) * F.col("v") + t0 * F.col("new"))).alias("z"))


def prox(kind: str, y: Column, eta: float, fac: float, row: str = "id") -> Column:
    """The proximal step of a penalty; ``maxnorm`` needs the row's largest value, by a window over ``row``."""
    zero = F.lit(0.0)
    if kind == "none":
        return y
    if kind == "l2":
        return y / (1 + fac * eta)
    if kind == "nonneg_l2":
        return F.greatest(y, zero) / (1 + fac * eta)
    if kind == "l1":
        return F.signum(y) * F.greatest(F.abs(y) - fac * eta, zero)
    if kind == "nonneg_l1":
        return F.greatest(y - fac * eta, zero)
    if kind == "maxnorm":
        p = F.greatest(y, zero)
        top = F.max(p).over(Window.partitionBy(row))
        return F.greatest(F.when(p == top, p).otherwise(p - F.try_divide(F.lit(fac * eta), top)), zero)
    raise ValueError(f"unknown penalty: {kind}")


def penalty(kind: str, rows: DataFrame, fac: float, row: str = "id") -> DataFrame:
    """One row (value): the penalty of a matrix (row, v)."""
    v, p = F.col("v"), F.greatest(F.col("v"), F.lit(0.0))
    if kind in ("l2", "nonneg_l2"):
        return rows.agg(F.sum(F.pow(fac * v, 2)).alias("value"))
    if kind == "l1":
        return rows.agg(F.sum(F.abs(fac * v)).alias("value"))
    if kind == "nonneg_l1":
        return rows.agg(F.sum(fac * p).alias("value"))
    if kind == "maxnorm":
        each = rows.groupBy(row).agg(F.try_divide(F.sum(fac * p), F.nullif(F.max(p), F.lit(0.0))).alias("q"))
        return each.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("value"))
    if kind == "none":
        return rows.agg(F.lit(0.0).alias("value"))
    raise ValueError(f"unknown penalty: {kind}")


def momentum(step: int, nu: float = 20.0) -> tuple[float, float]:
    """Weights of the accelerated step, 0-based within an epoch."""
    return (nu + step) / nu, (nu + 1) / (nu + step + 1)


def images_of(batch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and pixels (frame, place) of an Arrow batch of packed frames; a frame that is null or
    has other than ``size`` pixels is an error, as no product could be right."""
    import pyarrow.compute as pc

    px = batch.column("px")
    if px.null_count or (len(px) and not pc.all(pc.equal(pc.list_value_length(px), size)).as_py()):
        raise ValueError(f"a frame does not have {size} pixels")
    return batch.column("t").to_numpy(), px.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


# ---- dense kernels of a tile's solve (matrices of components by places) ----


def objective(x: np.ndarray, ycov: np.ndarray, yout: np.ndarray, ydot: np.ndarray, nx: int, ny: int, bx: float, by: float) -> tuple[float, np.ndarray]:
    """The loss and its gradient in x (components, places)."""
    m = x.mean(1)
    c = x - m[:, None]
    xx, nm = c @ c.T, nx * ny + nx + ny
    v = (ycov * xx).sum() - 2 * (ydot * c).sum() + nx * ny + ny * bx * (yout * xx).sum() + nx * by * (ycov * np.outer(m, m)).sum()
    dot = ydot - ydot.mean(1, keepdims=True)
    dv = 2 * ((ycov + ny * bx * yout) @ c - dot) + 2 * by * (ycov @ m)[:, None]
    return nm / 2 * (np.log(v) - np.log(nm)), nm / (2 * v) * dv


def answer(spikes: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """(row, frame): what spikes over len(kernel) - 1 more places give."""
    return np.stack([np.convolve(row, kernel, "valid") for row in spikes]) if len(spikes) else np.zeros((0, spikes.shape[1] - len(kernel) + 1))


def answer_back(gradient: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The transpose of ``answer``."""
    return np.stack([np.convolve(row, kernel[::-1], "full") for row in gradient]) if len(gradient) else np.zeros((0, gradient.shape[1] + len(kernel) - 1))


def answer_places(spikes: np.ndarray, kernel: np.ndarray, wide: int = 32) -> np.ndarray:
    """``answer`` of spikes (place, row) as (frame, row): bands of the kernel times ``wide`` frames at a time."""
    spikes = np.ascontiguousarray(spikes, float)
    tail, n = len(kernel) - 1, spikes.shape[1]
    count = len(spikes) - tail
    band = np.zeros((wide, wide + tail))
    for k in range(wide):
        band[k, k : k + tail + 1] = kernel[::-1]
    out, full = np.empty((count, n)), count // wide
    if full:
        place, one = spikes.strides
        windows = np.lib.stride_tricks.as_strided(spikes, (full, wide + tail, n), (wide * place, place, one), writeable=False)
        np.matmul(band, windows, out=out[: full * wide].reshape(full, wide, n))
    rest = count - full * wide
    out[full * wide :] = band[:rest, : rest + tail] @ spikes[full * wide :]
    return out


def largest_eigenvalue(matrix: np.ndarray, rounds: int = 2_000, tol: float = 1e-13) -> float:
    """Of a symmetric matrix without negative eigenvalues, by power iteration; 1 if it is empty, zero or has values that are not finite."""
    if not len(matrix) or not np.isfinite(matrix).all():
        return 1.0
    v, top = np.random.default_rng(0).normal(size=len(matrix)), 0.0
    for _ in range(rounds):
        v /= np.linalg.norm(v)
        w = matrix @ v
        last, top = top, float(v @ w)
        if not np.any(w) or abs(top - last) <= tol * abs(top):
            break
        v = w
    return top if top > 0 else 1.0


def step_size(ycov: np.ndarray, nx: int, ny: int, rate: float) -> float:
    """The step of a solve over nx places, from the largest curvature of the products of the fixed side."""
    nm = nx * ny + nx + ny
    return rate / (largest_eigenvalue(ycov) / nx) / nm


def prox_rows(kind: str, y: np.ndarray, eta: float, fac: float, top: np.ndarray | None = None) -> np.ndarray:
    """The proximal step of rows; ``top`` are their largest values where ``y`` is only a part of them."""
    if kind == "l1":
        return np.sign(y) * np.maximum(np.abs(y) - fac * eta, 0)
    if kind == "nonneg_l1":
        return np.maximum(y - fac * eta, 0)
    if kind == "l2":
        return y / (1 + fac * eta)
    if kind == "nonneg_l2":
        return np.maximum(y, 0) / (1 + fac * eta)
    if kind == "maxnorm":
        p = np.maximum(y, 0)
        top = p.max(1, keepdims=True, initial=0) if top is None else top[:, None]
        return np.maximum(np.where(p == top, p, p - fac * eta / np.where(top > 0, top, 1)), 0)
    if kind == "none":
        return y
    raise ValueError(f"unknown penalty: {kind}")


def penalty_rows(kind: str, x: np.ndarray, fac: float) -> float:
    if kind == "l1":
        return float(np.abs(fac * x).sum())
    p = np.maximum(x, 0)
    if kind == "nonneg_l1":
        return float((fac * p).sum())
    if kind in ("l2", "nonneg_l2"):
        return float(((fac * x) ** 2).sum())
    if kind == "maxnorm":
        top = p.max(1, initial=0)
        return float((fac * p.sum(1)[top > 0] / top[top > 0]).sum())
    if kind == "none":
        return 0.0
    raise ValueError(f"unknown penalty: {kind}")
