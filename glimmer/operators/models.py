"""Two populations fitted tile by tile: cells that answer spikes, and signed backgrounds.

In a temporal solve the footprints are fixed and spikes and background traces are sought; in a
spatial solve the traces are fixed and footprints are sought. The movie is read once per solve, in
the scan's tasks, for the products that the objective needs; a tile's task gets the products of
the components that touch the tile or its halo, and gives out those whose centre it owns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import materialise
from . import algebra as A
from . import time_blocks as B
from . import traces as T
from .algebra import answer, answer_back
from .footprints import tile_members

#: A table of at most so many rows is sent to every task; a larger one is joined.
SENT_ROWS = 2_000_000
CELL, BACKGROUND = "cell", "background"


@dataclass(frozen=True)
class Penalty:
    """Kind and weight for footprints and spikes, the backgrounds' weight, and the two that tie the means."""

    la: tuple[str, float] = ("maxnorm", 0.01)
    lu: tuple[str, float] = ("maxnorm", 0.001)
    lb: float = 1e-4
    bs: float = 0.1
    bt: float = 0.1


def penalty(config: dict, stage: int = 0) -> Penalty:
    """From a configuration: la and lu are {type, factor} or {type, annealing, max}, whose weight
    grows with the stage up to its maximum; lb, bs and bt are numbers."""
    kinds = {"NoPenalty": "none", "L2": "l2", "NonNegativeL1": "nonneg_l1", "MaxNormNonNegativeL1": "maxnorm"}

    def part(one: dict) -> tuple[str, float]:
        if one["type"] not in kinds:
            raise ValueError(f"unknown penalty: {one['type']}")
        if "annealing" in one:
            return kinds[one["type"]], min(stage * one["annealing"], one["max"])
        return kinds[one["type"]], float(one.get("factor", 0.0))

    return Penalty(part(config["la"]), part(config["lu"]), config["lb"], config["bs"], config["bt"])


def response(**given: float) -> np.ndarray:
    """The impulse response as an array, largest about 1."""
    size, fast, slow, scale = T.double_exp(**given)
    t = np.arange(1, size + 1)
    return (np.exp(-t / fast) - np.exp(-t / slow)) / scale


def descend(x: list[np.ndarray], forward: Callable, backward: Callable, prox: Callable, value: Callable, cov, out, dot, nx: int, ny: int, bx: float, by: float, constant: float = 0.0,
            rate: float = 0.5, epochs: int = 1_000, steps: int = 100, tol: float = 1e-4, patience: int = 3, nu: float = 20.0) -> tuple[list[np.ndarray], list[tuple[float, float]]]:
    """Accelerated proximal descent over the arrays ``x``; momentum restarts each epoch, and the
    search ends after ``patience`` epochs without a gain of ``tol``. Returns x and, before the first epoch
    and after each, the reported loss ((loss + constant + penalties) / scale) and sigma."""
    nm = nx * ny + nx + ny
    eta = A.step_size(cov, nx, ny, rate)

    def reported(z: list[np.ndarray]) -> tuple[float, float]:
        loss = A.objective(forward(z), cov, out, dot, nx, ny, bx, by)[0]
        return (loss + constant + value(z)) / nm, float(np.sqrt(np.exp(2 * loss / nm)))

    log, best, waited = [reported(x)], np.inf, 0
    for _ in range(epochs):
        z = x
        t0s = [A.momentum(i, nu) for i in range(steps)]
        for t0, t1 in t0s:
            slope = backward(A.objective(forward(z), cov, out, dot, nx, ny, bx, by)[1])
            new = prox([a - eta * g for a, g in zip(z, slope, strict=True)], eta)
            ahead = [(1 - t0) * a + t0 * b for a, b in zip(x, new, strict=True)]
            x, z = new, [(1 - t1) * b + t1 * w for b, w in zip(new, ahead, strict=True)]
        log.append(reported(x))
        waited = waited + 1 if log[-1][0] > best - tol else 0
        best = min(best, log[-1][0])
        if waited >= patience:
            break
    return x, log


def clipped(footprints: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, segid, y, x, a): footprints within each tile and its halo; the tile table is broadcast (a handful of rows)."""
    m = F.col("margin")
    inside = (F.col("y") >= F.col("y0") - m) & (F.col("y") < F.col("y1") + m) & (F.col("x") >= F.col("x0") - m) & (F.col("x") < F.col("x1") + m)
    return footprints.where("a > 0").join(F.broadcast(tiles), inside).select("tile", "segid", "y", "x", "a")


def regions(tiles: Sequence[tuple], height: int, width: int) -> dict[int, np.ndarray]:
    """Pixel numbers of each tile with its halo."""
    out = {}
    for tile, y0, y1, x0, x1, m in tiles:
        y, x = np.mgrid[max(0, y0 - m) : min(height, y1 + m), max(0, x0 - m) : min(width, x1 + m)]
        out[tile] = (y * width + x).ravel()
    return out


def tile_grams(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tile, i, j, ycov, yout) of sparse rows (tile, segid, y, x, a); ``sizes`` (tile, n) counts the tile's places."""
    side = lambda n: rows.select("tile", F.col("segid").alias(n), "y", "x", F.col("a").alias(f"a{n}"))
    raw = side("i").join(side("j"), ["tile", "y", "x"]).groupBy("tile", "i", "j").agg(F.sum(F.col("ai") * F.col("aj")).alias("raw"))
    means = materialise(rows.groupBy("tile", "segid").agg(F.sum("a").alias("s")).join(F.broadcast(sizes), "tile").select("tile", "segid", "n", (F.col("s") / F.col("n")).alias("m")), "means")
    one = means.select("tile", F.col("segid").alias("i"), F.col("m").alias("mi"), "n")
    two = means.select("tile", F.col("segid").alias("j"), F.col("m").alias("mj"))
    return one.join(two, "tile").join(raw, ["tile", "i", "j"], "left").select(
        "tile", "i", "j", (F.coalesce("raw", F.lit(0.0)) - F.col("n") * F.col("mi") * F.col("mj")).alias("ycov"), (F.col("mi") * F.col("mj")).alias("yout")
    )


def tile_dots(frames: DataFrame, rows: DataFrame, tiles: Sequence[tuple], height: int, width: int) -> DataFrame:
    """(tile, k, t, v): the products of ``frame_dots``, one row each."""
    one = frame_dots(frames, rows, tiles, height, width).select("tile", "t", F.explode(F.arrays_zip("ks", "vs")).alias("one"))
    return one.select("tile", F.col("one.ks").alias("k"), "t", F.col("one.vs").alias("v"))


def frame_dots(frames: DataFrame, rows: DataFrame, tiles: Sequence[tuple], height: int, width: int) -> DataFrame:
    """(tile, t, ks, vs): centred footprints times each frame's pixels in the tile. Up to SENT_ROWS
    weights go to every task and the movie is not shuffled; more of them meet its pixels in a join."""
    places = regions(tiles, height, width)
    if rows.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        from ..sources.movies import pixels

        out = None
        for tile, at in places.items():
            own, px = rows.where(F.col("tile") == tile), pixels(frames, width).where((F.col("y") * width + F.col("x")).between(int(at.min()), int(at.max())))
            one = A.data_product(own, px, len(at)).select(F.lit(tile).alias("tile"), F.col("segid").cast("long").alias("k"), "t", "v")
            out = one if out is None else out.unionByName(one)
        both = out.groupBy("tile", "t").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("one"))
        return both.select("tile", "t", F.col("one.k").alias("ks"), F.col("one.v").alias("vs"))
    held = rows.orderBy("tile", "segid").toPandas()
    weights = {}
    for tile, own in held.groupby("tile"):
        ks, which = np.unique(own["segid"].to_numpy(np.int64), return_inverse=True)
        weights[int(tile)] = (ks, which, (own["y"] * width + own["x"]).to_numpy(), own["a"].to_numpy())
    shared = frames.sparkSession.sparkContext.broadcast((places, weights))

    def run(batches):
        import pyarrow as pa

        own_places, own_weights = shared.value
        stacked = {}
        for tile, (ks, which, at, a) in own_weights.items():
            inside = np.unique(at)  # the pixels that any of the tile's footprints touches
            matrix = np.zeros((len(inside), len(ks)))
            np.add.at(matrix, (np.searchsorted(inside, at), which), a)
            stacked[tile] = (ks, inside, matrix, matrix.sum(0) / len(own_places[tile]))
        for batch in batches:
            t, images = A.images_of(batch, height * width)
            for tile, (ks, inside, matrix, mean) in stacked.items():
                v = images[:, inside] @ matrix - images[:, own_places[tile]].sum(1)[:, None] * mean
                ends = np.arange(len(t) + 1, dtype=np.int32) * len(ks)
                lists = [pa.ListArray.from_arrays(ends, part) for part in (np.tile(ks, len(t)), v.ravel())]
                yield pa.RecordBatch.from_pydict({"tile": np.full(len(t), tile, np.int32), "t": t, "ks": lists[0], "vs": lists[1]})

    return frames.select("t", "px").mapInArrow(run, "tile int, t int, ks array<bigint>, vs array<double>")


def trace_products(frames: DataFrame, traces: DataFrame, members: dict[int, list[int]], tiles: Sequence[tuple], height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """For traces (segid, t, v): (i, j, raw), the sums over time of products of two, and
    (tile, k, p, v), the sums of trace times pixel for a tile's members and places. Every task adds up
    what its frames give; only these sums are shuffled."""
    packed = traces.groupBy("t").agg(F.collect_list("segid").alias("ks"), F.collect_list("v").alias("vs"))
    shared = frames.sparkSession.sparkContext.broadcast((regions(tiles, height, width), members))

    def run(batches):
        import pyarrow as pa

        places, own = shared.value
        names = sorted({k for ks in own.values() for k in ks})
        at = {k: n for n, k in enumerate(names)}
        pairs, dots = np.zeros((len(names), len(names))), {tile: np.zeros((len(ks), len(places[tile]))) for tile, ks in own.items()}
        for batch in batches:
            _, images = A.images_of(batch, height * width)
            values = np.zeros((batch.num_rows, len(names)))
            for row, (ks, vs) in enumerate(zip(batch.column("ks").to_pylist(), batch.column("vs").to_pylist(), strict=True)):
                if ks:
                    kept = [(at[k], v) for k, v in zip(ks, vs, strict=True) if k in at]
                    values[row, [k for k, _ in kept]] = [v for _, v in kept]
            pairs += values.T @ values
            for tile, ks in own.items():
                dots[tile] += values[:, [at[k] for k in ks]].T @ images[:, places[tile]]
        i, j = np.nonzero(pairs)
        if len(i):
            name = np.array(names, np.int64)
            yield pa.RecordBatch.from_pydict({"tile": np.full(len(i), -1, np.int32), "k": name[i], "p": name[j], "v": pairs[i, j]})
        for tile, sums in dots.items():
            k, p = np.nonzero(sums)
            if len(k):
                yield pa.RecordBatch.from_pydict({"tile": np.full(len(k), tile, np.int32), "k": np.array(own[tile], np.int64)[k], "p": places[tile][p].astype(np.int64), "v": sums[k, p]})

    found = frames.join(packed, "t", "left").select("t", "px", "ks", "vs").mapInArrow(run, "tile int, k bigint, p bigint, v double").groupBy("tile", "k", "p").agg(F.sum("v").alias("v"))
    found = materialise(found, "trace-products")  # both parts come from one pass over the movie
    return found.where("tile < 0").select(F.col("k").alias("i"), F.col("p").alias("j"), F.col("v").alias("raw")), found.where("tile >= 0")


_FORM = "tile int, what int, a bigint, b bigint, v double, w double"


def _rows(df: DataFrame, what: int, a: str, b: str, v: str, w: str | None = None) -> DataFrame:
    return df.select("tile", F.lit(what).alias("what"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(v).cast("double").alias("v"), (F.col(w).cast("double") if w else F.lit(0.0)).alias("w"))


def solve_tiles(pairs: DataFrame, dots: DataFrame, members: DataFrame, start: DataFrame | None, places: dict[int, np.ndarray], ny: dict[int, int], kernel: np.ndarray | None, setting: Penalty, epochs: int, steps: int) -> DataFrame:
    """(tile, what, segid, place, v, sigma): per tile the values found for the components it owns
    (what = x) and its log (what = loss, place = epochs so far, 0 before the first).

    ``members`` is (tile, segid, kind, active, weight, size): weight is the sum of the absolute fixed
    values of a background, size that of a component's values over their largest. With a
    ``kernel`` this is the temporal solve: cells' values are spikes before it.
    """
    both = members.withColumn("b", (F.col("kind") == CELL).cast("long") + 2 * F.col("active").cast("long"))
    every = _rows(pairs, 0, "i", "j", "ycov", "yout").unionByName(_rows(dots, 1, "k", "place", "v")).unionByName(_rows(both, 2, "segid", "b", "weight", "size"))
    if start is not None:
        every = every.unionByName(_rows(start, 3, "segid", "place", "v"))

    def run(key, rows):
        import pandas as pd

        tile = int(key[0])
        own = {w: g for w, g in rows.groupby("what")}
        empty = pd.DataFrame(columns=["tile", "what", "segid", "place", "v", "sigma"])
        if 2 not in own or 0 not in own:
            return empty
        people = own[2].sort_values(["b", "a"], key=lambda c: -(c % 2) if c.name == "b" else c)
        cell, active = people["b"].to_numpy() % 2 == 1, people["b"].to_numpy() >= 2
        names = {k: n for n, k in enumerate(people["a"])}
        at = places[tile]
        spot = {p: n for n, p in enumerate(at.tolist())}
        cov, out, dot = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2), np.zeros((len(names), len(at)))
        cov[own[0]["a"].map(names), own[0]["b"].map(names)] = own[0]["v"]
        out[own[0]["a"].map(names), own[0]["b"].map(names)] = own[0]["w"]
        if 1 in own:
            dot[own[1]["a"].map(names), own[1]["b"].map(spot)] = own[1]["v"]
        n, nx, others = int(cell.sum()), len(at), ny[tile]
        tail = len(kernel) - 1 if kernel is not None else 0
        x = [np.zeros((n, nx + tail)), np.zeros((len(names) - n, nx))]
        if 3 in own:
            for k, p, v in zip(own[3]["a"].map(names), own[3]["b"].map(spot), own[3]["v"], strict=True):
                (x[0] if k < n else x[1])[k if k < n else k - n, int(p)] = v
        kind, weight = setting.lu if kernel is not None else setting.la
        fixed_kind, fixed = setting.la if kernel is not None else setting.lu
        fac, ground = weight * others, setting.lb * people["v"].to_numpy()[n:, None]
        bx, by = (setting.bt, setting.bs) if kernel is not None else (setting.bs, setting.bt)
        forward = (lambda z: np.vstack([answer(z[0], kernel), z[1]])) if kernel is not None else (lambda z: np.vstack(z))
        backward = (lambda g: [answer_back(g[:n], kernel), g[n:]]) if kernel is not None else (lambda g: [g[:n], g[n:]])
        low = (lambda v, eta: np.sign(v) * np.maximum(np.abs(v) - ground * eta, 0)) if kernel is not None else (lambda v, eta: np.maximum(v - ground * eta, 0))
        prox = lambda z, eta: [A.prox_rows(kind, z[0], eta, fac), low(z[1], eta)]
        value = lambda z: A.penalty_rows(kind, z[0], fac) + float((ground * (np.abs(z[1]) if kernel is not None else np.maximum(z[1], 0))).sum())
        # the fixed side's own penalty; only the spatial solve scales it by the number of frames
        constant = fixed * people["w"].to_numpy()[:n].sum() * (1 if kernel is not None else others) if fixed_kind != "none" else 0.0
        x, log = descend(x, forward, backward, prox, value, cov, out, dot, nx, others, bx, by, constant, epochs=epochs, steps=steps)
        found = []
        for part, base in ((x[0], 0), (x[1], n)):
            k, p = np.nonzero(part)
            keep = active[base + k]
            k, p = k[keep], p[keep]
            place = p if kernel is not None else at[p]
            found.append(pd.DataFrame({"tile": tile, "what": "x", "segid": people["a"].to_numpy()[base + k], "place": place, "v": part[k, p], "sigma": np.nan}))
        losses = np.array(log)
        found.append(pd.DataFrame({"tile": tile, "what": "loss", "segid": -1, "place": np.arange(len(log)), "v": losses[:, 0], "sigma": losses[:, 1]}))
        return pd.concat(found)

    return every.groupBy("tile").applyInPandas(run, "tile int, what string, segid bigint, place int, v double, sigma double")


def tile_frame(spark: SparkSession, tiles: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(map(int, t)) for t in tiles], "tile int, y0 int, y1 int, x0 int, x1 int, margin int")


def temporal(frames: DataFrame, cells: DataFrame, footprints: DataFrame, tiles: Sequence[tuple], height: int, width: int, count: int, setting: Penalty, kernel: np.ndarray | None = None, epochs: int = 1_000, steps: int = 100, block: int | None = None) -> DataFrame:
    """Spikes of cells (place = u) and traces of backgrounds (place = t) for footprints (segid, y, x,
    a) of ``cells`` (segid, kind, y, x); ``frames`` is the normalised movie of ``count`` frames.
    Components that touch no tile, or have no weight, have no values. A movie of more than ``block`` frames (by the tile's components, if None) is
    dealt to all tasks by blocks of time with the same result, so that no task holds all its frames."""
    kernel = response() if kernel is None else kernel
    spark, places = frames.sparkSession, regions(tiles, height, width)
    table = tile_frame(spark, tiles)
    # written, as the Gram matrix, the members and the products read it: plans that held it each time filled the driver
    rows = materialise(clipped(footprints, table), "clipped")
    sizes = spark.createDataFrame([(t, len(at)) for t, at in places.items()], "tile int, n int")
    sums = rows.groupBy("tile", "segid").agg(F.sum("a").alias("weight"), F.coalesce(F.try_divide(F.sum("a"), F.max("a")), F.lit(0.0)).alias("size"))
    members = materialise(tile_members(footprints, cells, table).join(cells.select("segid", "kind"), "segid").join(sums, ["tile", "segid"]), "members")
    # only the spatial solve scales the fixed side's penalty by the number of frames
    fixed = setting.la[1] if setting.la[0] != "none" else 0.0
    return B.solve(tile_grams(rows, sizes), frame_dots(frames, rows, tiles, height, width), members, count, {t: len(at) for t, at in places.items()}, kernel, CELL,
                   setting.lu, fixed, setting.lb, setting.bt, setting.bs, block, epochs, steps)


def spatial(frames: DataFrame, cells: DataFrame, footprints: DataFrame, spikes: DataFrame, grounds: DataFrame, tiles: Sequence[tuple], height: int, width: int, count: int, setting: Penalty, epochs: int = 1_000, steps: int = 100) -> DataFrame:
    """Footprints (place = pixel number) for fixed spikes (segid, u, v) and background traces (segid,
    t, v), each over its largest value; the search starts from ``footprints``. Components without a
    positive value in their trace have none."""
    spark, places = frames.sparkSession, regions(tiles, height, width)
    size = T.double_exp()[0]
    spikes = materialise(spikes, "trains")
    calcium = T.spike_to_calcium(spikes.withColumnRenamed("segid", "spkid"), T.kernel(spark), size, count).withColumnRenamed("spkid", "segid")
    # written once, as all that follows reads them again: plans that held them each time filled the driver
    raw = materialise(calcium.unionByName(grounds.select("segid", "t", "v")), "traces")
    tops = raw.groupBy("segid").agg(F.max("v").alias("top")).where("top > 0")
    scaled = raw.join(tops, "segid").select("segid", "t", (F.col("v") / F.col("top")).alias("v"))
    trains = spikes.groupBy("segid").agg(F.try_divide(F.sum("v"), F.max("v")).alias("size"))
    means = materialise(scaled.groupBy("segid").agg((F.sum("v") / count).alias("m"), F.sum(F.abs("v")).alias("weight")).join(trains, "segid", "left").fillna({"size": 0.0}), "means")
    table = tile_frame(spark, tiles)
    people = materialise(tile_members(footprints, cells, table).join(cells.select("segid", "kind"), "segid").join(means, "segid"), "people")
    listed: dict[int, list[int]] = {}
    for row in people.select("tile", "segid").orderBy("tile", "segid").collect():  # names of components, as many as a stage has
        listed.setdefault(row["tile"], []).append(row["segid"])
    pairs, dots = trace_products(frames, scaled, listed, tiles, height, width)
    one = people.select("tile", F.col("segid").alias("i"), F.col("m").alias("mi"))
    two = people.select("tile", F.col("segid").alias("j"), F.col("m").alias("mj"))
    grams = one.join(two, "tile").join(pairs, ["i", "j"], "left").select(
        "tile", "i", "j", (F.coalesce("raw", F.lit(0.0)) - count * F.col("mi") * F.col("mj")).alias("ycov"), (F.col("mi") * F.col("mj")).alias("yout")
    )
    # the normalised movie's pixels have zero means, so that centring the traces changes nothing here
    start = materialise(clipped(footprints, table).join(people.select("tile", "segid"), ["tile", "segid"], "left_semi").select("tile", "segid", (F.col("y") * width + F.col("x")).alias("place"), F.col("a").alias("v")), "start")
    return solve_tiles(materialise(grams, "grams"), dots.withColumnRenamed("p", "place"), people, start, places, {t: count for t in places}, None, setting, epochs, steps)


def preset(name: str) -> dict:
    """A configuration by name: ``zero``, ``a<A>u<U>`` or ``annealing_a<A>u<U>``. A is in thousandths
    and U in ten-thousandths; annealed weights grow by a tenth of the maximum a stage, of u always and
    of a where it is 100."""
    if name == "zero":
        none = {"type": "MaxNormNonNegativeL1", "factor": 0.0}
        return {"la": none, "lu": none, "lb": 0.0, "bs": 0.0, "bt": 0.0}
    annealed = name.startswith("annealing_")
    a, u = name.removeprefix("annealing_")[1:].split("u")
    grow = lambda most, wanted: {"type": "MaxNormNonNegativeL1"} | ({"annealing": most / 10, "max": most} if wanted else {"factor": most})
    return {"la": grow(int(a) / 1_000, annealed and a == "100"), "lu": grow(int(u) / 10_000, annealed), "lb": 1e-4, "bs": 0.1, "bt": 0.1}
