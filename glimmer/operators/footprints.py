"""Footprints: regions around peaks with weights in 0..1, kept as rows of positive weight."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import aspect
from ..sources.store import materialise
from .stencils import by_frame, grey_closing, log_filter, region, rescaled


def at_peaks(frames: DataFrame, peaks: DataFrame, height: int, width: int, work, schema: str) -> DataFrame:
    """``work(segid, image, y, x)`` for every peak (segid, t, y, x, radius) on its frame filtered at its
    radius; it returns a dict of columns without segid. Only frames that have peaks are read on;
    peaks on frames that are null, ragged or missing have no rows."""
    wanted = peaks.groupBy("t").agg(F.collect_list(F.struct("segid", "y", "x", "radius")).alias("own"))
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for px, own in zip(batch.column("px").to_pylist(), batch.column("own").to_pylist(), strict=True):
                if px is None or len(px) != height * width:
                    continue
                image = np.array(px, float).reshape(1, height, width)
                for peak in own:
                    found = work(log_filter(image, peak["radius"])[0], peak["y"], peak["x"])
                    for n, values in found.items():
                        out[n].append(values)
                    out["segid"].append(np.full(len(next(iter(found.values()))), peak["segid"], np.int32))
            if out["segid"]:
                yield pa.RecordBatch.from_pydict({n: np.concatenate(c) for n, c in out.items()})

    return frames.join(wanted, "t").select("px", "own").mapInArrow(run, schema)


def grow(frames: DataFrame, peaks: DataFrame, height: int, width: int) -> DataFrame:
    """(segid, y, x, v): the region that grows from every peak on its filtered frame."""

    def work(image, y, x):
        ys, xs = np.nonzero(region(image, y, x))
        return {"y": ys.astype(np.int32), "x": xs.astype(np.int32), "v": image[ys, xs]}

    return at_peaks(frames, peaks, height, width, work, "segid int, y int, x int, v double")


def make_footprints(frames: DataFrame, peaks: DataFrame, height: int, width: int, closing: int = 10) -> DataFrame:
    """(segid, y, x, a > 0): per peak, its frame filtered at its radius, grown from its place, brought
    to 0..1 and closed. A region of one value has no weight and no rows."""

    def work(image, y, x):
        closed = grey_closing(rescaled(image, region(image, y, x)), closing)
        ys, xs = np.nonzero(closed > 0)
        return {"y": ys.astype(np.int32), "x": xs.astype(np.int32), "a": closed[ys, xs]}

    return at_peaks(frames, peaks, height, width, work, "segid int, y int, x int, a double")


def clean_footprints(footprints: DataFrame, height: int, width: int, radii: list[float], closing: int) -> DataFrame:
    """(segid, y, x, a, cy, cx, radius, firmness): every footprint divided by its largest weight,
    filtered at all scales, and grown again from the best place over scales and pixels."""

    def run(rows):
        import pandas as pd

        image = np.zeros((height, width))
        image[rows["y"], rows["x"]] = rows["a"]
        if image.max() > 0:
            image /= image.max()
        space = np.stack([log_filter(image, r) for r in radii])
        ri, cy, cx = np.unravel_index(space.argmax(), space.shape)
        closed = grey_closing(rescaled(space[ri], region(space[ri], cy, cx)), closing)
        y, x = np.nonzero(closed > 0)
        return pd.DataFrame({"segid": rows["segid"].iloc[0], "y": y, "x": x, "a": closed[y, x], "cy": cy, "cx": cx, "radius": radii[ri], "firmness": space[ri, cy, cx]})

    return footprints.groupBy("segid").applyInPandas(run, "segid int, y int, x int, a double, cy int, cx int, radius double, firmness double")


def positive_parts(pixels: DataFrame, key: str = "t") -> DataFrame:
    """footprints(segid, y, x, a > 0): the positive part of every frame, over the frame's maximum."""
    top = pixels.groupBy(key).agg(F.max("v").alias("top")).where("top > 0")
    return pixels.where("v > 0").join(top, key).select(F.col(key).alias("segid"), "y", "x", (F.col("v") / F.col("top")).alias("a"))


def positive_frames(frames: DataFrame, width: int) -> DataFrame:
    """The same of packed frames, within the row: no shuffle."""
    top = frames.select(F.col("t").alias("segid"), F.array_max("px").alias("top"), F.posexplode("px").alias("p", "v"))
    return top.where("v > 0").select("segid", (F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), (F.col("v") / F.col("top")).alias("a"))


def densify(footprints: DataFrame, height: int, width: int) -> DataFrame:
    """(segid, px): every footprint as a packed image, zero where it has no weight."""
    size = height * width
    held = footprints.groupBy("segid").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * width + F.col("x")).cast("int"), F.col("a")))).alias("m"))
    return held.select("segid", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(F.element_at("m", p), F.lit(0.0))).alias("px"))


def measures(footprints: DataFrame) -> DataFrame:
    """(segid, asum, area, aratio)."""
    return footprints.groupBy("segid").agg(
        F.sum("a").alias("asum"), F.count(F.when(F.col("a") > 0, 1)).alias("area"), aspect(F.col("y"), F.col("x"), F.col("a")).alias("aratio")
    )


def centres(footprints: DataFrame) -> DataFrame:
    """(segid, y, x): where each footprint is largest; ties go to the least y, then x."""
    top = footprints.groupBy("segid").agg(F.max(F.struct("a", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("b"))
    return top.select("segid", (-F.col("b.y")).alias("y"), (-F.col("b.x")).alias("x"))


def nearest(cells: DataFrame) -> DataFrame:
    """(segid, min_dist_id, min_dist): the nearest other cell, its distance in units of the cell's own
    radius; ties go to the least id. A cell alone has no row; without a positive radius the distance is null.

    Cells look for others in their own and the eight grid buckets around. A distance of at most the
    bucket's side is final, as what was not seen is farther; only cells still without one go on with
    buckets four times as wide. These are apart from each other, so a bucket has few that ask. Of
    cells at one place two can be the answer, and only these are looked through."""
    near = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    there = cells.select(F.col("segid").alias("o"), F.col("y").alias("oy"), F.col("x").alias("ox")).where("oy is not null and ox is not null")
    least = F.row_number().over(Window.partitionBy("oy", "ox").orderBy("o"))
    there = materialise(there.withColumn("n", least).where("n <= 2").drop("n"), "places")
    extent = there.agg(F.max(F.abs("oy")) + F.max(F.abs("ox"))).first()[0] or 0.0
    open_, found, side = materialise(cells.select("segid", "y", "x", "radius").where("y is not null and x is not null"), "asking"), None, 1.0
    while True:
        last = side > 2 * extent + 1
        around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
        asks = open_.withColumn("by", F.explode(F.transform(around, lambda k: near("y") + k))).withColumn("bx", F.explode(F.transform(around, lambda k: near("x") + k)))
        met = asks.join(there.withColumns({"by": near("oy"), "bx": near("ox")}), ["by", "bx"]).where("segid <> o")
        best = met.groupBy("segid", "radius").agg(F.min(F.struct(F.hypot(F.col("y") - F.col("oy"), F.col("x") - F.col("ox")).alias("d"), "o")).alias("m"))
        sure = materialise(best if last else best.where(F.col("m.d") <= side), "nearest")
        found = sure if found is None else found.union(sure)
        if last:
            break
        open_ = materialise(open_.join(sure.select("segid"), "segid", "left_anti"), "asking")
        if open_.isEmpty():
            break
        side *= 4
    return found.select("segid", F.col("m.o").alias("min_dist_id"), F.try_divide(F.col("m.d"), "radius").alias("min_dist"))


def overlap(footprints: DataFrame, cells: DataFrame) -> DataFrame:
    """(segid, max_dup_id, max_dup): the other footprint that is largest at a cell's centre, by an equi-join."""
    at = cells.select("segid", "y", "x").join(footprints.select(F.col("segid").alias("o"), "y", "x", "a"), ["y", "x"]).where("segid <> o")
    best = at.groupBy("segid").agg(F.max(F.struct("a", (-F.col("o")).alias("o"))).alias("m"))
    return best.select("segid", (-F.col("m.o")).alias("max_dup_id"), F.col("m.a").alias("max_dup"))


def on_grid(rows: DataFrame, tile: tuple[int, int, int, int, int, int], height: int, width: int) -> DataFrame:
    """Pixels of a tile with its margin, moved to the tile's own corner."""
    _, y0, y1, x0, x1, m = tile
    inside = rows.where((F.col("y") >= max(0, y0 - m)) & (F.col("y") < min(height, y1 + m)) & (F.col("x") >= max(0, x0 - m)) & (F.col("x") < min(width, x1 + m)))
    return inside.withColumns({"y": F.col("y") - max(0, y0 - m), "x": F.col("x") - max(0, x0 - m)})


def off_grid(rows: DataFrame, tile: tuple[int, int, int, int, int, int]) -> DataFrame:
    """The reverse of ``on_grid``; what is outside the tile has no rows."""
    _, y0, _, x0, _, m = tile
    return rows.withColumns({"y": F.col("y") + max(0, y0 - m), "x": F.col("x") + max(0, x0 - m)})


def tile_members(footprints: DataFrame, cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, segid, active): footprints that touch a tile or its halo; active where the centre is
    in the tile itself. The tile table is a handful of rows and broadcast."""
    m = F.col("margin")
    touching = footprints.where("a > 0").join(
        F.broadcast(tiles),
        (F.col("y") >= F.col("y0") - m) & (F.col("y") < F.col("y1") + m) & (F.col("x") >= F.col("x0") - m) & (F.col("x") < F.col("x1") + m),
    ).select("tile", "segid", "y0", "y1", "x0", "x1").distinct()
    joined = touching.join(cells.select("segid", "y", "x"), "segid")
    active = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return joined.select("tile", "segid", active.alias("active"))
