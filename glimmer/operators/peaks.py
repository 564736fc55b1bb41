"""Blob detection over scales, and greedy suppression of overlapping blobs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise
from .normalize import inside_of
from .stencils import by_frame, log_scales, max_pool


def radii(kind: str, low: float | None = None, high: float | None = None, count: int | None = None, values: Sequence[float] = ()) -> list[float]:
    """Scales: ``logscale`` (geometric), ``linear`` or a given ``list``."""
    if kind == "logscale":
        return np.geomspace(low, high, count).tolist()
    if kind == "linear":
        return np.linspace(low, high, count).tolist()
    if kind == "list":
        return [float(v) for v in values]
    raise ValueError(f"unknown kind of radii: {kind}")


def local_peaks(frames: DataFrame, height: int, width: int, scales: Sequence[float], mask: DataFrame | None = None) -> DataFrame:
    """(y, x, t, ri, v): places that equal the maximum of their 3 x 3 x 3 surroundings in scale space. Of a
    mask(y, x), only places inside count, but what lies outside takes part in the comparison."""
    inside = inside_of(mask, height, width)

    def work(t, images):
        space = log_scales(images, scales)
        top = space == max_pool(space)
        n, ri, y, x = np.nonzero(top if inside is None else top & inside)
        as_int = lambda a: a.astype(np.int32)
        return {"y": as_int(y), "x": as_int(x), "t": as_int(t[n]), "ri": as_int(ri), "v": space[n, ri, y, x]}

    return by_frame(frames, height, width, work, "y int, x int, t int, ri int, v double")


def best_peaks(found: DataFrame, scales: Sequence[float]) -> DataFrame:
    """(y, x, t, ri, radius, v): the largest peak of each pixel; ties go to the least t, then ri.
    The maximum combines in each task before the shuffle, so only one row a pixel and task moves."""
    top = found.groupBy("y", "x").agg(F.max(F.struct(F.col("v"), (-F.col("t")).alias("t"), (-F.col("ri")).alias("ri"))).alias("b"))
    radius = F.element_at(F.array(*[F.lit(float(s)) for s in scales]), (1 - F.col("b.ri")).cast("int"))
    return top.select("y", "x", (-F.col("b.t")).alias("t"), (-F.col("b.ri")).alias("ri"), radius.alias("radius"), F.col("b.v").alias("v"))


def suppress(y, x, radius, v, low: float, high: float, ratio: float, old=None) -> np.ndarray:
    """Greedy suppression in descending v (then y, x): 1 cell, 2 background, 0 removed.

    Distances are in units of the candidate's radius. Radii below ``low`` go; those above ``high``, and
    candidates that are backgrounds already (``old``), are backgrounds if no accepted background is nearer than ``ratio``; others are cells if no
    accepted cell is nearer, and an accepted cell removes what is left within ``ratio`` of it.
    """
    kind, open_ = np.zeros(len(v), np.int32), np.ones(len(v), bool)
    cells: list[int] = []
    wide: list[int] = []
    for i in np.lexsort((x, y, -v)):
        if not open_[i]:
            continue
        open_[i] = False
        r = radius[i]
        if r < low:
            continue
        ground = r > high or old is not None and bool(old[i])
        held = wide if ground else cells
        if held and np.min(np.hypot(y[held] - y[i], x[held] - x[i])) / r < ratio:
            continue
        held.append(i)
        if ground:
            kind[i] = 2
            continue
        kind[i] = 1
        open_ &= np.hypot(y - y[i], x - x[i]) / r > ratio
    return kind


def outranked(nodes: DataFrame, ratio: float, block: float) -> DataFrame:
    """(src, dst) for nodes (id, y, x, r, v, ground): dst is removed if src, which is visited earlier, is
    accepted. A cell removes what is within ratio of its radius; a node yields to one of its own
    kind within ratio of the node's radius. Both come together in buckets of ``block`` pixels."""
    rings = int(np.ceil(ratio * (nodes.agg(F.max("r")).first()[0] or 0.0) / block))
    around = F.sequence(F.lit(-rings), F.lit(rings))
    bucket = lambda c: F.floor(F.col(c) / block)
    dealt = lambda p: nodes.select(*[F.col(c).alias(p + c) for c in ("id", "y", "x", "r", "v", "ground")], bucket("y").alias("by"), bucket("x").alias("bx"))
    first = dealt("a_").withColumn("by", F.explode(F.transform(around, lambda k: F.col("by") + k))).withColumn("bx", F.explode(F.transform(around, lambda k: F.col("bx") + k)))
    rank = lambda p: F.struct((-F.col(p + "v")).alias("v"), F.col(p + "y").alias("y"), F.col(p + "x").alias("x"), F.col(p + "id").alias("id"))
    apart = F.hypot(F.col("a_y") - F.col("b_y"), F.col("a_x") - F.col("b_x"))
    takes = ~F.col("a_ground") & (apart / F.col("a_r") <= ratio)
    yields = (F.col("a_ground") == F.col("b_ground")) & (apart / F.col("b_r") < ratio)
    met = first.join(dealt("b_"), ["by", "bx"]).where((rank("a_") < rank("b_")) & (takes | yields))
    return met.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


def removed(edges: DataFrame) -> DataFrame:
    """(id): the nodes that go when nodes are visited by rank and each that no accepted one removes is accepted.

    In rounds: whoever is outranked by no open node is accepted at once, what it removes goes, and the
    edges of both are done. The rounds are as many as the longest chain of decisions; every round
    is written to the shared folder, and only the number of its open edges reaches the driver."""
    gone, now = edges.select(F.col("dst").alias("id")).where("false"), materialise(edges, "open-edges")
    while not now.isEmpty():
        heads = now.select("src").distinct().join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
        lost = materialise(now.join(heads, "src", "left_semi").select(F.col("dst").alias("id")).distinct(), "removed")
        gone = gone.union(lost)
        now = materialise(now.join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti").join(lost.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst"), "open-edges")
    return gone


def reduce_peaks(peaks: DataFrame, low: float, high: float, ratio: float, block: float | None = None, bg_type: str = "bg") -> DataFrame:
    """(segid, kind, y, x, t, radius, firmness) after suppression: the same as ``suppress`` over all peaks at
    once, of any frame size, in rounds over a bucket join. ``block`` (pixels; the largest reach
    if None) only deals the work.

    A boolean column ``old_bg`` marks peaks that are backgrounds already. Peaks without a value are none;
    equal values are visited by y, then x; other columns are not read; without peaks the result is empty.
    """
    if "old_bg" not in peaks.columns:
        peaks = peaks.withColumn("old_bg", F.lit(False))
    nodes = materialise(
        peaks.where(F.col("v").isNotNull() & (F.col("radius") >= low)).select(
            F.monotonically_increasing_id().alias("id"), "y", "x", "t", F.col("radius").alias("r"), "v", ((F.col("radius") > high) | F.coalesce("old_bg", F.lit(False))).alias("ground")
        ), "candidates",
    )
    if block is None:
        block = max(1.0, float(np.ceil(ratio * (nodes.agg(F.max("r")).first()[0] or 0.0))))
    kept = nodes.join(removed(outranked(nodes, ratio, block)), "id", "left_anti")
    if bg_type == "remove":
        kept = kept.where("not ground")
    named = kept.select(F.when(F.col("ground"), "background").otherwise("cell").alias("kind"), "y", "x", "t", F.col("r").alias("radius"), F.col("v").alias("firmness"))
    return with_segid(named)


def with_segid(peaks: DataFrame) -> DataFrame:
    """Number peaks from 0: cells first, then backgrounds, each by falling firmness, then y, x. Peaks
    are sorted in ranges; a number is the place within its range after what the ranges before hold."""
    order = [F.when(F.col("kind") == "cell", 0).otherwise(1), F.desc("firmness"), F.asc("y"), F.asc("x")]
    at = F.monotonically_increasing_id()  # the partition in the high bits, the row in the low 33
    placed = materialise(peaks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "peaks")
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))  # one row a range
    return placed.join(base, "_part").select((F.col("_base") + F.col("_at")).cast("int").alias("segid"), *peaks.columns)


def tiles(height: int, width: int, rows: int, columns: int, margin: int) -> list[tuple[int, int, int, int, int, int]]:
    """(tile, y0, y1, x0, x1, margin): interior tiles share what the margins leave; outer ones take the edges."""
    def cuts(size: int, n: int) -> list[int]:
        step = (size - 2 * margin + n - 1) // n
        return [0, *(margin + step * k for k in range(1, n)), size]

    ys, xs = cuts(height, rows), cuts(width, columns)
    return [
        (i * columns + j, ys[i], ys[i + 1], xs[j], xs[j + 1], margin) for i in range(rows) for j in range(columns)
    ]
