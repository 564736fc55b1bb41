"""Footprints kept as one row a component: the bounding box of the weights above zero, and the box's weights
line by line. What asks for places looks at boxes first and at single weights only inside those that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boxed(footprints: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(segid, y0, y1, x0, x1, w) of footprints (segid, y, x, a); ends are exclusive. One shuffle, by component.

    Weights that are null or not above zero count as zero; of a repeated place the largest stays. A component of
    ``components`` without a weight has the box 0, 0, 0, 0 and no weights; without ``components`` it has no row."""
    rows = footprints.where("a > 0 and y is not null and x is not null").groupBy("segid").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.array_sort(F.collect_list(F.struct("y", "x", "a"))).alias("at")
    )
    wide = F.col("x1") - F.col("x0")
    spot = F.transform("at", lambda p: F.struct(((p["y"] - F.col("y0")) * wide + p["x"] - F.col("x0")).cast("int").alias("key"), p["a"].alias("value")))
    keyed = rows.withColumn("spot", spot).withColumn("n", F.size("spot"))
    # sorted by place and weight: the last of equal places is the largest
    last = F.filter("spot", lambda p, i: (i == F.col("n") - 1) | (F.element_at("spot", F.least(i + 2, F.col("n")))["key"] != p["key"]))
    held = keyed.withColumn("m", F.map_from_entries(last))
    out = held.select("segid", "y0", "y1", "x0", "x1", F.transform(F.sequence(F.lit(0), ((F.col("y1") - F.col("y0")) * wide - 1).cast("int")), lambda p: F.coalesce(F.element_at("m", p), F.lit(0.0))).alias("w"))
    if components is None:
        return out
    none = {c: F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) for c in ("y0", "y1", "x0", "x1")} | {"w": F.coalesce("w", F.array().cast("array<double>"))}
    return components.select("segid").distinct().join(out, "segid", "left").withColumns(none)


def unboxed(boxes: DataFrame) -> DataFrame:
    """(segid, y, x, a): the weights above zero; no shuffle."""
    long = boxes.select("segid", "y0", "x0", (F.col("x1") - F.col("x0")).alias("wide"), F.posexplode("w").alias("p", "a")).where("a > 0")
    return long.select("segid", (F.col("y0") + F.floor(F.col("p") / F.col("wide"))).cast("int").alias("y"), (F.col("x0") + F.col("p") % F.col("wide")).cast("int").alias("x"), "a")


def _touches(y0: Column, y1: Column, x0: Column, x1: Column) -> tuple[Column, Column]:
    """Whether a box meets a range of places, and whether a weight above zero lies there."""
    low, high = F.greatest("y0", y0), F.least("y1", y1)
    left, right = F.greatest("x0", x0), F.least("x1", x1)
    wide = F.col("x1") - F.col("x0")
    line = lambda y: F.slice("w", ((y - F.col("y0")) * wide + left - F.col("x0") + 1).cast("int"), (right - left).cast("int"))
    return (low < high) & (left < right), F.exists(F.sequence(low, high - 1), lambda y: F.exists(line(y), lambda v: v > 0))


def tile_members(boxes: DataFrame, cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, segid, active) as ``footprints.tile_members`` gives it, without a row a pixel. The tile table is a
    handful of rows and broadcast; the footprints are not shuffled but for the join with their centres."""
    t, m = tiles.select("tile", *[F.col(c).alias(f"t{c}") for c in ("y0", "y1", "x0", "x1")], "margin"), F.col("margin")
    near, inside = _touches(F.col("ty0") - m, F.col("ty1") + m, F.col("tx0") - m, F.col("tx1") + m)
    # the second test only reads weights of boxes that pass the first
    touching = boxes.join(F.broadcast(t), near).where(F.when(near, inside).otherwise(False)).select("tile", "segid", "ty0", "ty1", "tx0", "tx1")
    active = (F.col("y") >= F.col("ty0")) & (F.col("y") < F.col("ty1")) & (F.col("x") >= F.col("tx0")) & (F.col("x") < F.col("tx1"))
    return touching.join(cells.select("segid", "y", "x"), "segid").select("tile", "segid", active.alias("active"))


def overlap(boxes: DataFrame, cells: DataFrame, side: int = 32) -> DataFrame:
    """(segid, max_dup_id, max_dup) as ``footprints.overlap`` gives it: boxes and centres meet by the grid
    buckets of ``side`` places that a box covers, the weight is looked up in the box; ties go to the least id."""
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor((F.col(b) - 1) / side)))
    wide = boxes.where("y1 > y0").withColumnRenamed("segid", "o").withColumn("by", cover("y0", "y1")).withColumn("bx", cover("x0", "x1"))
    asks = cells.select("segid", "y", "x", F.floor(F.col("y") / side).alias("by"), F.floor(F.col("x") / side).alias("bx"))
    met = asks.join(wide, ["by", "bx"]).where("segid <> o and y >= y0 and y < y1 and x >= x0 and x < x1")
    weight = F.element_at("w", ((F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) + F.col("x") - F.col("x0") + 1).cast("int"))
    best = met.select("segid", "o", weight.alias("a")).where("a > 0").groupBy("segid").agg(F.max(F.struct("a", (-F.col("o")).alias("o"))).alias("m"))
    return best.select("segid", (-F.col("m.o")).alias("max_dup_id"), F.col("m.a").alias("max_dup"))
