"""Footprints as boxes: round trip, odd rows, and the same answers as from single pixels."""

import numpy as np
from pyspark.sql import functions as F

from glimmer.operators import boxes as X
from glimmer.operators import footprints as G
from glimmer.operators import models as V
from glimmer.operators import peaks as P
from glimmer.sources.store import materialise

FORM = "segid int, y int, x int, a double"


def test_odd_footprints(spark):
    rows = [(0, 5, 7, 1.0), (0, 6, 9, 0.5), (0, 6, 8, 0.0), (1, 0, 0, None), (2, 3, 3, 0.2), (2, 3, 3, 0.9), (2, 3, 3, 0.9), (3, None, 1, 1.0), (4, 2, 2, -1.0), (5, 9, 9, 0.1)]
    ids = spark.createDataFrame([(k,) for k in range(7)], "segid int")
    got = {r["segid"]: (r["y0"], r["y1"], r["x0"], r["x1"], list(r["w"])) for r in X.boxed(spark.createDataFrame(rows, FORM).withColumn("m", F.lit(1)), ids).collect()}
    none = (0, 0, 0, 0, [])
    assert got == {0: (5, 7, 7, 10, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]), 1: none, 2: (3, 4, 3, 4, [0.9]), 3: none, 4: none, 5: (9, 10, 9, 10, [0.1]), 6: none}
    empty = X.boxed(spark.createDataFrame([], FORM))
    assert empty.count() == 0 and X.unboxed(empty).count() == 0
    assert X.unboxed(X.boxed(spark.createDataFrame([], FORM), ids)).count() == 0


def test_boxes_answer_as_pixels_do(spark):
    rng = np.random.default_rng(2)
    side, rows, cells = 70, [], []
    for k in range(60):
        cy, cx, n = rng.integers(0, side), rng.integers(0, side), rng.integers(1, 60)
        at = {(int(np.clip(cy + rng.integers(-8, 9), 0, side - 1)), int(np.clip(cx + rng.integers(-8, 9), 0, side - 1))) for _ in range(n)} | {(int(cy), int(cx))}
        rows += [(k, y, x, float(rng.random())) for y, x in at]
        cells.append((k, int(cy), int(cx)))
    feet, cells = spark.createDataFrame(rows, FORM), spark.createDataFrame(cells, "segid int, y int, x int")
    boxes = materialise(X.boxed(feet), "boxes")
    content = lambda df: sorted(tuple(r) for r in df.collect())
    assert content(X.unboxed(boxes)) == sorted(rows)
    tiles = V.tile_frame(spark, P.tiles(side, side, 3, 2, 4))
    assert content(X.tile_members(boxes, cells, tiles)) == content(G.tile_members(feet, cells, tiles))
    want = content(G.overlap(feet, cells))
    assert content(X.overlap(boxes, cells)) == content(X.overlap(boxes, cells, 5)) == want and len(want) > 10
