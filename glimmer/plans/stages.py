"""The stage loop: peaks, footprints, then temporal solve, evaluation, kind rules, spatial solve and
cleaning in turn, with the tables of every stage kept; and the reports over stages and runs.

The solves have no SQL form; tests hold them against planted movies and finite differences, and the
steps between them have queries with SQL of their own."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import classify as C
from ..operators import footprints as G
from ..operators import models as V
from ..operators import peaks as P
from ..operators import traces as T
from ..sources import store
from ..sources.steps import Steps, gather
from ..sources.store import materialise
from .algebra import unit_frames
from .movie import RADII, SIDE, _best, frames
from .segment import TILES

LOW, HIGH, RATIO, CLOSING = 0.5, 1.5, 1.2, 4
STAGES, EPOCHS, STEPS = 2, 100, 20
SWEEP = ("a10u10", "a10u100", "a100u10")
#: The statistics table of a stage: its columns in order.
COLUMNS = (
    "kind old_kind segid spkid bgid y x radius aratio firmness pos_move min_dist_id min_dist max_dup_id max_dup asum area signal udense unz rsn zrsn hypot mah bmax bsparse"
).split()


def described(cells: DataFrame, feet: DataFrame) -> DataFrame:
    """Cells (segid, kind, y, x, radius, firmness, pos_move) with the measures of their footprints and their
    nearest and most overlapping neighbours of kind cell; components without a weight are dropped."""
    own = cells.where("kind = 'cell'").select("segid", "y", "x", "radius")
    cell_feet = feet.join(own.select("segid"), "segid", "left_semi")
    near, dup = G.nearest(own), G.overlap(cell_feet, own)
    near = materialise(near, "near")  # written, as a plan that held its rounds too filled the driver
    return cells.join(G.measures(feet), "segid").join(near, "segid", "left").join(dup, "segid", "left").fillna({"min_dist_id": -1, "max_dup_id": -1})


def evaluate(cells: DataFrame, spikes: DataFrame, grounds: DataFrame, length: int) -> DataFrame:
    """The statistics table after a temporal solve: ``cells`` with what spikes (segid, u, v) of ``length``
    places and background traces (segid, t, v) say; silent cells are to be removed. Each part is written, a row a
    component, so that the driver never plans them all at once."""
    s = materialise(T.spike_stats(spikes.withColumnRenamed("segid", "spkid"), length).withColumnRenamed("spkid", "segid"), "spike-stats")
    b = materialise(T.background_stats(grounds.withColumnRenamed("segid", "id")).withColumnRenamed("id", "segid"), "background-stats")
    named = materialise(C.silent_to_remove(cells.join(s, "segid", "left")).join(b, "segid", "left"), "evaluated")
    live = named.where("kind = 'cell'").select("segid", "firmness", "rsn")
    scored = materialise(T.robust_zscore(live, zrsn="rsn", _zfirm="firmness").withColumn("hypot", F.hypot("_zfirm", "zrsn")), "scores")
    scored = T.mahalanobis(scored, "firmness", "rsn", "mah").select("segid", "zrsn", "hypot", "mah")
    return named.join(scored, "segid", "left").select(*COLUMNS)


def converted(fixed: DataFrame, spikes: DataFrame, grounds: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Spikes and background traces for the kinds in ``fixed``: a cell that became background has its
    spikes answered, a background that became cell has its trace undone."""
    of = lambda kind, old: fixed.where((F.col("kind") == kind) & (F.col("old_kind") == old)).select("segid")
    pick = lambda rows, ids: rows.join(ids, "segid", "left_semi")
    spark = spikes.sparkSession
    lost = pick(spikes, of("background", "cell")).withColumnRenamed("segid", "spkid")
    as_trace = T.spike_to_calcium(lost, T.kernel(spark), T.double_exp()[0], count).select(F.col("spkid").alias("segid"), "t", "v")
    found = of("cell", "background").select("segid", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("t"))
    dense = found.join(grounds, ["segid", "t"], "left").select(F.col("segid").alias("id"), "t", F.coalesce("v", F.lit(0.0)).alias("v"))
    as_spikes = T.calcium_to_spike(dense).select(F.col("id").alias("segid"), "u", "v").where("v <> 0")
    return pick(spikes, of("cell", "cell")).unionByName(as_spikes), pick(grounds, of("background", "background")).unionByName(as_trace)


def first_steps(spark: SparkSession, d: str, steps: Steps) -> tuple:
    """The steps before the stages, which all runs share: the normalised movie, footprints and cells."""
    source = steps.source(f"{d}/embeddings.parquet")
    movie = steps.table("normalize", 0, {"side": SIDE}, [source], lambda: unit_frames(spark, d))
    best = steps.table("find", 0, {"side": SIDE, "radii": RADII}, [source], lambda: _best(spark, d))
    peaks = steps.table("reduce", 0, {"low": LOW, "high": HIGH, "ratio": RATIO}, [best.mark], lambda: P.reduce_peaks(best.rows, LOW, HIGH, RATIO))
    feet = steps.table("make", 0, {"closing": CLOSING}, [source, peaks.mark], lambda: G.make_footprints(frames(spark, d), peaks.rows, SIDE, SIDE, CLOSING))
    cells = steps.table("init", 0, {}, [peaks.mark, feet.mark], lambda: described(peaks.rows.select("segid", "kind", "y", "x", "radius", "firmness", F.lit(None).cast("double").alias("pos_move")), feet.rows))
    return movie, feet, cells


def run_stages(spark: SparkSession, d: str, config: str = "a10u10", rule_set: str = "ratio3z4", stages: int = STAGES, kinds: tuple[dict, dict] = ({}, {}), force: tuple[int, str] | None = None) -> dict[str, list[str]]:
    """Run up to ``stages`` stages, until one past the first removes nothing; returns where the tables stats,
    loss, spikes, background and footprints are, one a stage. A step whose table was made from the same
    data and settings is read, not run; runs share the steps that they have in common. ``kinds`` are the limits
    past which cells become backgrounds and backgrounds cells after a temporal solve of a later stage."""
    steps = Steps(spark, f"{store.shared_dir(spark)}/steps", force)
    count = frames(spark, d).count()
    movie, feet, cells = first_steps(spark, d, steps)
    length = count + T.double_exp()[0] - 1
    limits = C.rules(rule_set, LOW, HIGH)
    out: dict[str, list[str]] = {name: [] for name in ("stats", "loss", "spikes", "background", "footprints")}
    for stage in range(stages):
        setting = V.penalty(V.preset(config), stage)
        effort = {"penalty": setting, "epochs": EPOCHS, "steps": STEPS, "tiles": TILES}
        solved = steps.table("temporal", stage, effort, [movie.mark, cells.mark, feet.mark], lambda cells=cells, feet=feet, setting=setting: V.temporal(movie.rows, cells.rows, feet.rows, TILES, SIDE, SIDE, count, setting, epochs=EPOCHS, steps=STEPS))
        of_kind = lambda kind, place, solved=solved, cells=cells: solved.rows.where("what = 'x'").join(cells.rows.where(F.col("kind") == kind).select("segid"), "segid", "left_semi").select(F.col("segid").cast("int").alias("segid"), F.col("place").alias(place), "v")
        after = [solved.mark, cells.mark]
        spikes = steps.table("spikes", stage, {}, after, lambda of_kind=of_kind: of_kind(V.CELL, "u"))
        grounds = steps.table("background", stage, {}, after, lambda of_kind=of_kind: of_kind(V.BACKGROUND, "t"))
        stats = steps.table("evaluate", stage, {"length": length}, [cells.mark, spikes.mark, grounds.mark], lambda cells=cells, spikes=spikes, grounds=grounds: evaluate(cells.rows, spikes.rows, grounds.rows, length))
        logs, made = [("temporal", solved)], feet
        last = stage + 1 == stages or C.finished(stats.rows, stage, True)
        if not last:
            rule = kinds if stage else ({}, {})
            fixed = steps.table("fix", stage, {"rules": rule}, [stats.mark], lambda stats=stats, rule=rule: C.renumber(C.fix_kind(stats.rows.where("kind <> 'remove'"), *rule)))
            trains, traces = converted(fixed.rows, spikes.rows, grounds.rows, count)
            shaped = steps.table(
                "spatial", stage, effort, [movie.mark, fixed.mark, feet.mark, spikes.mark, grounds.mark],
                lambda fixed=fixed, feet=feet, trains=trains, traces=traces, setting=setting: V.spatial(movie.rows, fixed.rows.select("segid", "kind", "y", "x"), feet.rows, trains, traces, TILES, SIDE, SIDE, count, setting, epochs=EPOCHS, steps=STEPS),
            )
            logs.append(("spatial", shaped))
            rows = {}
            again = lambda fixed=fixed, shaped=shaped, rows=rows: rows.get("both") or rows.setdefault("both", cleaned(fixed.rows, shaped.rows, limits))  # noqa: E731, B023
            cleaning = {"limits": limits, "radii": RADII, "closing": CLOSING}
            cells = steps.table("clean-cells", stage, cleaning, [fixed.mark, shaped.mark], lambda again=again: again()[0])
            feet = steps.table("clean", stage, cleaning, [fixed.mark, shaped.mark], lambda again=again: again()[1])
        log = steps.table("loss", stage, {}, [one.mark for _, one in logs], lambda logs=logs: reduce(DataFrame.unionByName, [logged(kind, one.rows) for kind, one in logs]))
        for name, table in (("stats", stats), ("loss", log), ("spikes", spikes), ("background", grounds), ("footprints", made)):
            out[name].append(table.path)
        if last:
            break
    return out


def logged(kind: str, solved: DataFrame) -> DataFrame:
    """The log of a solve."""
    return solved.where("what = 'loss'").select(F.lit(kind).alias("kind"), F.col("tile").alias("div"), F.col("place").alias("step"), F.col("v").alias("loss"), "sigma")


def cleaned(fixed: DataFrame, shaped: DataFrame, limits: dict) -> tuple[DataFrame, DataFrame]:
    """Cells and footprints for the next stage: shapes found anew, kinds by the cleaning rules, removed
    components dropped, the rest numbered anew, cells before backgrounds."""
    raw = shaped.where("what = 'x' and v > 0").select(F.col("segid").cast("int").alias("segid"), F.floor(F.col("place") / SIDE).cast("int").alias("y"), (F.col("place") % SIDE).cast("int").alias("x"), F.col("v").alias("a"))
    grown = materialise(G.clean_footprints(raw, SIDE, SIDE, RADII, CLOSING), "grown")
    new = grown.groupBy("segid").agg(F.first("cy").alias("ny"), F.first("cx").alias("nx"), F.first("radius").alias("nr"), F.first("firmness").alias("nf"))
    shape = G.measures(grown).select("segid", F.col("aratio").alias("na"))
    moved = F.hypot(F.col("ny") - F.col("y"), F.col("nx") - F.col("x")) / F.col("radius")
    now = fixed.join(new, "segid").join(shape, "segid").select(
        "segid", "kind", F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("nr").alias("radius"), F.col("nf").alias("firmness"), moved.alias("pos_move"), F.col("na").alias("aratio"), "hypot", "mah", "bmax", "bsparse"
    )
    kept = C.clean(now, limits["remove_move"], limits["remove_radius"], limits["to_background"], limits["to_cell"]).where("kind <> 'remove'")
    place = F.row_number().over(Window.orderBy(F.when(F.col("kind") == "cell", 0).otherwise(1), "segid")) - 1  # one row a component
    numbered = materialise(kept.withColumn("_new", place.cast("int")), "kept")
    feet = materialise(grown.join(numbered.select("segid", "_new"), "segid").select(F.col("_new").alias("segid"), "y", "x", "a"), "footprints")
    cells = described(numbered.select(F.col("_new").alias("segid"), "kind", "y", "x", "radius", "firmness", "pos_move"), feet)
    return materialise(cells, "cells"), feet


def of_run(spark: SparkSession, d: str, entry: str, config: str = "a10u10") -> DataFrame:
    return gather(spark, run_stages(spark, d, config)[entry])


def stage_table(spark, d):
    """The statistics of every stage."""
    rows = of_run(spark, d, "stats")
    return rows.select("stage", *[tidy(c, 4).alias(c) if k == "double" else F.col(c) for c, k in rows.select(*COLUMNS).dtypes])


def stage_loss(spark, d):
    """The log of both solves by stage, tile and epoch."""
    return of_run(spark, d, "loss").select("stage", "kind", "div", "step", tidy("loss", 4).alias("loss"), tidy("sigma", 4).alias("sigma"))


def temporal_fit(spark, d):
    """Spikes of the cells of the first stage."""
    return of_run(spark, d, "spikes").where("stage = 0").select("segid", "u", tidy("v", 4).alias("v"))


def spatial_fit(spark, d):
    """Footprints that the first spatial solve gave, after cleaning."""
    return of_run(spark, d, "footprints").where("stage = 1").select("segid", "y", "x", tidy("a", 4).alias("a"))


def stage_counts(spark, d):
    return counts_of(of_run(spark, d, "stats"))


def counts_of(stats: DataFrame) -> DataFrame:
    """Components by stage and kind."""
    return stats.groupBy("stage", "kind").agg(F.count("*").alias("n"))


def stage_signals(spark, d):
    return signals_of(of_run(spark, d, "stats"))


def signals_of(stats: DataFrame) -> DataFrame:
    """Density against signal by stage, cells beyond the limit marked as backgrounds."""
    rows = stats.where("signal > 0")
    return rows.select("stage", "segid", F.when(F.col("udense") > 0.1, "background").otherwise(F.col("kind")).alias("kind"), tidy("udense", 4).alias("udense"), tidy("signal", 4).alias("signal"))


def stage_radii(spark, d):
    return radii_of(of_run(spark, d, "stats"))


def radii_of(stats: DataFrame) -> DataFrame:
    """Components and their firmness by stage, kind and radius."""
    return stats.groupBy("stage", "kind", tidy("radius", 4).alias("radius")).agg(F.count("*").alias("n"), tidy(F.avg("firmness"), 4).alias("firmness"))


def _runs(spark, d):
    """The statistics of the runs of a sweep, with the weights of each. Runs go side by side, after the steps that
    they share, so that one's tasks fill the machines while another waits."""
    first_steps(spark, d, Steps(spark, f"{store.shared_dir(spark)}/steps"))
    with ThreadPoolExecutor(len(SWEEP)) as pool:
        every = list(pool.map(lambda config: run_stages(spark, d, config)["stats"], SWEEP))
    out = None
    for config, paths in zip(SWEEP, every, strict=True):
        setting = V.penalty(V.preset(config))
        rows = gather(spark, paths).withColumns({"run": F.lit(config), "la": F.lit(setting.la[1]), "lu": F.lit(setting.lu[1])})
        out = rows if out is None else out.unionByName(rows)
    return out


def sweep_cells(spark, d):
    return cells_of(_runs(spark, d))


def cells_of(runs: DataFrame) -> DataFrame:
    """Cells by the weights of a sweep and stage."""
    return runs.groupBy("lu", "la", "stage").agg(F.count(F.when(F.col("kind") == "cell", 1)).alias("n"))


def sweep_signals(spark, d):
    return facets_of(_runs(spark, d))


def facets_of(runs: DataFrame) -> DataFrame:
    """Density against signal by run and stage, with how many cells the facet has."""
    many = runs.where("signal > 0").groupBy("run", "stage").agg(F.count("*").alias("n"))
    return runs.where("signal > 0").join(F.broadcast(many), ["run", "stage"]).select("run", "stage", "segid", tidy("udense", 4).alias("udense"), tidy("signal", 4).alias("signal"), "n")


def sweep_histograms(spark, d):
    return histograms_of(_runs(spark, d))


def histograms_of(runs: DataFrame) -> DataFrame:
    """Histograms of firmness and density by run and stage, in tenths."""
    long = runs.select("run", "stage", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("firmness", "udense")])).alias("m"))
    return long.where("m.v is not null").groupBy("run", "stage", "m.metric", F.floor(F.col("m.v") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    stage_table, stage_loss, temporal_fit, spatial_fit, stage_counts, stage_signals, stage_radii, sweep_cells, sweep_signals, sweep_histograms,
)}
ORACLES: dict = {}
