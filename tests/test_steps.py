"""Steps known by what they were made from, and reports over stages on hand-made tables against DuckDB."""

import duckdb
import pytest

from glimmer.plans import stages as R
from glimmer.sources.steps import Steps, gather


def test_a_change_remakes_what_follows_it(spark, tmp_path):
    data, base, ran = f"file://{tmp_path}/data", f"file://{tmp_path}/steps", []
    spark.range(4).write.parquet(data)

    def run(limit=1, force=None):
        ran.clear()
        steps = Steps(spark, base, force)
        source = steps.source(data)

        def made(step, stage, settings, inputs, make):
            return steps.table(step, stage, settings, inputs, lambda: ran.append((stage, step)) or make())

        a = made("a", 0, {}, [source], lambda: spark.read.parquet(data))
        b = made("b", 0, {"limit": limit}, [a.mark], lambda: a.rows.where(f"id > {limit}"))
        c = made("c", 1, {}, [b.mark], lambda: b.rows.selectExpr("id * 10 AS id"))
        return [sorted(r[0] for r in one.rows.collect()) for one in (a, b, c)], c

    every = [(0, "a"), (0, "b"), (1, "c")]
    first, held = run()
    assert first == [[0, 1, 2, 3], [2, 3], [20, 30]] and ran == every
    assert run()[0] == first and ran == []
    assert run(limit=2)[0][2] == [30] and ran == every[1:]
    assert run()[0] == first and ran == []  # the older setting's tables are still there
    assert run(force=(0, "b"))[0] == first and ran == every[1:]
    assert sorted(r[0] for r in held.rows.collect()) == [20, 30]  # made anew elsewhere, not under the reader
    spark.range(4, 6).write.mode("append").parquet(data)
    assert run()[0] == [[0, 1, 2, 3, 4, 5], [2, 3, 4, 5], [20, 30, 40, 50]] and ran == every
    assert {(r["stage"], r["step"]) for r in Steps(spark, base).manifest().collect()} == set(every)


def test_a_table_cut_short_is_made_again(spark, tmp_path):
    base = f"file://{tmp_path}"

    def broken():
        return spark.range(3).selectExpr("assert_true(id < 2), id")

    with pytest.raises(Exception, match="assert|true"):
        Steps(spark, base).table("a", 0, {}, [], broken)
    made = Steps(spark, base).table("a", 0, {}, [], lambda: spark.range(3).toDF("id"))
    assert made.rows.count() == 3 and gather(spark, [made.path, made.path]).where("stage = 1").count() == 3


STATS = [
    # run, la, lu, stage, segid, kind, radius, firmness, signal, udense
    ("one", 0.01, 0.001, 0, 0, "cell", 2.0, 0.5, 3.0, 0.05), ("one", 0.01, 0.001, 0, 1, "cell", 2.0, 0.7, 2.0, 0.2), ("one", 0.01, 0.001, 0, 2, "background", 4.0, 0.1, None, None),
    ("one", 0.01, 0.001, 0, 3, "remove", 2.0, None, 0.0, None), ("one", 0.01, 0.001, 1, 0, "cell", 2.5, 0.5, 1.0, 0.1), ("two", 0.1, 0.001, 0, 0, "cell", 2.0, 0.99, 1.5, 1.0),
    ("two", 0.1, 0.001, 0, 1, None, None, 0.0, 1.5, 0.0),
]
COLUMNS = "run", "la", "lu", "stage", "segid", "kind", "radius", "firmness", "signal", "udense"
REPORTS = {
    "counts_of": "SELECT stage, kind, count(*) AS n FROM stats GROUP BY ALL",
    "signals_of": "SELECT stage, segid, CASE WHEN udense > 0.1 THEN 'background' ELSE kind END AS kind, round(udense, 4) AS udense, round(signal, 4) AS signal FROM stats WHERE signal > 0",
    "radii_of": "SELECT stage, kind, round(radius, 4) AS radius, count(*) AS n, round(avg(firmness), 4) AS firmness FROM stats GROUP BY 1, 2, 3",
    "cells_of": "SELECT lu, la, stage, count(*) FILTER (kind = 'cell') AS n FROM stats GROUP BY 1, 2, 3",
    "facets_of": "SELECT run, stage, segid, round(udense, 4) AS udense, round(signal, 4) AS signal, count(*) OVER (PARTITION BY run, stage) AS n FROM stats WHERE signal > 0",
    "histograms_of": """SELECT run, stage, metric, CAST(floor(v * 10) AS INTEGER) AS bin, count(*) AS n
      FROM (SELECT run, stage, 'firmness' AS metric, firmness AS v FROM stats UNION ALL SELECT run, stage, 'udense', udense FROM stats) WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4""",
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_over_stages(spark, name):
    types = "run string, la double, lu double, stage int, segid int, kind string, radius double, firmness double, signal double, udense double"
    got = getattr(R, name)(spark.createDataFrame(STATS, types))
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE stats ({types.replace('string', 'varchar')})")
    duck.executemany(f"INSERT INTO stats VALUES ({', '.join('?' * len(COLUMNS))})", STATS)
    cursor = duck.execute(REPORTS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, cursor.fetchall()))
    assert getattr(R, name)(spark.createDataFrame([], types)).count() == 0


def test_runs_share_their_steps(spark):
    d = "/root/testdata/sf0.001"
    first = R.run_stages(spark, d)
    assert first == R.run_stages(spark, d)  # nothing is made again
    other = R.run_stages(spark, d, "a100u10")
    assert other["footprints"][0] == first["footprints"][0] and other["stats"][0] != first["stats"][0]
    stats = gather(spark, first["stats"])
    assert stats.columns == [*R.COLUMNS, "stage"] and stats.select("stage").distinct().count() == len(first["stats"])
    kept = gather(spark, first["spikes"]).join(stats.where("kind = 'cell'"), ["stage", "segid"], "left_anti")
    assert kept.count() == 0  # every spike belongs to a cell of its stage that was not removed


def test_runs_of_a_sweep_go_side_by_side(spark, tmp_path, monkeypatch):
    import threading

    path, all_here, shared = f"file://{tmp_path}/stats", threading.Barrier(len(R.SWEEP)), []
    spark.createDataFrame([(0, "cell"), (1, "background")], "segid int, kind string").write.parquet(path)

    def run(spark, d, config):
        assert shared  # what the runs have in common is made first, once
        all_here.wait(30)
        return {"stats": [path]}

    monkeypatch.setattr(R, "run_stages", run)
    monkeypatch.setattr(R, "first_steps", lambda *_: shared.append(1), raising=False)
    rows = R.cells_of(R._runs(spark, "none")).collect()
    assert len(shared) == 1 and sorted((r["la"], r["lu"], r["n"]) for r in rows) == [(0.01, 0.001, 1), (0.01, 0.01, 1), (0.1, 0.001, 1)]
