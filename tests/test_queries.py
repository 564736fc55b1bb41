"""Every query with SQL against DuckDB at the smallest size, and the sources."""

import math
import os

import numpy as np
import pytest

from glimmer import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-7 else "0"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(got.columns)
    assert order == sorted(columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert len(rows) == len(want) and rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_suppressed_peaks_keep_their_distance(spark):
    rows = catalog.QUERIES["nms_peaks"](spark, DIR).where("kind = 'cell'").collect()
    assert [r["segid"] for r in sorted(rows, key=lambda r: -r["firmness"])] == list(range(len(rows)))
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            assert math.hypot(a["y"] - b["y"], a["x"] - b["x"]) / max(a["radius"], b["radius"]) >= 2.0 - 1e-6


def test_array_and_raw_sources(spark, tmp_path):
    from glimmer.sources import movies

    movie = np.arange(5 * 3 * 4, dtype="<u2").reshape(5, 3, 4)
    np.save(tmp_path / "m.npy", movie)
    movie.tofile(tmp_path / "m.raw")
    want = [(t, movie[t].ravel().astype(float).tolist()) for t in range(5)]
    for read in (lambda: movies.read_npy(spark, f"file://{tmp_path}/m.npy"), lambda: movies.read_raw(spark, f"file://{tmp_path}/m.raw", 3, 4)):
        assert sorted((r["t"], list(r["px"])) for r in read().collect()) == want


def tif_bytes(movie, order, together):
    """An uncompressed TIFF file with one strip a page; pages' data and directories alternate unless ``together``."""
    import struct

    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    offsets = []
    if together:
        for page in movie:
            offsets.append(len(out))
            out += page.astype(order + "u2").tobytes()
    link = 4
    for k, page in enumerate(movie):
        if not together:
            offsets.append(len(out))
            out += page.astype(order + "u2").tobytes()
        out[link : link + 4] = struct.pack(order + "I", len(out))
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, offsets[k]), (277, 3, 1), (279, 4, page.size * 2)]
        out += struct.pack(order + "H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("together", [True, False])
def test_tif_source(spark, tmp_path, order, together):
    from glimmer.sources import movies

    movie = np.arange(3 * 4 * 5, dtype=np.uint16).reshape(3, 4, 5)
    (tmp_path / "m.tif").write_bytes(tif_bytes(movie, order, together))
    rows = movies.read_tif(spark, f"file://{tmp_path}/m.tif").collect()
    assert sorted((r["t"], list(r["px"])) for r in rows) == [(t, movie[t].ravel().astype(float).tolist()) for t in range(3)]


def test_stages_are_saved_and_found(spark, tmp_path):
    from glimmer.sources import store

    base = f"file://{tmp_path}"
    store.save_stage(spark.range(3), base, "stats", 0)
    store.save_stage(spark.range(5), base, "stats", 1)
    assert store.load_stage(spark, base, "stats", 1).count() == 5
    assert store.load_stage(spark, base, "stats", 2) is None
    assert {r["stage"]: r["count"] for r in store.load_stages(spark, base, "stats").groupBy("stage").count().collect()} == {0: 3, 1: 5}


def test_rules_with_empty_sets(spark):
    from glimmer.operators import classify as C

    rows = spark.createDataFrame([(0, "background", 1.0, 5.0), (1, "cell", 9.0, 5.0), (2, "cell", 0.0, 1.0)], "segid int, kind string, pos_move double, radius double")
    kinds = lambda df: [r["kind"] for r in df.orderBy("segid").collect()]
    assert kinds(C.clean(rows, 2.0, 2.0, {}, {})) == ["cell", "remove", "remove"]  # no thresholds: every background becomes a cell
    assert kinds(C.fix_kind(rows, {}, {})) == ["background", "cell", "cell"]
    assert C.finished(rows, 1, True) and not C.finished(rows, 0, True)


def test_entry_survives_without_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['glimmer.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pixel_stats' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_queries_run_from_another_folder(tmp_path):
    """Workers that cannot import the package get it from Spark."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
assert e.queries()["find_peaks"](spark, {DIR!r}).count() == 64
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode == 0
