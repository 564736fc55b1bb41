"""Medians by rank against Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import selection as Q


def columns(kind, n, rng):
    return {
        "normal": lambda: rng.normal(size=n), "two": lambda: rng.integers(0, 2, n).astype(float), "one": lambda: np.full(n, 3.5),
        "powers": lambda: 10.0 ** rng.uniform(-300, 300, n), "few": lambda: rng.integers(0, 7, n) / 7, "outlier": lambda: np.append(rng.normal(size=n - 2), [np.inf, -np.inf]),
    }[kind]()


@pytest.mark.parametrize("kind", ["normal", "two", "one", "powers", "few", "outlier"])
def test_a_long_column_has_the_median_of_a_sort(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 2_000 + len(kind) % 2
    v = columns(kind, n, rng)
    table = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 50, "v double").repartition(5)
    assert Q.medians(table, "v", bound=20).first()["median"] == np.sort(v)[[(n - 1) // 2, n // 2]] @ [0.5, 0.5]


@pytest.mark.parametrize("sent", [100_000, 0])
def test_long_and_short_keys_side_by_side(spark, sent, monkeypatch):
    """Keys of all lengths, one of them null and one without values, keys known by two columns."""
    monkeypatch.setattr(Q, "SENT_KEYS", sent)
    rng = np.random.default_rng(4)
    rows = [(a, b, float(x)) for a, b, n in ((1, "x", 900), (1, "y", 3), (2, "x", 1), (None, "x", 600), (1, None, 40)) for x in np.round(rng.normal(size=n), 1)]
    table = spark.createDataFrame([*rows, (9, "z", None)], "a int, b string, v double").repartition(3)
    want = table.groupBy("a", "b").agg(F.median("v").alias("median"), F.max("v").alias("top"), F.count("*").alias("many"))
    got = Q.medians(table, "v", "a", "b", bound=30, top=F.max("v"), many=F.count("*"))
    order = lambda found: sorted((tuple(r) for r in found.collect()), key=str)
    assert got.columns == want.columns and order(got) == order(want)


def test_a_sketch_that_misses_the_middle_is_asked_again(spark, monkeypatch):
    """With a sketch of 4 marks and an accuracy below theirs, windows may miss; the result stays."""
    monkeypatch.setattr(Q, "MARKS", 64)
    monkeypatch.setattr(Q, "ACCURACY", 4)
    v = np.random.default_rng(7).normal(size=3_001)
    table = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)
    assert Q.medians(table, "v", bound=10).first()["median"] == np.median(v)


def test_without_rows(spark):
    empty = spark.createDataFrame([], "a int, v double")
    assert [tuple(r) for r in Q.medians(empty, "v").collect()] == [(None,)]
    assert not Q.medians(empty, "v", "a").collect()
