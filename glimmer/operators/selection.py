"""Exact medians of columns of any length, without one task that holds a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise

#: A key with at most so many values is sorted in one task, a few hundred kilobytes.
BOUND = 16_384
#: Marks that a sketch sets on a key's values in each round, and the sketch's accuracy (its error in ranks is
#: the number of values over it, a quarter of the distance of two marks).
MARKS, ACCURACY = 512, 2_048
#: Up to so many long keys are sent to every task; rows of more meet them in SALT parts a key.
SENT_KEYS, SALT = 100_000, 64


def medians(rows: DataFrame, value: str | Column, /, *keys: str, bound: int = BOUND, long: tuple[DataFrame, int] | None = None, **others: Column) -> DataFrame:
    """(keys, median, others): the exact median of ``value`` by key, or of all rows without keys, beside further
    aggregates. Equal to Spark's ``median``: nulls do not count, a key without a value has null, the two
    middle values are averaged, an empty table has one null row without keys and none with.

    Keys of at most ``bound`` values take Spark's aggregate. Longer ones are selected by rank: each round sets
    marks on what is left of every key by a sketch that tasks merge, counts around the two marks that
    enclose the middle, and goes on with what lies between them, about a hundredth. Null keys are a key.
    ``rows`` is read twice, or five times where a key is long. ``long`` is what ``long_keys`` found for the same
    keys, where that is known.
    """
    v = F.col(value) if isinstance(value, str) else value
    key = _key(keys)
    found, count = long or long_keys(rows, v, *keys, bound=bound)
    if not count:
        return rows.groupBy(*keys).agg(F.median(v).alias("median"), *[c.alias(n) for n, c in others.items()])
    values = rows.select(key.alias("k"), v.cast("double").alias("v"))
    left = materialise(_beside(values.where("v is not null"), found.select("k"), count).select("k", "v"), "values")
    short = _beside(values, found.select("k"), count, "left_anti").groupBy("k").agg(F.median("v").alias("median"))
    middle = short.unionByName(_by_rank(left, found, count, bound))
    rest = rows.groupBy(*keys).agg(F.count(v).alias("_n"), *[c.alias(n) for n, c in others.items()])
    return rest.withColumn("k", key).join(middle, "k").select(*keys, "median", *others)


def _key(keys: tuple[str, ...]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def long_keys(rows: DataFrame, value: str | Column, *keys: str, bound: int = BOUND) -> tuple[DataFrame, int]:
    """(k, n) of the keys with more than ``bound`` values, and how many keys these are."""
    sized = rows.groupBy(*keys).agg(F.count(value).alias("n")).where(F.col("n") > bound).select(_key(keys).alias("k"), "n")
    if sized.isEmpty():
        return sized, 0
    kept = materialise(sized, "long-keys")
    return kept, kept.count()


def _beside(rows: DataFrame, table: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, one row a long key: sent where small, else dealt in parts of a key."""
    if count <= SENT_KEYS:
        return rows.join(F.broadcast(table), "k", how)
    dealt = rows.withColumn("_part", (F.monotonically_increasing_id() % SALT).cast("int"))
    parts = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(parts, ["k", "_part"], how).drop("_part")


def _by_rank(left: DataFrame, long: DataFrame, count: int, bound: int) -> DataFrame:
    """(k, median) of ``left`` (k, v) with ``long`` (k, n). The state of a key are the ranks a, b of its middle
    values among what is left of it, from 0, and by how many marks its window reaches beyond them."""
    half = lambda n: F.floor(n / 2).cast("long")
    n = F.col("n")
    state = long.select("k", "n", half(n - 1).alias("a"), half(n).alias("b"), F.lit(2).alias("reach"))
    done = None
    grid = [i / MARKS for i in range(MARKS + 1)]
    while True:
        small = state.where(n <= bound)
        ended = _beside(left, small, count).groupBy("k", "a", "b").agg(F.sort_array(F.collect_list("v")).alias("s"))  # at most ``bound`` values
        at = lambda c: F.element_at("s", (F.col(c) + 1).cast("int"))
        ended = ended.select("k", _middle(at("a"), at("b")).alias("median"))
        done = ended if done is None else done.unionByName(ended)
        state = state.where(n > bound)
        if state.isEmpty():
            return materialise(done, "medians")
        marks = _beside(left, state, count).groupBy("k", "n", "a", "b", "reach").agg(F.percentile_approx("v", grid, ACCURACY).alias("q"), F.min("v").alias("least"), F.max("v").alias("most"))
        first = F.floor(F.col("a") * MARKS / n) - F.col("reach")
        last = F.ceil((F.col("b") + 1) * MARKS / n) + F.col("reach")
        window = materialise(marks.select(
            "k", "n", "a", "b", "reach",
            F.when(first > 0, F.element_at("q", (F.greatest(first, F.lit(0)) + 1).cast("int"))).otherwise(F.col("least")).alias("lo"),
            F.when(last < MARKS, F.element_at("q", (F.least(last, F.lit(MARKS)) + 1).cast("int"))).otherwise(F.col("most")).alias("hi"),
        ), "windows")
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        inner = (v > lo) & (v < hi)
        tally = materialise(_beside(left, window, count).groupBy("k", "n", "a", "b", "reach", "lo", "hi").agg(
            F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if(inner).alias("inside"), F.count_if((v == hi) & (lo < hi)).alias("at_hi"),
            F.min(F.when(inner, v)).alias("head"), F.max(F.when(inner, v)).alias("tail"),
        ), "tallies")
        start = F.col("below") + F.col("at_lo")
        stop = start + F.col("inside")
        missed = (F.col("a") < F.col("below")) | (F.col("b") >= stop + F.col("at_hi"))
        # A middle value is a mark, or lies between them; where only one lies there it is the first or last that does.
        low = F.when(F.col("a") < start, lo).when(F.col("a") >= stop, hi).when(F.col("b") >= stop, F.col("tail"))
        high = F.when(F.col("b") < start, lo).when(F.col("b") >= stop, hi).when(F.col("a") < start, F.col("head"))
        settled = ~missed & low.isNotNull() & high.isNotNull()
        done = done.unionByName(tally.where(settled).select("k", _middle(low, high).alias("median")))
        open_ = tally.where(~settled).withColumn("missed", missed)
        cut = _beside(left, open_.select("k", "lo", "hi", "missed"), count).where(F.col("missed") | inner).select("k", "v")
        left = materialise(cut, "values")
        state = open_.select(
            "k", F.when(F.col("missed"), n).otherwise(F.col("inside")).alias("n"), F.when(F.col("missed"), F.col("a")).otherwise(F.col("a") - start).alias("a"),
            F.when(F.col("missed"), F.col("b")).otherwise(F.col("b") - start).alias("b"), F.when(F.col("missed"), F.col("reach") * 4).otherwise(F.lit(2)).alias("reach"),
        )


def _middle(low: Column, high: Column) -> Column:
    return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)
