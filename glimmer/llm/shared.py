"""Helpers that the text operators share: tables, spreading hot keys, word splitting; ``cut`` writes
a table to the shared folder and reads it back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import materialise as cut

__all__ = ["SALT", "WORD_BREAK", "beside", "cut", "in_fold", "number_words", "slices", "split_words", "table"]

#: What separates words: the space and the controls from tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key are spread over so many groups before they meet their key's total.
SALT = 256


def beside(rows: DataFrame, key: str, spread: str, value: F.Column, merge, name: str) -> DataFrame:
    """``rows`` with a column ``name``: the aggregate ``value`` over all rows of the same ``key``, whose
    partial results ``merge`` combines. Rows meet it by key and a hash of ``spread``, so that one
    hot key's rows are dealt to many tasks; only SALT partial results a key ever meet."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    part = salted.groupBy(key, "_salt").agg(value.alias(name))
    whole = part.groupBy(key).agg(merge(name).alias(name))
    return salted.join(part.select(key, "_salt").join(whole, key), [key, "_salt"]).drop("_salt")


def in_fold(column: str, buckets: int, fold: int) -> F.Column:
    """True where crc32 of the id's decimal text falls into ``fold``; a null id never does."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % buckets == fold, F.lit(False))


class Numbering(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def split_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at ASCII white space; bytes methods do just that."""
    return text.encode().lower().split() if text else []


def number_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of all texts as numbers of distinct words, the end position of each text,
    and the distinct words by number."""
    numbers = Numbering()
    parts, ends, total = [], np.empty(len(texts), np.int64), 0
    get = numbers.__getitem__
    for i, text in enumerate(texts):
        words = split_words(text)
        parts.append(np.fromiter(map(get, words), np.int32, len(words)))
        total += len(words)
        ends[i] = total
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), ends, list(numbers)


def slices(batch, column: str, chars: int = 8_000_000):
    """Cut an Arrow batch into runs of rows whose texts hold about ``chars`` bytes,
    so that a task's memory does not follow the batch size; a row is never cut."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)
