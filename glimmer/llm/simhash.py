"""Near-duplicate groups by SimHash fingerprints, found with pivot distance tables.

Every fingerprint gets a table of Hamming distances to reference fingerprints (pivots), kept per
block of bits. Fingerprints that differ in ``distance`` bits agree on all but ``distance`` blocks
at most, so they have equal pivot coordinates on some choice of the other blocks: those
coordinates are the bucket key. Within a bucket, pairs whose coordinates over the whole
fingerprint differ by more than ``distance`` at any pivot are discarded (triangle inequality),
and only survivors are compared bit by bit. Both steps are exact: no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import SALT, beside, cut, slices, split_words, table

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Blocks of the fingerprint; a bucket key covers all but ``distance`` of them.
BLOCKS = 4
#: Reference fingerprints, drawn with a fixed seed.
PIVOTS = np.random.default_rng(20240501).integers(0, 2**64, 24, np.uint64)
#: A bucket of more different fingerprints is not compared in one task: its fingerprints
#: meet by the keys of their one-bit neighbours instead, which is exact as well.
BUCKET_ROWS = 20_000
#: So many ids of documents that go are sent to every task (about 60 bytes each there); more are shuffled.
BROADCAST_IDS = 2_000_000
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the shingles' XXH64; 0 without words."""
    import xxhash

    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= size:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.empty(n, np.int64)
        starts[0], starts[1:] = 0, ends[:-1]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            [digest(joined[a:b], seed) for a, b in zip(starts[: n - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)],
            "<u8", n - size + 1,
        )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ BITS
        value = int(np.packbits(2 * ones > len(hashes))[0])
        bits |= value << (8 * k)
    return bits


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, one row per document."""
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, text):
                found = np.array([simhash(split_words(t)) for t in batch.column(text).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(found.view(np.int64))], [id_column, "fp"])

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {key}, fp bigint")


def block_masks(blocks: int = BLOCKS) -> np.ndarray:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    return np.array([(2**b - 1) ^ (2**a - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.uint64)


def pivot_tables(fps: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """(fingerprint, block, pivot) distances of unsigned fingerprints."""
    apart = fps[:, None, None] ^ PIVOTS[None, None, :]
    return np.bitwise_count(apart & block_masks(blocks)[None, :, None]).astype(np.uint8)


def close_pairs(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different fingerprints within ``distance``: sorted by the first pivot's distance, a
    row meets only rows at most ``distance`` further; each next pivot discards more; survivors are verified."""
    far = pivot_tables(fps).sum(1, dtype=np.uint8).astype(np.int16)
    order = np.argsort(far[:, 0], kind="stable")
    fps, far = fps[order], far[order]
    reach = np.searchsorted(far[:, 0], far[:, 0] + distance, "right")
    left, right = [], []
    rows = max(1, 2_000_000 // len(fps))
    for start in range(0, len(fps), rows):
        stop = min(start + rows, len(fps))
        counts = reach[start:stop] - np.arange(start + 1, stop + 1)
        a = np.repeat(np.arange(start, stop), counts)
        b = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + a + 1
        for p in range(1, far.shape[1]):
            if len(a) < 64:
                break
            stay = np.abs(far[a, p] - far[b, p]) <= distance
            a, b = a[stay], b[stay]
        stay = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        left.append(a[stay])
        right.append(b[stay])
    return order[np.concatenate(left)], order[np.concatenate(right)]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` nodes' components."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect whatever is linked within
    ``distance``: per bucket a spanning forest of the verified links, not all pairs."""
    chosen = list(combinations(range(blocks), blocks - distance))

    def deal(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            own = batch.column("fp").to_numpy()
            far = pivot_tables(own.view(np.uint64), blocks)
            for c, kept in enumerate(chosen):
                part = np.ascontiguousarray(far[:, kept, :]).reshape(len(own), -1)
                keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), c) for row in part], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own)], ["key", "fp"])

    def connect(batches):
        import pyarrow as pa

        def close(held):
            own = np.unique(np.concatenate(held))
            if len(own) < 2:
                return None
            label = roots(len(own), *close_pairs(own.view(np.uint64), distance))
            moved = np.flatnonzero(label != np.arange(len(own)))
            return own[moved], own[label[moved]]

        def batch_of(a, b, hot):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

        key, held, rows, hot = None, [], 0, False
        for batch in batches:
            keys, own = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            out_a, out_b, out_hot = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if keys[s] != key:
                    if held and not hot and (found := close(held)):
                        out_a.append(found[0])
                        out_b.append(found[1])
                    key, held, rows, hot = keys[s], [], 0, False
                held.append(own[s:e])
                rows += e - s
                hot |= rows > BUCKET_ROWS
                if hot:
                    out_hot += held
                    held = []
            if out_a:
                yield batch_of(np.concatenate(out_a), np.concatenate(out_b), False)
            if out_hot:
                every = np.concatenate(out_hot)
                yield batch_of(every, every, True)
        if held and not hot and (found := close(held)):
            yield batch_of(*found, False)

    # no shuffle merges equal fingerprints here: the caller passes different ones
    dealt = fps.select("fp").mapInArrow(deal, "key bigint, fp bigint")
    found = cut(
        dealt.repartition("key").sortWithinPartitions("key").mapInArrow(connect, "a bigint, b bigint, hot boolean"), "links"
    )
    # Two fingerprints are within 2 if and only if some value is within 1 of both.
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    if distance != 2:
        raise ValueError("buckets beyond BUCKET_ROWS are resolved for a distance of 2 only")
    met = found.where("hot").select(F.col("a").alias("fp")).distinct().select("fp", F.explode(near).alias("z"))
    least = met.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    hot = met.join(least, "z").select(F.col("fp").alias("a"), "b")
    return found.where("not hot").select("a", "b").union(hot).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component_id) for every document: component_id is the smallest id that links
    of fingerprints within ``distance`` bits reach, the document itself included.

    Null and empty texts have fingerprint 0 and link like any other. Rows with equal fingerprints
    collapse before the search, so copies cost one row each. Repeated rows and ids keep their rows.
    Texts of any length count whole; of tied ids in a group the smallest is one value.
    A null id gets the component of its fingerprint (null if all ids there are null). Other columns
    are not read; an empty table gives an empty result.
    """
    return grouped(docs, id_column, text, distance).select(id_column, "fp", "component_id")


def grouped(docs: DataFrame, id_column: str, text: str, distance: int = DISTANCE) -> DataFrame:
    """``near_duplicates`` with ``first_fp``: the least fingerprint that has the id ``component_id`` in the group."""
    own = cut(fingerprints(docs, id_column, text), "fingerprints")
    distinct = cut(own.groupBy("fp").agg(F.min(id_column).alias("least")), "distinct-fingerprints")
    groups = components(links(distinct, distance), "a", "b")
    joined = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", F.col("fp").alias("first_fp"))))
    least = beside(joined, "component", "fp", first, F.min, "first").select("fp", F.col("first.least").alias("component_id"), "first.first_fp")
    named = cut(least, "named-fingerprints")
    # rows of one fingerprint, such as all empty texts, meet its group in SALT parts
    salted = own.withColumn("_salt", F.pmod(F.xxhash64(id_column), F.lit(SALT)).cast("int"))
    parts = salted.select("fp", "_salt").distinct().join(named, "fp")
    return salted.join(parts, ["fp", "_salt"]).select(id_column, "fp", "component_id", "first_fp")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group, a row with the smallest id stays.

    Rows of a repeated id are told apart by their fingerprints; of equal ones a single row stays. Rows
    without an id cannot be told apart and stay. Null and empty texts are near duplicates of each other.
    Texts of any length count whole. Columns of any name are kept. An empty table gives an empty result.

    The ids that go are few against the documents: up to BROADCAST_IDS, counted first, are sent to every
    task, so that no text moves; more meet the documents in a shuffle.
    """
    found = cut(grouped(docs, id_column, text).withColumnRenamed(id_column, "id"), "groups")
    first = (F.col("id") == F.col("component_id")) & (F.col("fp") == F.col("first_fp"))
    ids = found.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.max(first).alias("stays"))
    gone = cut(ids.where("n > 1 or not stays").select("id", "stays", (F.col("n") > 1).alias("again")), "gone-ids")
    n, again = gone.agg(F.count("*"), F.sum(F.when(F.col("again") & F.col("stays"), 1))).first()
    sent = lambda df: F.broadcast(df) if n <= BROADCAST_IDS else df
    away = sent(gone.select(F.col("id").alias("_gone")))
    out = docs.join(away, docs[id_column] == away["_gone"], "left_anti")
    if again:  # the rows of repeated ids, by fingerprint
        twice = sent(gone.where("again and stays").select(F.col("id").alias("_again")))
        rows = docs.join(twice, docs[id_column] == twice["_again"], "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
        own = fingerprints(rows, "_row", "_text").select("_row", F.col(f"_row.{id_column}").alias("_id"), F.col("fp").alias("_fp"))
        stay = found.where(first).select(F.col("id").alias("_id"), F.col("fp").alias("_fp")).distinct()
        out = out.unionByName(own.join(stay, ["_id", "_fp"]).dropDuplicates(["_id", "_fp"]).select("_row.*"))
    return out


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
ORACLES: dict = {}
