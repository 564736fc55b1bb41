"""Near-duplicate embeddings by sorted projection passes.

Each pass draws random hyperplanes; a vector's key is the concatenation of the signs. Vectors are
ordered by pass and key, every vector is compared with a bounded window of its followers, and
verified pairs are united across passes. Equal vectors collapse before the passes. What moves
through the passes is the unit vector in half precision: pairs so near the limit that rounding
could decide them are verified once more on the vectors themselves in double precision.
The number of passes grows with the number of different vectors, so that recall does not fall.
Within the components so found, all pairs are then verified in blocks in double precision, so that
the links counted are all the component's links and not only those that a window showed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import beside, cut, table
from .simhash import roots

COSINE = 0.9
#: Passes at least, signs a key, followers a vector is compared with.
PASSES, SIGNS, WINDOW = 8, 64, 256
#: Rows of a component that one task compares with as many others; smaller components are split into
#: up to 8 blocks of SPLIT rows, so that one group of copies is not one task.
BLOCK, SPLIT = 4_096, 128
SEED = 77
#: Expected share of isolated pairs just at the cosine that some window shows.
RECALL = 0.99
#: What rounding two unit vectors to half precision can change in their product: twice half a unit
#: in the last of 11 digits, and a little for sums in single precision.
ROUNDING = 2.0**-10 + 2.0**-13


def passes_for(count: int, cosine: float) -> int:
    """Passes that show a pair at ``cosine`` with chance RECALL among ``count`` spread vectors. One
    pass shows it where about log2(count / WINDOW) leading signs agree, each with chance 1 - angle / pi."""
    agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    shown = agree ** np.log2(max(count / WINDOW, 1))
    return PASSES if shown >= 1 else max(PASSES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-shown))))


def planes(size: int, one_pass: int) -> np.ndarray:
    return np.random.default_rng([SEED, one_pass]).normal(size=(size, SIGNS))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def keyed(vectors: DataFrame, passes: int) -> DataFrame:
    """(pass, key, node, half): every vector once a pass, its signs as a number that orders like
    their text, and its unit vector in half precision as bytes. Lengths do not share passes."""

    def run(batches):
        import pyarrow as pa

        drawn: dict = {}
        for batch in batches:
            for size in np.unique(batch.column("size").to_numpy()):
                own = batch.filter(pa.array(batch.column("size").to_numpy() == size))
                units = matrix(own.column("v"))
                halves = np.ascontiguousarray(units.astype("<f2"))
                ends = np.arange(len(units) + 1, dtype=np.int32) * (2 * int(size))
                packed = pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(ends), pa.py_buffer(halves)])
                for p in range(passes):
                    if (p, size) not in drawn:
                        drawn[p, size] = planes(int(size), p)
                    signs = units @ drawn[p, size] > 0
                    keys = np.packbits(signs, axis=1).copy().view(">u8").ravel().astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), int(size) * passes + p, np.int32)), pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)), own.column("node"), packed],
                        ["pass", "key", "node", "half"],
                    )

    kinds = dict(vectors.dtypes)
    return vectors.select("node", "v", F.size("v").alias("size")).mapInArrow(run, f"pass int, key bigint, node {kinds['node']}, half binary")


def window_pairs(passes: np.ndarray, units: np.ndarray, fresh: int, cosine: float, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows from ``fresh`` on with rows up to ``window`` before them in the same pass, where their
    product is about ``cosine`` or more: the earlier row, the later row, whether rounding may decide."""
    left, right, unsure = [], [], []
    for start in range(fresh, len(units), window):
        stop, low = min(start + window, len(units)), max(0, start - window)
        near = units[start:stop] @ units[low:stop].T
        i, j = np.nonzero(near >= cosine - ROUNDING)
        a, b = j + low, i + start
        stay = (a < b) & (b - a <= window) & (passes[a] == passes[b])
        left.append(a[stay])
        right.append(b[stay])
        unsure.append(near[i[stay], j[stay]] < cosine + ROUNDING)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, unsure))


def window_links(vectors: DataFrame, cosine: float, passes: int, window: int = WINDOW) -> DataFrame:
    """Edges (a, b) that connect what the windows of all passes link: in each run of rows, each
    node with the least node it reaches there. The first and last ``window`` rows of every partition
    meet once more by pass, so that windows reach over the partitions' borders. Pairs that rounding
    may decide, unless other links join them in their run, are verified on the vectors."""
    node = dict(vectors.dtypes)["node"]

    def links(batches, borders):
        import pyarrow as pa

        held: list = [None, None, None]
        empty = lambda n, name: pa.nulls(n, out.field(name).type)

        def edges(a, b, unsure):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), unsure)), *[empty(len(a), c) for c in ("pass", "key", "half")]], schema=out)

        def border(rows):
            own = [rows.column("node"), empty(rows.num_rows, "b"), empty(rows.num_rows, "unsure")]
            return pa.RecordBatch.from_arrays([*own, *[rows.column(c) for c in ("pass", "key", "half")]], schema=out)

        out, seen, last = None, 0, []
        for batch in batches:
            if out is None:
                kind = batch.schema.field("node").type
                out = pa.schema([("a", kind), ("b", kind), ("unsure", pa.bool_()), *[(c, batch.schema.field(c).type) for c in ("pass", "key", "half")]])
            if not batch.num_rows:
                continue
            if borders:
                if seen < window:
                    yield border(batch.slice(0, window - seen))
                start = max(0, batch.num_rows - window)
                last.append((seen + start, batch.slice(start)))
                while len(last) > 1 and seen + batch.num_rows - last[1][0] >= window:
                    last.pop(0)
                seen += batch.num_rows
            sizes = np.diff(np.frombuffer(batch.column("half").buffers()[1], np.int32)[batch.column("half").offset :][: batch.num_rows + 1])
            cuts = np.flatnonzero(np.diff(sizes)) + 1  # vectors of several lengths are in different passes
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(s, e - s)
                raw = b"".join(part.column("half").to_pylist())
                order, nodes = part.column("pass").to_numpy(), part.column("node").to_numpy()
                units = np.frombuffer(raw, "<f2").reshape(e - s, -1).astype(np.float32)
                fresh = 0
                if held[0] is not None and held[2].shape[1] == units.shape[1]:
                    fresh = len(held[0])
                    order, nodes, units = (np.concatenate([x, y]) for x, y in zip(held, (order, nodes, units), strict=True))
                a, b, unsure = window_pairs(order, units, fresh, cosine, window)
                if len(a):
                    label = roots(len(nodes), a[~unsure], b[~unsure])
                    moved = np.flatnonzero(label != np.arange(len(nodes)))
                    yield edges(nodes[moved], nodes[label[moved]], False)
                    apart = unsure & (label[a] != label[b])
                    yield edges(nodes[a[apart]], nodes[b[apart]], True)
                held = [order[-window:], nodes[-window:], units[-window:]]
        for at, rows in last:
            skip = max(window, seen - window) - at  # the first are out already
            if skip < rows.num_rows:
                yield border(rows.slice(max(skip, 0)))

    form = f"a {node}, b {node}, unsure boolean, pass int, key bigint, half binary"
    ordered = keyed(vectors, passes).repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    found = cut(ordered.mapInArrow(lambda batches: links(batches, True), form), "windows")
    rows = found.where("b is null").select("pass", "key", F.col("a").alias("node"), "half")
    across = rows.repartition("pass").sortWithinPartitions("pass", "key", "node").mapInArrow(lambda batches: links(batches, False), form)
    every = cut(found.where("b is not null").union(across).select("a", "b", "unsure").distinct(), "window-edges")
    ends = [vectors.select(F.col("node").alias(c), F.col("v").alias(f"v{c}")) for c in ("a", "b")]
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)
    product = total("va", "vb") / F.sqrt(total("va", "va") * total("vb", "vb"))
    verified = every.where("unsure").join(ends[0], "a").join(ends[1], "b").where(product >= cosine)
    return every.where("not unsure").select("a", "b").union(verified.select("a", "b"))


def block_links(members: DataFrame, cosine: float) -> DataFrame:
    """(node, n): for every node of a component the rows it is linked with, ``copies`` counted.
    A component is split into blocks of about BLOCK nodes, and one task compares two of them."""
    sized = beside(cut(members, "members"), "component", "node", F.count("*"), F.sum, "size")
    few = F.least(F.lit(8), F.ceil(F.col("size") / F.lit(SPLIT)))
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), few).cast("int")
    placed = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = placed.select("component", "node", "copies", "v", "block", F.explode(others).alias("other")).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "v"
    )

    def run(group):
        import pyarrow as pa

        node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        units = matrix(group.column("v").combine_chunks())
        out = np.zeros(len(node), np.int64)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for i in range(0, len(left), 512):
            some = left[i : i + 512]
            close = units[some] @ units[right].T >= cosine
            if low == high:
                close[np.arange(len(some)), i + np.arange(len(some))] = False
                out[some] += close @ copies[right]
            else:
                out[some] += close @ copies[right]
                out[right] += copies[some] @ close
        return pa.table({"node": node, "n": out})

    return dealt.groupBy("component", "low", "high").applyInArrow(run, f"node {dict(members.dtypes)['node']}, n bigint").groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links (other rows at ``cosine`` or more), component_id (the least id
    that links reach), kept (whether the id is the component's).

    Null, empty and zero vectors, and vectors with null or non-finite components, link with nothing;
    so do rows without an id, whose component is null. Vectors of different lengths never link.
    Equal vectors always link, also as repeated rows of one id. Other columns are not read. An
    empty table gives an empty result. Links are never false; an isolated pair just at ``cosine``
    is missed with a chance of 1 - RECALL, nearer pairs more seldom.
    """
    values = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce(
        F.col(id_column).isNotNull() & F.forall(values, finite) & F.exists(values, lambda x: x != 0), F.lit(False)
    )
    own = rows.select(F.col(id_column).alias("_id"), F.when(usable, values).alias("_v"))
    named = own.withColumn("_key", F.xxhash64("_v"))
    # equal vectors collapse; the key only spreads them, the vector itself decides
    classes = cut(named.where("_v is not null").groupBy("_key", "_v").agg(F.min("_id").alias("node"), F.count("*").alias("copies")), "vectors").withColumnRenamed("_v", "v")
    groups = cut(components(cut(window_links(classes, cosine, passes_for(classes.count(), cosine)), "window-links"), "a", "b"), "vector-groups")
    members = classes.join(groups, "node").select("node", "component", "copies", "v")
    counted = block_links(members, cosine)
    known = cut(
        classes.join(groups, "node", "left").join(counted, "node", "left").select(
            "_key", F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
        ),
        "known-vectors",
    )
    return named.join(known, ["_key", "_v"], "left").select(
        F.col("_id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(True)).alias("kept"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLES: dict = {}
