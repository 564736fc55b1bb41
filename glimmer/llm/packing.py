"""Best-fit packing of tokenised documents into sequences of fixed capacity by bin completion.

Documents are tokenised once, cut into pieces of at most ``capacity`` tokens, and the pieces'
lengths are counted. How many pieces there are of each length is all that packing needs, and
that histogram has at most ``capacity`` entries however large the corpus is, so the search runs
on it: each step enumerates undominated fillings around the largest length that is left, prunes
by the waste that the best known packing still allows, and takes a filling as often as the
counts permit. The plan (runs of equal sequences) is then dealt out to the pieces by their rank
within their length; ranks come from counts per (partition, length), so no length, however
frequent, is gathered in one task.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, slices, table

CAPACITY = 2048
#: Chunks, and words, whose ids a Python worker remembers: two generations of so many, about 200
#: bytes each; the older is forgotten when the newer is full, so frequent ones stay.
CACHE_ENTRIES = 240_000
#: Nodes of the search before the incumbent is kept; None: none is too many.
SEARCH_NODES: int | None = 60_000


def byte_letters() -> dict[int, str]:
    """The letters that stand for the bytes that byte-level vocabularies do not show as themselves:
    in order, they get the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered(dict):
    """Makes missing values and keeps two generations of them."""

    def __init__(self, make) -> None:
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkTokenizer:
    """Ids of a text as little-endian 32-bit bytes, by way of its white-space separated chunks.

    The tokenizer drops white space and merges nothing across it, so a text's ids are those of
    its chunks in order. A chunk of Latin text is split here, by the tokenizer's own pattern, and
    its words go straight to the merges; any other chunk goes through the whole tokenizer.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.known = Remembered(self._chunk)
        self.words = Remembered(self._word)
        self.split = regex.compile(self.PATTERN).findall

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(spelt)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text.isascii() and text.isalpha():
            return self.words[text.lower()]
        # Other alphabets may compose anew, or have a lower case that depends on the place.
        if "<|" in text or max(text) >= "\u0180" or len(text) > 200:
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        get = self.known.__getitem__
        for text in texts:
            yield b"".join(map(get, text.encode().split())) if text else b""


@cache
def tokenizer_at(path: str) -> ChunkTokenizer:
    """One a Python worker, so that what it remembers serves its next tasks too."""
    return ChunkTokenizer(path)


@dataclass
class Run:
    """``times`` sequences that hold pieces of these lengths."""

    lengths: list[int]
    times: int


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """Best fit in descending order of length, over runs of equal bins: each length goes to the
    fullest bins that take it, else to new ones."""
    bins: dict[int, list[Run]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, capacity) if bins.get(r)), capacity)
            fits = room // length
            run = bins[room].pop() if room < capacity else Run([], -(-left // fits))
            full, rest = divmod(left, fits)
            take = min(run.times, full)
            if take:
                bins.setdefault(room - fits * length, []).append(Run([*run.lengths, *[length] * fits], take))
                left -= take * fits
                if room < capacity and run.times > take:
                    bins.setdefault(room, []).append(Run(run.lengths, run.times - take))
            else:
                bins.setdefault(room - rest * length, []).append(Run([*run.lengths, *[length] * rest], 1))
                left -= rest
                if room < capacity and run.times > 1:
                    bins.setdefault(room, []).append(Run(run.lengths, run.times - 1))
    return [run for runs in bins.values() for run in runs]


def fewest_possible(counts: np.ndarray, capacity: int, numbers: bool = True) -> int:
    """A lower bound on the sequences that ``counts`` need: the largest of the volume, of the bounds
    that split pieces at half the capacity and at each smaller length, of those by roundings to k-ths of
    a sequence, under which no filling can exceed one sequence, and of those by the number of pieces
    that sequences can hold (left out without ``numbers``), for all pieces and for those of at least a
    k-th of a sequence."""
    n, length = np.asarray(counts, np.int64), np.arange(len(counts))
    volume = int((n * length).sum())
    best = -(-volume // capacity)
    many, sums = np.cumsum(n), np.cumsum(n * length)
    half, last = capacity // 2, len(n) - 1
    least = np.arange(1, half + 1)  # pieces shorter than this are left out of the count
    top, mid, low = np.minimum(capacity - least, last), min(half, last), np.minimum(least - 1, last)
    large, middle = many[-1] - many[top], many[top] - many[mid]
    small = sums[mid] - sums[low] - (middle * capacity - (sums[top] - sums[mid]))
    best = max(best, int((large + middle + np.maximum(0, -(-small // capacity))).max(initial=0)))
    k = np.arange(1, 33)[:, None]
    whole = (k + 1) * length
    rounded = np.where(whole % capacity == 0, whole * k, whole // capacity * (k + 1) * capacity)  # in units of 1 / (k (k + 1) capacity)
    best = max(best, int((-(-(n * rounded).sum(1) // (k * (k + 1) * capacity)[:, 0])).max()))
    if not numbers:
        return best
    return max([best, *(by_numbers(np.where(length >= capacity // part, n, 0), capacity) for part in (capacity, 12, 9, 7, 6, 5, 4, 3))])


def holding(counts: np.ndarray, capacity: int) -> np.ndarray:
    """For c = 1, 2, ...: how many sequences at most can hold c pieces each, by the c x k shortest pieces,
    whose total is at most k sequences' for no larger k."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return np.zeros(0, np.int64)
    many = np.cumsum(counts[lengths])
    sums = np.cumsum(counts[lengths] * lengths)
    c = np.arange(1, min(int(many[-1]), capacity // int(lengths[0])) + 1)

    def shortest(m: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(many, m), len(many) - 1)
        return sums[at] - (many[at] - m) * lengths[at]

    low, high = np.zeros(len(c), np.int64), many[-1] // c
    while (low < high).any():
        mid = (low + high + 1) // 2
        fits = shortest(c * mid) <= mid * capacity
        low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
    return low


def by_numbers(counts: np.ndarray, capacity: int) -> int:
    """The least B for which the pieces can be spread: those that come c-th in their sequence are at most
    as many as B and as the sequences that can hold c."""
    pieces, most = int(counts.sum()), holding(counts, capacity)
    if not pieces:
        return 0
    # sum of min(B, most[c]) over c, with most in descending order
    upto = np.append(np.cumsum(most[::-1])[::-1], 0)
    low, high = 1, pieces
    while low < high:
        mid = (low + high) // 2
        above = int(np.searchsorted(-most, -mid, "right"))  # entries of mid and more
        if above * mid + int(upto[above]) >= pieces:
            high = mid
        else:
            low = mid + 1
    return low


class Budget:
    """How many more nodes a search may look at; None: as many as it takes."""

    def __init__(self, nodes: int | None) -> None:
        self.left = nodes

    def spend(self, nodes: int = 1) -> bool:
        if self.left is None:
            return True
        self.left -= nodes
        return self.left >= 0


def fillings(counts: np.ndarray, room: int, most_waste: int, budget: Budget) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` with available lengths, as (waste, lengths), as they are
    found: those that waste little first, in bands of waste up to ``most_waste``.

    Lengths are tried in descending order; a branch ends where no sum of available pieces brings
    the waste into the band. A filling is dominated if an available longer piece could replace one
    of its pieces and still fit, or if a piece could be added.
    """
    there = [int(x) for x in np.flatnonzero(counts[: room + 1])]
    # bit s of reach[i]: pieces of the first i lengths have a sum of s
    reach, full = [1], (1 << room + 1) - 1
    for x in there:
        sums, times, step = reach[-1], min(int(counts[x]), room // x), 1
        while times > 0:
            step = min(step, times)
            sums |= sums << x * step & full
            times -= step
            step *= 2
        reach.append(sums)
    if not budget.spend(1 + len(there) // 16):
        return

    def undominated(waste: int, chosen: list[int]) -> bool:
        return not any(
            int(counts[y]) > chosen.count(y) for x in {0, *chosen} for y in there[bisect_right(there, x) : bisect_right(there, x + waste)]
        )

    low = -1
    for high in sorted({min(w, most_waste) for w in (0, 1, 3, 7, 15, 31, 63, 127, 255, 511, most_waste)}):
        if not reach[-1] >> max(0, room - high) & (1 << max(0, high - low)) - 1:
            low = high
            continue
        # one entry a chosen piece: the index in ``there`` up to which the next piece may come
        chosen: list[int] = []
        left, upto = room, [len(there) - 1]
        while upto:
            if not budget.spend():
                return
            at = min(upto[-1], bisect_right(there, left) - 1)
            while at >= 0 and int(counts[there[at]]) <= chosen.count(there[at]):
                at -= 1
            if at >= 0 and reach[at + 1] >> max(0, left - high) & (1 << min(high, left) + 1) - 1:
                chosen.append(there[at])
                left -= there[at]
                upto[-1] = at - 1  # after this piece, a shorter one takes its place
                upto.append(at)
                continue
            if low < left <= high and undominated(left, chosen):
                yield left, tuple(chosen)
            upto.pop()
            if chosen:
                left += chosen.pop()
        low = high


def filled_with(counts: np.ndarray, capacity: int, c: int, sequences: int, budget: Budget) -> list[Run]:
    """Sequences of c or more pieces out of the c x ``sequences`` shortest pieces, each around the largest
    left there with the filling that wastes least; then best fit of all other pieces."""
    pool, want = np.zeros_like(counts), c * sequences
    for length in np.flatnonzero(counts):
        pool[length] = min(int(counts[length]), want)
        want -= int(pool[length])
    rest, runs = counts - pool, []
    while pool.any() and budget.spend():
        largest = int(np.flatnonzero(pool)[-1])
        pool[largest] -= 1
        found = next((f for _, f in fillings(pool, capacity - largest, capacity, budget) if len(f) >= c - 1), None)
        pool[largest] += 1
        if found is None:
            rest[largest] += pool[largest]
            pool[largest] = 0
            continue
        pieces = [largest, *found]
        need = {x: pieces.count(x) for x in pieces}
        times = min(int(pool[x]) // n for x, n in need.items())
        for x, n in need.items():
            pool[x] -= n * times
        runs.append(Run(pieces, times))
    return runs + best_fit(rest + pool, capacity)


def first_packing(counts: np.ndarray, capacity: int, least: int, nodes: int | None) -> list[Run]:
    """Best fit, or a better packing by numbers of pieces: for c from 2 to 8, as many sequences of c
    pieces as there can be, and a few per cent fewer. Ends when one meets ``least``; each may look at
    ``nodes`` nodes."""
    best = best_fit(counts, capacity)
    bins, most = sum(r.times for r in best), holding(counts, capacity)
    for c in range(2, min(len(most), 8) + 1):
        for share in (1.0, 0.985, 0.97, 0.94):
            sequences = int(most[c - 1] * share)
            if bins <= least or not sequences:
                break
            made = filled_with(counts, capacity, c, sequences, Budget(nodes))
            if sum(r.times for r in made) < bins:
                best, bins = made, sum(r.times for r in made)
    return best


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, nodes: int | None = SEARCH_NODES) -> list[Run]:
    """Runs of sequences that hold ``counts[length]`` pieces of each length, in as few sequences
    as the search finds; best fit, or a packing by numbers of pieces, gives the first incumbent.

    Each step takes the largest piece that is left and branches on its undominated fillings and on
    how often each is taken, most often first. Branches end where the waste so far, or the least
    that the rest needs, cannot beat the incumbent. The search is over when the incumbent meets the
    lower bound, when all branches are done (the result is optimal then), or after ``nodes`` nodes (each of at
    most 28 first packings may look at as many); with None it always ends with an optimal packing.
    """
    counts = np.asarray(counts, np.int64).copy()
    counts[0] = 0
    total = int((counts * np.arange(len(counts))).sum())
    least = fewest_possible(counts, capacity)
    budget = Budget(nodes)
    best = first_packing(counts, capacity, least, nodes)
    bins = sum(r.times for r in best)
    numbers = fewest_possible(counts, capacity, numbers=False) < least  # what bounds the whole bounds its parts
    left = counts.copy()

    def options(waste: int) -> Iterator[tuple[dict[int, int], Run, int]]:
        """Ways to go on: what is taken of each length, the run, and its waste in all."""
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        others = left.copy()
        left[largest] += 1
        for unused, filling in fillings(others, capacity - largest, (bins - 1) * capacity - total - waste, budget):
            pieces = [largest, *filling]
            need = {x: pieces.count(x) for x in pieces}
            most = min(int(left[x]) // n for x, n in need.items())
            for times in range(most, 0, -1):
                yield {x: n * times for x, n in need.items()}, Run(pieces, times), times * unused

    made: list[Run] = []
    taken: list[tuple[dict[int, int], int]] = []
    used = waste = 0
    open_ = [options(0)] if bins > least and total else []
    while open_ and bins > least:
        step = next(open_[-1], None)
        if step is None or budget.left is not None and budget.left < 0:
            if budget.left is not None and budget.left < 0:
                break
            open_.pop()
            if taken:
                need, unused = taken.pop()
                for x, n in need.items():
                    left[x] += n
                used -= made.pop().times
                waste -= unused
            continue
        need, run, unused = step
        budget.spend()
        if waste + unused > (bins - 1) * capacity - total:
            continue
        for x, n in need.items():
            left[x] -= n
        made.append(run)
        taken.append((need, unused))
        used += run.times
        waste += unused
        if not left.any():
            if used < bins:
                best, bins = list(made), used
        elif budget.spend(40 if numbers else 8) and used + fewest_possible(left, capacity, numbers) < bins:
            open_.append(options(waste))
            continue
        need, unused = taken.pop()
        for x, n in need.items():
            left[x] += n
        used -= made.pop().times
        waste -= unused
    return best


def token_pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, its partition and its rank there
    among pieces of its length; ``keep_ids`` adds the ids (binary, little-endian unsigned 32-bit)."""
    key = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {key}, piece int, start bigint, length bigint, ids_crc32 bigint, _part int, _rank bigint" + ", ids binary" * keep_ids

    def pieces(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, coder, seen = TaskContext.get().partitionId(), tokenizer_at(tokenizer), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, text):
                rows, ids = [], []
                where = []
                for i, coded in enumerate(coder.encode_all(batch.column(text).to_pylist())):
                    coded += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                        held = coded[at : at + 4 * capacity]
                        n = len(held) // 4
                        where.append(i)
                        rows.append((piece, at // 4, n, zlib.crc32(held), part, int(seen[n])))
                        seen[n] += 1
                        if keep_ids:
                            ids.append(held)
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                arrays = [batch.column(id_column).take(pa.array(where, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                names = [id_column, "piece", "start", "length", "ids_crc32", "_part", "_rank"]
                if keep_ids:
                    arrays.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(id_column, text).mapInArrow(pieces, schema)


def slots(runs: list[Run], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan by (length, first rank): lengths, first ranks, the sequence of that rank, the offset."""
    given = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for run in runs:
        at = 0
        for n in run.lengths:
            rows.append((n, int(given[n]), sequence, at))
            given[n] += run.times
            at += n
        sequence += run.times
    found = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return found[:, 0], found[:, 1], found[:, 2], found[:, 3]


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, nodes: int | None = SEARCH_NODES) -> DataFrame:
    """Tokenise, cut and pack; one row per piece with its sequence_id and offset there.

    Null and empty texts become the end id alone, so they keep their row, as do null and repeated
    ids. Only documents of more than ``capacity`` tokens are cut. Offsets within a sequence are
    gapless from 0. Texts of any length are tokenised whole. Pieces of one length are dealt by
    partition and place there. ``nodes`` bounds the search (see ``complete_bins``). Other columns are
    not read. An empty table gives an empty result.
    """
    pieces = cut(token_pieces(docs, tokenizer, id_column, text, capacity, keep_ids), "pieces")
    by_part = cut(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[row["length"]] = row["n"]
    length_of, first_rank, first_sequence, offset_of = slots(complete_bins(counts, capacity, nodes), capacity)
    # one number that orders (length, rank); ranks stay below the number of pieces
    stride = int(counts.max()) + 1
    starts = length_of * stride + first_rank

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    own = [c for c in pieces.columns if not c.startswith("_")]
    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.select(own).dtypes)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(starts, n * stride + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(first_sequence[at] + rank - first_rank[at]), pa.array(offset_of[at])],
                [*own, "sequence_id", "offset"],
            )

    return ranked.select(*own, "_rank").mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict = {}
