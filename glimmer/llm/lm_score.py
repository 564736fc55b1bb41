"""Language-model scores: corpus word counts, and a log-bilinear model trained by noise contrast.

Words are known by their 64-bit hash. Counts over all training documents are gathered once and
kept as a table. Frequent words are units of the model, each with vectors of its own; all other
words, unknown ones too, share units by their last letters and are told apart within a unit by
their counts. The model adds the vectors of the units before a token, each weighed by its distance,
and predicts the token's unit in two steps: one of about sqrt(units) groups, then a unit of the group.

Training is distributed: every task trains a copy on all tokens of its own documents by noise-contrastive
estimation in numpy, in a random order, and the copies' rows are averaged by how often each was
drawn. Matrix products over all groups and over a group's units then give normalised
log-probabilities. Words whose counts are not broadcast meet them in one shuffle, as one row per
(document, word).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, in_fold, number_words, slices, table

#: Words with vectors of their own at most, their least count, and units of words by their last letters.
OWN_WORDS, LEAST_COUNT, FORMS, LETTERS = 15_360, 5, 1_024, 3
#: Words whose counts are broadcast (16 bytes each).
HEAD_WORDS = 65_536
#: Size of the vectors, words of context, noise groups a step, noise units a group and step, tokens a step, step size.
SIZE, CONTEXT, GROUP_NOISE, UNIT_NOISE, BATCH, RATE = 24, 2, 32, 8, 4_096, 0.2
#: Rounds of training and averaging. Over all rounds every token is visited as often as any other: once, or in
#: small corpora so often that there are about VISITS in all, MOST a token and round.
ROUNDS, VISITS, MOST = 2, 4_000_000, 8
#: Tokens whose chances are computed together, and rows of one product (which stays in a core's cache).
CHUNK, ROWS = 131_072, 512
#: Runs of so many rows or less are added up side by side.
LONG_RUN = 8
SEED = 0
#: Texts are marked as ended by one more token, which no word can equal.
END = b"\n"


def token_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, SEED) for w in words], np.uint64).view(np.int64)


def forms(words: list[bytes]) -> np.ndarray:
    """The number of the unit by last letters that each word would share."""
    import xxhash

    digest = xxhash.xxh32_intdigest
    return np.fromiter((digest(w[-LETTERS:], SEED) for w in words), np.int64, len(words)) % FORMS


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens with one end after each text, the end positions, and the hashes and forms by number."""
    ids, ends, words = number_words(texts)
    words = [*words, END]
    with_ends = np.insert(ids, ends, len(words) - 1) if len(texts) else ids
    return with_ends, ends + np.arange(1, len(texts) + 1), token_hashes(words), forms(words)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, form, n): how often each token occurs, summed in each task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, text, 16_000_000):
                ids, _, hashes, form = tokens_of(batch.column(text).to_pylist())
                n = np.bincount(ids, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[n > 0]), pa.array(form[n > 0].astype(np.int16)), pa.array(n[n > 0])], ["word", "form", "n"])

    found = docs.select(text).mapInArrow(run, "word bigint, form smallint, n bigint")
    return found.groupBy("word").agg(F.first("form").alias("form"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words as sorted hashes with their counts and units (-1: by its form), the
    unit of every form, the tokens and kinds of words that share it, and the mass of every unit.
    Units are numbered by falling mass; ``width`` of them make a group."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    form_units: np.ndarray
    form_norms: np.ndarray
    mass: np.ndarray
    end: int
    width: int

    def look_up(self, hashes: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts (-1: not among the most frequent), units, and what the count's part in its unit
        is divided by (0: the word is a unit)."""
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            counts, own = np.where(hit, self.counts[at], -1), np.where(hit, self.units[at], -1)
        else:
            counts = own = np.full(len(hashes), -1)
        return counts, np.where(own >= 0, own, self.form_units[form]), np.where(own >= 0, 0, self.form_norms[form])


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toArrow()  # a bounded table
    words, form, n = (top.column(c).to_numpy() for c in ("word", "form", "n"))
    own = min(OWN_WORDS, int((n >= LEAST_COUNT).sum()))
    tokens, kinds = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
    for row in counts.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # one row a form
        tokens[row["form"]], kinds[row["form"]] = row["n"], row["v"]
    np.subtract.at(tokens, form[:own], n[:own])
    np.subtract.at(kinds, form[:own], 1)
    norms = tokens + kinds + 1
    mass = np.concatenate([n[:own] + 1, norms]).astype(float)
    order = np.argsort(-mass, kind="stable")
    unit = np.empty(len(order), np.int64)
    unit[order] = np.arange(len(order))
    units = np.full(len(words), -1)
    units[:own] = unit[:own]
    at = np.argsort(words)
    end = token_hashes([END])[0]
    place = np.flatnonzero(words[:own] == end)
    ends = int(units[place[0]]) if len(place) else int(unit[own + forms([END])[0]])
    return Vocabulary(words[at], n[at], units[at], unit[own:], norms, mass[order], ends, int(np.ceil(np.sqrt(len(order)))))


@dataclass
class LogBilinear:
    """score = (sum over distances of context vector * reach of the distance) . target + bias, for groups
    and for the units of a group; the bias is the last column of ``group`` and ``unit``."""

    context: np.ndarray
    reach: np.ndarray
    group: np.ndarray
    unit: np.ndarray
    width: int

    @classmethod
    def new(cls, mass: np.ndarray, width: int, seed: int = 5) -> LogBilinear:
        """Small vectors, and biases that make every chance the unit's share of the mass."""
        rng, groups = np.random.default_rng(seed), -(-len(mass) // width)
        padded = np.concatenate([mass, np.zeros(groups * width - len(mass))]).reshape(groups, width)
        bias = lambda x: np.log(np.maximum(x, 1e-30))  # noqa: E731  units that do not exist have no chance
        draw = lambda n: rng.normal(0, 0.1, (n, SIZE))
        return cls(
            draw(len(mass)).astype(np.float32), np.ones((CONTEXT, SIZE), np.float32),
            np.hstack([draw(groups), bias(padded.sum(1, keepdims=True) / mass.sum())]).astype(np.float32),
            np.hstack([draw(groups * width), bias(padded / padded.sum(1, keepdims=True)).reshape(-1, 1)]).astype(np.float32), width,
        )

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.reach, self.group, self.unit]

    def queries(self, before: np.ndarray) -> np.ndarray:
        """(token, SIZE + 1) for the units before each token, the nearest first; the last column is 1."""
        out = np.ones((len(before), SIZE + 1), np.float32)
        out[:, :SIZE] = sum((self.context * self.reach[k]).take(before[:, k], 0) for k in range(CONTEXT))
        return out

    def log_chances(self, before: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's unit after the units before it."""

        def picked(query: np.ndarray, targets: np.ndarray, at: np.ndarray) -> np.ndarray:
            out, sums, ones = np.empty(len(query), np.float32), np.empty(len(query), np.float32), np.ones(len(targets), np.float32)
            places = np.arange(ROWS) * len(targets)
            with np.errstate(over="ignore"):
                for i in range(0, len(query), ROWS):
                    raw = query[i : i + ROWS] @ targets.T
                    raw.take(places[: len(raw)] + at[i : i + ROWS], out=out[i : i + ROWS])
                    np.matmul(np.exp(raw, out=raw), ones, out=sums[i : i + ROWS])
            odd = np.flatnonzero(~(np.isfinite(sums) & (sums > 0)))
            for i in range(0, len(odd), ROWS):  # beyond single precision: shift by the largest
                some = odd[i : i + ROWS]
                raw = query[some] @ targets.T
                top = raw.max(1)
                out[some], sums[some] = raw[np.arange(len(raw)), at[some]] - top, np.exp(raw - top[:, None]).sum(1)
            return out - np.log(sums)

        found = np.empty(len(units))
        for a in range(0, len(units), CHUNK):
            own = units[a : a + CHUNK]
            order = np.argsort(own.astype(np.uint16), kind="stable")  # by group
            query = self.queries(before[a : a + CHUNK].take(order, 0))
            group, slot = np.divmod(own[order], self.width)
            value = picked(query, self.group, group).astype(float)
            cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(group)], strict=True):
                g = int(group[i])
                value[i:j] += picked(query[i:j], self.unit[g * self.width : (g + 1) * self.width], slot[i:j])
            found[a + order] = value
        return found


def units_before(units: np.ndarray, end: int) -> np.ndarray:
    """(token, CONTEXT): the units before each token, the nearest first; before a text there are ends.
    Every text in ``units`` closes with an end, and the first one follows an end too."""
    out = np.full((len(units), CONTEXT), end, units.dtype)
    for k in range(CONTEXT):
        out[k + 1 :, k] = units[: max(0, len(units) - k - 1)]
        if k:
            out[out[:, k - 1] == end, k] = end
    return out


def visits(n: int, turn: int, passes: int, rng: np.random.Generator) -> np.ndarray:
    """The places of ``n`` tokens to train on in a round, in a random order. With one pass in all, a round
    has every ROUNDS-th place, so that the rounds have each once; with more, whole passes are dealt to the rounds."""
    if passes == 1:
        return rng.permutation(np.arange(turn, n, ROUNDS))
    mine = len(range(turn, passes, ROUNDS))
    return np.concatenate([np.arange(0), *(rng.permutation(n) for _ in range(mine))])


def run_sums(rows: np.ndarray, order: np.ndarray, starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The sum of each run of ``rows`` taken in ``order``; runs come by falling length. Short ones are added side by
    side, place by place, and the few long ones each for itself: much faster than ``add.reduceat`` over rows."""
    total = rows.take(order[starts], 0)
    long = int(np.searchsorted(-many, -LONG_RUN))
    for i, (a, n) in enumerate(zip(starts[:long].tolist(), many[:long].tolist(), strict=True)):
        total[i] = rows.take(order[a : a + n], 0).sum(0)
    for k in range(1, LONG_RUN):
        upto = int(np.searchsorted(-many, -k))  # those longer than k
        if upto <= long:
            break
        total[long:upto] += rows.take(order[starts[long:upto] + k], 0)
    return total


def halved(targets: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Half the targets, their biases less the levels of the noise."""
    out = targets.copy()
    out[..., -1] -= levels
    out *= 0.5
    return out


class Trainer:
    """Noise-contrastive estimation of one model on batches of tokens, with steps scaled by the
    squares of all gradients so far; counts how often each row was drawn."""

    def __init__(self, model: LogBilinear, mass: np.ndarray, rng: np.random.Generator) -> None:
        self.model, self.rng = model, rng
        self.scale = [np.full_like(x, 1e-8) for x in model.parts()]
        self.drawn = [np.zeros(len(x), np.int64) for x in model.parts()]
        groups = len(model.group)
        padded = np.concatenate([mass, np.zeros(groups * model.width - len(mass))])
        self.steps = np.concatenate([[0.0], np.cumsum(padded)])
        self.edges = self.steps[:: model.width]
        share = np.diff(self.edges) / self.edges[-1]
        self.log_group = np.log(GROUP_NOISE * np.maximum(share, 1e-30)).astype(np.float32)
        within = padded.reshape(groups, -1) / np.maximum(np.diff(self.edges), 1e-30)[:, None]
        self.log_unit = np.log(UNIT_NOISE * np.maximum(within.ravel(), 1e-30)).astype(np.float32)

    def _move(self, k: int, rows: np.ndarray, grad: np.ndarray, part: float, times: np.ndarray | None = None) -> None:
        """Go down ``part`` of the gradient of rows that may repeat; each stands for so many draws, or one."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # parts have fewer rows than that
        own = rows[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        many = np.diff(starts, append=len(own))
        drawn = many if times is None else np.add.reduceat(times[order], starts)
        by = np.argsort(many)[::-1]
        kept, total = own[starts[by]], run_sums(grad, order, starts[by], many[by])
        self.drawn[k][kept] += drawn[by]
        total *= part
        scale = self.scale[k].take(kept, 0)
        scale += total * total
        self.scale[k][kept] = scale
        total *= RATE
        total /= np.sqrt(scale, out=scale)
        self.model.parts()[k][kept] -= total

    def step(self, before: np.ndarray, units: np.ndarray) -> None:
        """One step on some tokens. Those of a group share its noise units, so that its part is a product of matrices.
        Chances are (1 + tanh) / 2 of half the difference to the noise's level, which is taken off the targets' biases;
        gradients are left at 2 n times their size until their rows are added up."""
        m, n = self.model, len(units)
        order = np.argsort(units.astype(np.uint16), kind="stable")  # by group, and by unit within it
        before, units = before.take(order, 0).T, units[order].astype(np.int64)
        vectors = [m.context.take(b, 0) for b in before]
        query = np.ones((n, SIZE + 1), np.float32)
        query[:, :SIZE] = sum(v * r for v, r in zip(vectors, m.reach, strict=True))
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(GROUP_NOISE) * self.edges[-1], "right") - 1, len(m.group) - 1)
        shared = m.group[noise]
        bad = query @ halved(shared, self.log_group[noise]).T
        np.tanh(bad, out=bad)
        bad += 1
        pull = bad @ shared
        # a token's own unit
        target = m.unit.take(units, 0)
        good = np.einsum("ij,ij->i", query, target)
        good -= self.log_unit[units]
        good *= 0.5
        np.tanh(good, out=good)
        good -= 1
        target *= good[:, None]
        pull += target
        # its group, and the noise units of the group
        group = units // m.width
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        present, many = group[starts], np.diff(starts, append=n)
        low, high = self.edges[present], self.edges[present + 1]
        other = np.searchsorted(self.steps, low[:, None] + self.rng.random((len(present), UNIT_NOISE)) * (high - low)[:, None], "right") - 1
        other = np.clip(other, 0, len(m.unit) - 1)
        heads = np.concatenate([m.group[present][:, None], m.unit[other]], 1)
        lowered = halved(heads, np.concatenate([self.log_group[present][:, None], self.log_unit[other]], 1))
        spans = list(zip(starts.tolist(), (starts + many).tolist(), strict=True))
        wrong, back, away = np.empty((n, 1 + UNIT_NOISE), np.float32), np.empty_like(pull), np.empty_like(heads)
        for i, (a, b) in enumerate(spans):
            np.matmul(query[a:b], lowered[i].T, out=wrong[a:b])
        np.tanh(wrong, out=wrong)
        wrong[:, 0] -= 1
        wrong[:, 1:] += 1
        for i, (a, b) in enumerate(spans):
            np.matmul(wrong[a:b], heads[i], out=back[a:b])
            np.matmul(wrong[a:b].T, query[a:b], out=away[i])
        back += pull
        back, part = back[:, :SIZE], 0.5 / n
        reach = np.stack([np.einsum("ij,ij->j", back, v) for v in vectors])
        moved = np.concatenate([back * r for r in m.reach])
        self._move(2, np.concatenate([present, noise]), np.concatenate([away[:, 0], bad.T @ query]), part, np.concatenate([many, np.ones(len(noise), np.int64)]))
        self._move(3, np.concatenate([units, other.ravel()]), np.concatenate([good[:, None] * query, away[:, 1:].reshape(-1, SIZE + 1)]), part)
        self._move(0, before.ravel(), moved, part)
        self._move(1, np.arange(CONTEXT), reach, part)


def train(lists: DataFrame, words: Vocabulary, tokens: int, seed: int = 5) -> LogBilinear:
    """Rounds of training in every task from the same model, and averages of what the tasks moved."""
    model = LogBilinear.new(words.mass, words.width, seed)
    if not tokens:
        return model
    passes = min(MOST * ROUNDS, max(1, round(VISITS / tokens)))
    for turn in range(ROUNDS):
        shared = lists.sparkSession.sparkContext.broadcast((model, words.mass, words.end))

        def run(batches, shared=shared, turn=turn):
            import copy

            import pyarrow as pa
            from pyspark import TaskContext

            start, mass, end = shared.value
            rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            own = Trainer(copy.deepcopy(start), mass, rng)
            for batch in batches:
                units = np.frombuffer(b"".join(batch.column("units").to_pylist()), "<u2")  # left short, as places are drawn from all over it
                before = units_before(units, end)
                places = visits(len(units), turn, passes, rng)
                for a in range(0, len(places), BATCH):
                    some = places[a : a + BATCH]
                    own.step(before[some], units[some])
            for k, (values, drawn) in enumerate(zip(own.model.parts(), own.drawn, strict=True)):
                rows = np.flatnonzero(drawn)
                flat = pa.array(values[rows].ravel())
                lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * values.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(rows), pa.array(drawn[rows]), lists_], ["part", "row", "n", "values"])

        moved = lists.mapInArrow(run, "part int, row bigint, n bigint, values array<float>")
        n, size = F.sum("n"), SIZE + 1
        mean = F.array(*[(F.sum(F.col("n") * F.get("values", F.lit(i))) / n).cast("float") for i in range(size)])
        found = moved.groupBy("part", "row").agg(mean.alias("values")).toArrow()  # one row a unit and part
        part, row = found.column("part").to_numpy(), found.column("row").to_numpy()
        values = found.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)
        for k, held in enumerate(model.parts()):
            own = part == k
            held[row[own]] = values[own, : held.shape[1]]
        shared.unpersist()
    return model


def read_documents(docs: DataFrame, words: Vocabulary, text: str) -> DataFrame:
    """Per row of ``docs``, with its columns but for the text: row (a number), n_tokens, known and logs
    (tokens and logarithms of counts at hand), inside (what words that are no units add), the units of
    all tokens as 16-bit numbers in bytes, and the words whose counts are not at hand with their times."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    carried = [c for c in docs.columns if c != text]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, row, own = TaskContext.get().partitionId() << 40, 0, shared.value
        for whole in batches:
            for batch in slices(whole, text, 16_000_000):
                ids, ends, hashes, form = tokens_of(batch.column(text).to_pylist())
                known, units, norms = own.look_up(hashes, form)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                logs = np.log10(np.maximum(known, 0) + 1.0)
                inside = np.where(norms > 0, logs - np.log10(np.maximum(norms, 1)), 0.0)
                over = lambda x: np.add.reduceat(x[ids], starts)  # noqa: E731  each text has one token at least
                rows = part + row + np.arange(len(ends))
                row += len(ends)
                beyond = np.flatnonzero(known[ids] < 0)
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[beyond]
                pair, times = np.unique(doc * len(hashes) + ids[beyond], return_counts=True)
                lists = np.searchsorted(pair // len(hashes), np.arange(len(ends) + 1))
                numbers = np.split(units.astype("<u2")[ids], ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in carried), pa.array(rows), pa.array(np.diff(ends, prepend=0)),
                        pa.array(over((known > 0).astype(np.int64))), pa.array(over(logs)), pa.array(over(inside)), pa.array([x.tobytes() for x in numbers], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(hashes[pair % len(hashes)])),
                        pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(times.astype(np.int32))),
                    ],
                    [*carried, "row", "n_tokens", "known", "logs", "inside", "units", "words", "times"],
                )

    kinds = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c != text)
    return docs.mapInArrow(run, kinds + "row bigint, n_tokens bigint, known bigint, logs double, inside double, units binary, words array<bigint>, times array<int>")


def unit_scores(read: DataFrame, model: LogBilinear, end: int) -> DataFrame:
    """``read`` with unit_logs in place of units: the model's log10-probability of all units."""
    shared = read.sparkSession.sparkContext.broadcast((model, end))

    def run(batches):
        import pyarrow as pa

        own, end = shared.value
        for batch in batches:
            raw = batch.column("units").to_pylist()
            sizes = np.fromiter((len(x) // 2 for x in raw), np.int64, len(raw))
            units = np.frombuffer(b"".join(raw), "<u2")
            each = own.log_chances(units_before(units, end), units)
            total = np.add.reduceat(each, np.cumsum(sizes) - sizes) / np.log(10) if len(raw) else each
            yield batch.drop_columns(["units"]).append_column("unit_logs", pa.array(total))

    kinds = ", ".join(f"`{c}` {t}" for c, t in read.dtypes if c != "units")
    return read.mapInArrow(run, f"{kinds}, unit_logs double")


def score(docs: DataFrame, learns: Column | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score. Rows where
    ``learns`` is true teach (all, if it is not given); all rows are scored.

    base_score is the unigram sum of log10((c + 1) / (N + V + 1)); score is the model's. A word
    that is no unit has its unit's chance times (c + 1) / (n + v + 1), with c its count, n and v the
    tokens and words that share the unit in training, so the chances of all known words and one
    unknown a form sum to one. Null texts are empty and have the end token alone; texts of any
    length are scored whole. Repeated rows and ids, also null ones, are scored each for itself; equal
    texts get equal scores. Without rows to learn from every token is unknown. Other columns are
    not read. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), F.coalesce(F.lit(True) if learns is None else learns, F.lit(False)).alias("_learns"))
    counts = cut(count_words(own.where("_learns"), "_text"), "word-counts")
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = int(sums[0] or 0), int(sums[1])
    words = vocabulary(counts)
    read = cut(read_documents(own, words, "_text"), "units")
    model = train(read.where("_learns").select("units"), words, tokens)
    beyond = read.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = (
        beyond.join(counts.select("word", "n"), "word").groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    )
    more = F.coalesce(F.col("more"), F.lit(0.0))
    scored = unit_scores(read.select("_id", "row", "n_tokens", "known", "logs", "inside", "units"), model, words.end)
    return scored.join(tail, "row", "left").select(
        F.col("_id").alias(id_column),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))).alias("base_score"),
        (F.col("unit_logs") + F.col("inside") + more).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold("doc_id", 7, 2)
    found = score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLES: dict = {}
