"""Toxicity by a convolutional text classifier on hashed word embeddings, trained in numpy.

A word's vector is the sum of the vectors of its hash and of the hashes of its first letters, so
unseen endings of a known stem still count. Filters of several widths run over the words, the
largest response of each filter over the whole text is kept, and a logistic layer weighs them.
The decision threshold of each language is calibrated on labelled texts held back from training;
a text's language is guessed from its words alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, in_fold, number_words, slices, table

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
STEMS = (4, 6)
#: About so many labelled rows of each class are trained on; every fifth of them calibrates.
SAMPLE_ROWS = {1: 2_500, 0: 5_000}
#: The sample that the driver gets is thinned to about so many bytes of text, and to those rows in
#: all where ids are repeated.
SAMPLE_BYTES = 64_000_000
EPOCHS, BATCH, RATE = 8, 32, 0.05
#: Small samples are gone through more often: about so many texts in all, 24 times at most.
VISITS = 40_000
#: Buckets that fewer training texts touch carry nothing, so that rare words are not learned by heart.
MIN_TEXTS = 3
#: Share of the words that each visit of a training batch leaves out, so that no word hides behind another.
DROP = 0.3
#: A language needs so many calibrating texts of each class for a threshold of its own.
MIN_CALIBRATION = 8
#: Weight of the share of toxic texts caught; the rest is for clean texts left alone.
CATCH = 0.35
#: The threshold of all languages counts like so many calibrating texts.
GENERAL_WEIGHT = 20
#: Tokens whose responses are held at once.
CHUNK_TOKENS = 200_000
_STRIP = b".,;:!?\"'()[]{}<>|#*$%&-_/\\"


def word_features(words: list[bytes]) -> np.ndarray:
    """(word, feature) bucket numbers: the word and its stems, hashed."""
    import xxhash

    digest = xxhash.xxh32_intdigest
    out = np.empty((len(words), 1 + len(STEMS)), np.int64)
    for i, word in enumerate(words):
        bare = word.strip(_STRIP) or word
        letters = bare.decode(errors="ignore")
        out[i, 0] = digest(bare, 1)
        for j, n in enumerate(STEMS):
            out[i, j + 1] = digest(letters[:n].encode(), 2 + j)
    return out % BUCKETS


@dataclass
class Network:
    table: np.ndarray
    kernels: list[np.ndarray]  # by width: (place, size, filter)
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    word_logs: np.ndarray | None = None  # (bucket, language) for guessing the language
    thresholds: np.ndarray | None = None

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        return cls(
            rng.normal(0, 0.03, (BUCKETS, SIZE)).astype(np.float32),
            [rng.normal(0, (SIZE * w) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32),
            0.0,
        )

    def pooled(self, vectors: np.ndarray, starts: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest positive response of each filter in each text, and its row (-1: none). The texts
        stand one after the other from ``starts`` on; rows that are not ``real`` hold zeros, follow
        each text, and are no places of a response."""
        rows = np.arange(len(vectors))[:, None]
        best = np.zeros((len(starts), len(self.weights)), np.float32)
        where = np.full(best.shape, -1)
        of_text = np.searchsorted(starts, rows[:, 0], "right") - 1
        for i, kernel in enumerate(self.kernels):
            out = vectors @ kernel[0] + self.shifts[i]
            for k in range(1, len(kernel)):
                out[:-k] += vectors[k:] @ kernel[k]
            out[~real] = -np.inf
            top = np.maximum.reduceat(out, starts)
            at = np.minimum.reduceat(np.where(out == top[of_text], rows, len(vectors)), starts)
            of = slice(i * FILTERS, (i + 1) * FILTERS)
            best[:, of] = np.maximum(top, 0)
            where[:, of] = np.where(top > 0, at, -1)
        return best, where

    def logits(self, ids: np.ndarray, ends: np.ndarray, features: np.ndarray, chunk: int = CHUNK_TOKENS) -> tuple[np.ndarray, np.ndarray]:
        """Raw outputs of texts given as word numbers, and the number of their likeliest language.
        Zero vectors follow a text. Long texts go through in chunks that overlap by the widest
        filter, so the largest response is the whole text's."""
        vectors = self.table[features].sum(1)
        projected = np.concatenate([vectors @ k for kernel in self.kernels for k in kernel], axis=1)
        logs = self.word_logs[features[:, 0]] if self.word_logs is not None and len(self.languages) else None
        found = np.empty(len(ends))
        tongue = np.zeros((len(ends), max(1, len(self.languages))))
        start = 0
        for i, end in enumerate(ends):
            best = np.zeros(len(self.weights), np.float32)
            for a in range(start, end, chunk):
                b = min(end, a + chunk + max(WIDTHS) - 1)
                own = b - a if b == end else chunk  # places whose filters see all that follows
                rows, column = projected[ids[a:b]], 0
                for j, width in enumerate(WIDTHS):
                    out = rows[:, column : column + FILTERS] + self.shifts[j]
                    for k in range(1, width):
                        out[: max(0, len(out) - k)] += rows[k:, column + k * FILTERS : column + (k + 1) * FILTERS]
                    column += width * FILTERS
                    of = slice(j * FILTERS, (j + 1) * FILTERS)
                    best[of] = np.maximum(best[of], out[:own].max(0))
            found[i] = best @ self.weights + self.bias
            if logs is not None and end > start:
                tongue[i] = logs[ids[start:end]].sum(0)
            start = end
        return found, tongue.argmax(1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        ids, ends, words = number_words([t.lower() if t else t for t in texts])
        raw, tongue = self.logits(ids, ends, word_features(words))
        if self.thresholds is not None and len(self.thresholds):
            raw = raw - self.thresholds[tongue]
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def row_sums(count: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(count, size): the sum of the rows of ``values`` that go to each place."""
    size = values.shape[1]
    return np.bincount((at[:, None] * size + np.arange(size)).ravel(), values.ravel(), count * size).reshape(count, size)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    """Stochastic gradient with per-parameter scaled steps; gradients only flow through the
    places where a filter's response was largest."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    ids, ends, words = number_words([t.lower() for t in texts])
    features = word_features(words)
    starts = np.concatenate([[0], ends[:-1]]).astype(int)
    texts_with = np.zeros(BUCKETS, int)
    for a, b in zip(starts, ends, strict=True):
        texts_with[np.unique(features[ids[a:b]])] += 1
    live = texts_with >= MIN_TEXTS
    nothing = int(texts_with.argmin())
    live[nothing] = False
    net.table[~live] = 0
    # rows that follow every text in a batch, so that no filter sees the next text
    pad = np.full(max(WIDTHS) - 1, len(features))
    features = np.vstack([features, np.full((1, features.shape[1]), nothing)])
    scale_table = np.full((BUCKETS, 1), 1e-6, np.float32)
    scale = [np.full_like(x, 1e-6) for x in (*net.kernels, *net.shifts, net.weights)]
    scale_bias = 1e-6
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    for _ in range(max(EPOCHS, min(24, VISITS // max(1, len(texts))))):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            some = order[first : first + BATCH]
            rows = np.concatenate([np.append(ids[starts[d] : ends[d]], pad) for d in some])
            sizes = ends[some] - starts[some] + len(pad)
            heads = np.cumsum(sizes) - sizes
            own = features[rows]
            left_out = rng.random(BUCKETS) < DROP
            own = np.where(left_out[own[:, :1]], nothing, own)
            vectors = net.table[own].sum(1)
            best, where = net.pooled(vectors, heads, rows != pad[0])
            out = best @ net.weights + net.bias
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[some]) * balance[some] / len(some)
            grads = [np.zeros_like(x) for x in (*net.kernels, *net.shifts, net.weights)]
            grads[-1] += g @ best
            grad_bias, touched, pushes = g.sum(), [], []
            back = np.where(where >= 0, g[:, None] * net.weights, 0)
            for i, width in enumerate(WIDTHS):
                of = slice(i * FILTERS, (i + 1) * FILTERS)
                text, one = np.nonzero(where[:, of] >= 0)
                push, at = back[:, of][text, one], where[:, of][text, one]
                grads[len(WIDTHS) + i] += back[:, of].sum(0)
                for k in range(width):
                    grads[i][k] += row_sums(FILTERS, one, push[:, None] * vectors[at + k]).T
                    touched.append(own[at + k].ravel())
                    pushes.append(np.repeat(push[:, None] * net.kernels[i][k].T[one], own.shape[1], axis=0))
            for x, s, gr in zip((*net.kernels, *net.shifts, net.weights), scale, grads, strict=True):
                s += gr**2
                x -= RATE * gr / np.sqrt(s)
            scale_bias += grad_bias**2
            net.bias -= RATE * grad_bias / scale_bias**0.5
            if touched:
                at = np.concatenate(touched)
                own = live[at]
                rows, inverse = np.unique(at[own], return_inverse=True)
                total = row_sums(len(rows), inverse, np.concatenate(pushes)[own]).astype(np.float32)
                scale_table[rows] += (total**2).mean(1, keepdims=True)
                net.table[rows] -= RATE * total / np.sqrt(scale_table[rows])
    return net


def calibrate(net: Network, texts: list[str], labels: np.ndarray, langs: list[str | None], train_texts: list[str], train_langs: list[str | None]) -> None:
    """Learn how to guess the language and set the threshold of each language where the weighted
    accuracy of both classes is best, drawn towards the threshold of all languages."""
    net.languages = sorted({x for x in train_langs if x})
    counts = np.full((BUCKETS, max(1, len(net.languages))), 0.1)
    for j, lang in enumerate(net.languages):
        ids, _, words = number_words([t.lower() for t, x in zip(train_texts, train_langs, strict=True) if x == lang])
        if len(words):
            counts[:, j] += np.bincount(word_features(words)[ids, 0], minlength=BUCKETS)
    net.word_logs = np.log(counts / counts.sum(0)).astype(np.float32)
    ids, ends, words = number_words([t.lower() for t in texts])
    raw, tongue = net.logits(ids, ends, word_features(words))

    def best_cut(values: np.ndarray, truth: np.ndarray) -> float:
        """Midway between the two neighbouring outputs that part the classes best."""
        if len(set(truth.tolist())) < 2:
            return 0.0
        order = np.sort(np.unique(values))
        cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
        low, high = np.sort(values[truth == 0]), np.sort(values[truth == 1])
        gain = (1 - CATCH) * np.searchsorted(low, cuts) / len(low) + CATCH * (1 - np.searchsorted(high, cuts) / len(high))
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        return float(cuts[best[len(best) // 2]])

    general = best_cut(raw, labels)
    net.thresholds = np.full(max(1, len(net.languages)), general)
    for j in range(len(net.languages)):
        own = tongue == j
        n = min(int((labels[own] == 0).sum()), int((labels[own] == 1).sum()))
        if n >= MIN_CALIBRATION:  # few texts move the threshold little
            net.thresholds[j] = (n * best_cut(raw[own], labels[own]) + GENERAL_WEIGHT * general) / (n + GENERAL_WEIGHT)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", sample: dict[int, int] | None = None) -> Network:
    """Train and calibrate on about ``sample[class]`` labelled rows, taken by a hash of their id.
    Ids that labels repeat with different marks, null marks and null texts teach nothing. Rows that
    repeat an id all count, as far as SAMPLE_BYTES and the sample's rows allow.
    Without both classes the network scores every text alike."""
    sample = sample or SAMPLE_ROWS
    own = docs.select(F.col(id_column).alias("_doc"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null")
    marks = labels.groupBy(F.col(id_column).alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("_top")).where("y = _top and _id is not null").select("_id", "y")
    totals = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    rate = F.coalesce(*[F.when(F.col("y") == k, F.lit(min(1.0, sample[k] / max(1, totals.get(k, 1))))) for k in sample], F.lit(0.0))
    place = F.shiftrightunsigned(F.xxhash64(F.col("_id"), F.lit(23)), 11) / F.lit(float(2**53))
    drawn = marks.where(place < rate)
    # the ids are a sample of bounded size; what repeats them is thinned before it leaves Spark
    found = cut(own.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select("_id", "text", "lang", "y"), "toxicity-sample")
    held_rows, held_bytes = found.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    stay = min(1.0, sum(sample.values()) / max(1, held_rows), SAMPLE_BYTES / max(1, held_bytes or 1))
    if stay < 1:
        found = found.where(F.shiftrightunsigned(F.xxhash64("_id", "text", F.lit(29)), 11) / F.lit(float(2**53)) < stay)
    rows = found.toPandas().sort_values(["_id", "text"], kind="stable")
    y = rows["y"].to_numpy().astype(int)
    held = np.arange(len(rows)) % 5 == 0
    texts, langs = rows["text"].tolist(), [x if isinstance(x, str) else None for x in rows["lang"]]
    if len(set(y[~held].tolist())) < 2:
        return Network.new(np.random.default_rng(0))
    pick = lambda values, mask: [v for v, m in zip(values, mask, strict=True) if m]
    net = train(pick(texts, ~held), y[~held])
    calibrate(net, pick(texts, held), y[held], pick(langs, held), pick(texts, ~held), pick(langs, ~held))
    return net


def score(docs: DataFrame, net: Network, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every row from its whole text alone. Null and empty texts get the
    score of a text without any word. Texts of any length are read whole. Equal texts get equal
    scores; a score of just 0.5 is predicted 1. Ids may be null or repeated; other columns are not read.
    An empty table gives an empty result."""
    key = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, text):
                found = shared.value.score(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [id_column, "score", "predicted"]
                )

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {key}, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = in_fold("doc_id", 5, 0)
    net = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict = {}
